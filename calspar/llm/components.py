"""Connected components of a table of links, by contraction: no link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id that a link names.

    Each round points every id at its smallest neighbour, follows the pointers to their ends and contracts the links;
    the ids that are left at least halve, so rounds grow with the logarithm of the number of ids.
    """
    tables = common.Tables(links.sparkSession, "components")
    links = tables.write(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("id"), "to"))
        while True:
            # two steps at a time: a star is done after one look
            step = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
            last = to.select(F.col("id").alias("next"), F.col("to").alias("end"))
            moved = tables.write(common.met(common.met(to, step, "to"), last, "next").select("id", F.col("end").alias("new"), (F.col("end") != F.col("next")).alias("moved")))
            to = moved.select("id", F.col("new").alias("to"))
            if moved.filter("moved").isEmpty():
                break
        if found is None:
            found = to.select("id", F.col("to").alias("component"))
        else:
            found = tables.write(common.met(found, to.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = to.select(F.col("id").alias("a"), F.col("to").alias("x"))
        links = common.met(common.met(links, ends, "a").select("x", "b"), ends.toDF("b", "y"), "b").filter("x <> y")
        links = tables.write(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return tables.last(found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component")))
