"""Comparison of independently sourced rows with the general locations, in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .store import in_files, written

# Words that comparison drops from village, district and street names.
VILLAGE_WORDS, DISTRICT_WORDS, STREET_WORDS = ["k", "vs", "mstl", "m"], ["sen", "seniunija"], ["g", "al", "akl", "pl", "kel", "tak", "skg", "aklg"]
TIERS = {
    "exact": ["s", "v", "st", "h"],
    "street_only": ["s", "v", "st"],
    "village_stem": ["s", "vs", "st"],
    "village_only": ["s", "v"],
    "global_exact": ["v", "st"],
    "global_stem": ["vs", "st"],
}
#: Tiers in which a key of several locations matches none of them.
UNIQUE = {"street_only", "village_only", "global_exact", "global_stem"}


def keys(seniunija: Column, village: Column, street: Column, houses: Column, strict: bool) -> list[Column]:
    return [
        text.compared(seniunija, DISTRICT_WORDS, strict).alias("s"),
        text.compared(village, VILLAGE_WORDS, strict).alias("v"),
        text.stem(text.compared(village, VILLAGE_WORDS, strict)).alias("vs"),
        text.compared(street, STREET_WORDS, strict).alias("st"),
        text.compared_houses(houses).alias("h"),
    ]


def tier_table(named: DataFrame, tier: str) -> DataFrame:
    """Per key of a tier its location's hash: the first by id, or only those of a single location."""
    table = named.groupBy(*TIERS[tier]).agg(F.count("*").alias("n"), F.min_by("kaimai_hash", "id").alias(tier))
    return (table.filter("n = 1") if tier in UNIQUE else table).drop("n")


def match(rows: DataFrame, locations: DataFrame, strict: bool = False) -> DataFrame:
    """rows with match_hash and match_method: the first tier that has the row's key. Each tier is one equality join.

    Names are put into their compared forms and matched once for each distinct set of them, then joined with the rows.
    """
    names = {"_s": F.coalesce("mapped_seniunija", "seniunija"), "_v": F.coalesce("mapped_village", "village"), "_st": F.coalesce("mapped_street", "street"), "_h": F.col("house_numbers")}
    named = rows.withColumns(names)
    each = named.select(*names).distinct()
    each = each.select(*names, *keys(F.col("_s"), F.col("_v"), F.col("_st"), F.col("_h"), strict))
    places = written(locations.select("id", "kaimai_hash", *keys(F.col("seniunija"), F.col("village"), F.col("street"), F.col("house_numbers"), strict)))
    for tier, on in TIERS.items():
        each = each.join(tier_table(places, tier), on, "left")
    method = F.coalesce(*[F.when(F.col(t).isNotNull(), t) for t in TIERS])
    found = in_files(each.select(*[F.col(n).alias(f"{n}2") for n in names], F.coalesce(*TIERS).alias("match_hash"), method.alias("match_method")))
    same = [F.col(n).eqNullSafe(F.col(f"{n}2")) for n in names]
    return named.join(found, same).drop(*names, *[f"{n}2" for n in names])


def outcome(matched: DataFrame, groups: DataFrame) -> DataFrame:
    """matched with `outcome`: overlap, conflict or no_match, by its dates and those of the general group of its match.

    Sets of dates are compared by a digest, made once for each group.
    """

    def digest(dates: Column) -> Column:
        return F.when(F.size(dates) > 0, F.sha2(F.array_join(F.array_sort(F.array_distinct(dates)).cast("array<string>"), ","), 256)).otherwise("")

    general = groups.filter("waste_type = 'bendros'").select(F.col("kaimai_hash").alias("match_hash"), digest(F.col("dates")).alias("_theirs"))
    both = matched.join(general, "match_hash", "left").withColumn("_ours", F.coalesce(digest(F.col("dates")), F.lit("")))
    empty = (F.col("_ours") == "") | (F.col("_theirs") == "")
    return both.withColumn("outcome", F.when(F.col("_theirs").isNull(), "no_match").when(empty, "empty").when(F.col("_ours") == F.col("_theirs"), "overlap").otherwise("conflict")).drop("_ours", "_theirs")


def report(results: DataFrame, times: Column | None = None) -> DataFrame:
    """Counts for all rows (waste_type null) and for each type: one pass, rolled up. Rows with an empty side are conflicts, but not matched.

    times: how many rows each row stands for; one by default.
    """
    times = F.lit(1) if times is None else times

    def n(*what: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome").isin(*what), times)), F.lit(0))

    return results.rollup("waste_type").agg(F.coalesce(F.sum(times), F.lit(0)).alias("total"), n("overlap", "conflict").alias("matched"), n("overlap").alias("overlap"), n("conflict", "empty").alias("conflict"), n("no_match").alias("no_match"))


def methods(matched: DataFrame) -> DataFrame:
    """How many rows each tier matched, those without any included."""
    names = matched.sparkSession.createDataFrame([(t,) for t in TIERS], "match_method string")
    found = matched.groupBy("match_method").agg(F.count("*").alias("n"))
    return names.join(found, "match_method", "left").select("match_method", F.coalesce("n", F.lit(0)).alias("n"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
