"""From the place cells of tables to rows: groups of streets, taken in or left out, by known answers or by the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from .compare import first_of
from .ingest import computed_once

STREETS = f"array<{text.STREET}>"
GROUPS = f"array<struct<seniunija:string,village:string,include_streets:{STREETS},exclude_streets:{STREETS}>>"
CELL = f"struct<seniunija:string,groups:{GROUPS}>"
# What no village of an answer may hold, and what shows that a cell names a district.
NO_VILLAGE, NAMES_DISTRICT = ["kaimai", "sen.", "seniūnija"], "sen."


def blank(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))) == ""


def cell_answer(raw: Column) -> Column:
    """The answer of a parser: one object, or a list of objects whose groups are joined under the first district named. Null if it isn't of the right form."""
    body = text.unfenced(raw)
    listed = F.from_json(body, f"array<{CELL}>")
    none = F.array().cast(GROUPS)
    # a list of one gives its object
    district = F.when(F.size(listed) == 1, F.get(listed, F.lit(0))["seniunija"]).otherwise(F.get(F.filter(F.transform(listed, lambda o: o["seniunija"]), lambda s: s != ""), F.lit(0)))
    merged = F.struct(district.alias("seniunija"), F.flatten(F.transform(listed, lambda o: F.coalesce(o["groups"], none))).alias("groups"))
    one = F.from_json(body, CELL)
    single = F.struct(one["seniunija"].alias("seniunija"), F.coalesce(one["groups"], none).alias("groups"))
    named = lambda streets: F.forall(F.coalesce(streets, F.array().cast(STREETS)), lambda s: s["street"].isNotNull())
    formed = lambda a: F.forall(a["groups"], lambda g: g["village"].isNotNull() & named(g["include_streets"]) & named(g["exclude_streets"]))
    # what isn't JSON at all has no object and no groups
    known = F.when(body.startswith("["), F.when(listed.isNotNull(), merged)).when(F.json_object_keys(body).isNotNull(), single)
    return F.when(formed(known), known)


def answer_error(cell: Column, answer: Column) -> Column:
    """What is wrong with an answer to a cell (null: nothing): districts that the cell names and the answer doesn't, or headings taken for villages. An answer without groups says that there is nothing."""
    groups = answer["groups"]
    own = F.filter(groups, lambda g: ~blank(g["seniunija"]))
    bases = lambda labels: F.array_distinct(F.transform(labels, text.district_base))
    expected = bases(text.district_labels(cell))
    found = bases(F.transform(own, lambda g: g["seniunija"]))
    heading = F.exists(groups, lambda g: F.exists(F.array(*map(F.lit, NO_VILLAGE)), lambda w: F.contains(F.lower(g["village"]), w)))
    lacks = answer["seniunija"].isNull() & F.lower(cell).contains(NAMES_DISTRICT) & (F.size(F.filter(groups, lambda g: F.coalesce(g["seniunija"], F.lit("")) != "")) == 0)
    several = F.size(expected) >= 2
    return (
        F.when(F.size(groups) == 0, None)
        .when(lacks, "no district named")
        .when(heading, "a heading for a village")
        .when(several & (F.size(own) < F.size(groups)), "a group without district")
        .when(several & (F.size(found) < F.size(expected)), "too few districts")
    )


def by_rules(cell: Column) -> Column:
    """The rules' answer: one village with the streets in its brackets."""
    place = text.location(cell)
    none = F.lit(None).cast("string")
    group = F.struct(none.alias("seniunija"), place["village"].alias("village"), place["streets"].alias("include_streets"), F.array().cast(STREETS).alias("exclude_streets"))
    return F.when(place.isNotNull(), F.struct(none.alias("seniunija"), F.array(group).alias("groups")))


def parsed_places(cells: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """cells (location, waste_type) -> (location, waste_type, cell, by) of each distinct one: the cache's answer if it has one without error, else the rules'.

    cache (kaimai_hash, waste_type, parsed_result). by: answer, rules, or the error for which the rules were taken.
    """
    each = cells.select("location", "waste_type").distinct()
    if cache is None:
        return each.select("location", "waste_type", by_rules(F.col("location")).alias("cell"), F.lit("rules").alias("by"))
    # only answers to cells that occur are read, where the cells lie, and each once
    known = cache.select("kaimai_hash", "waste_type", "parsed_result", F.lit(True).alias("asked"))
    joined = each.withColumn("kaimai_hash", ids.location_hash(F.col("location"))).join(known, ["kaimai_hash", "waste_type"], "left")
    joined = computed_once(joined, "answer", cell_answer(F.col("parsed_result")))
    error = F.when(F.col("asked").isNull(), "rules").when(F.col("answer").isNull(), "no object of the right form").otherwise(answer_error(F.col("location"), F.col("answer")))
    judged = joined.withColumn("by", F.coalesce(error, F.lit("answer")))
    return judged.select("location", "waste_type", F.when(F.col("by") == "answer", F.col("answer")).otherwise(by_rules(F.col("location"))).alias("cell"), "by")


def place_rows(rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """rows (doc, t, section, r, location, waste_type, dates) -> one row per street taken in, or per group without any.

    (doc, t, section, r, seniunija, village, street, house_numbers, exclude_streets, waste_type, dates, kaimai_str, kaimai_hash).
    Of rows of a doc that are equal in place, type and dates only the first stays. Cells without an answer give none.
    """
    parsed = parsed_places(rows, cache)
    joined = rows.filter(~blank(F.col("location"))).join(parsed, ["location", "waste_type"])
    groups = joined.select("doc", "t", "section", "r", "waste_type", "dates", "location", "cell.seniunija", F.posexplode("cell.groups").alias("g", "group"))
    whole = F.array(F.struct(F.lit("").alias("street"), F.lit(None).cast("string").alias("house_numbers")))
    taken = F.coalesce("group.include_streets", F.array().cast(STREETS))
    each = groups.select("*", F.posexplode(F.when(F.size(taken) > 0, taken).otherwise(whole)).alias("s", "street_"))
    out = each.select(
        "doc", "t", "section", "r", "g", "s", F.when(F.coalesce("group.seniunija", F.lit("")) != "", F.col("group.seniunija")).otherwise(F.coalesce("seniunija", F.lit(""))).alias("seniunija"),
        text.village_name(F.col("group.village")).alias("village"), F.col("street_.street").alias("street"), F.col("street_.house_numbers").alias("house_numbers"),
        F.coalesce("group.exclude_streets", F.array().cast(STREETS)).alias("exclude_streets"), "waste_type", F.array_sort(F.array_distinct("dates")).alias("dates"), F.col("location").alias("kaimai_str"), ids.location_hash(F.col("location")).alias("kaimai_hash"),
    )
    same = {f"_{c}": text.clean_cell(F.col(c)) for c in ("seniunija", "village", "street", "house_numbers")}
    key = ["doc", *same, "waste_type", "dates"]
    return first_of(out.withColumns(same), key, ["t", "section", "r", "g", "s"]).drop(*same).drop("g", "s")
