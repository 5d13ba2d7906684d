"""From spreadsheet rows to schedule rows: sections filled, cells parsed or answered from a cache, checks, unchanged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from . import store, streams

# What messages of a failed check hold if they forbid a write.
CRITICAL = ["no locations", "empty seniunija", "empty village", "invalid village format", "missing required"]


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a generated column, so that nothing above repeats its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def filled_down(rows: DataFrame, column: str, within: list[str], order: str) -> DataFrame:
    """rows with a blank cell of the column taking the last one above it that isn't blank, as merged cells leave them."""
    above = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(text.strip(F.col(column)), F.lit("")), ignorenulls=True).over(above))


def valid_answer(answer: Column) -> Column:
    """Whether a parser's answer struct<village, streets: array<struct<street, house_numbers>>> can be used."""
    street_ok = lambda s: (F.length(text.strip(F.coalesce(s["street"], F.lit("")))) > 0) & (
        s["house_numbers"].isNull() | (F.length(text.strip(s["house_numbers"])) > 1) | text.strip(s["house_numbers"]).rlike(r"^\d$")
    )
    village = F.length(text.strip(F.coalesce(answer["village"], F.lit("")))) > 0
    return answer.isNotNull() & village & answer["streets"].isNotNull() & F.coalesce(F.forall(answer["streets"], street_ok), F.lit(False))


ANSWER = "struct<village:string,streets:array<struct<street:string,house_numbers:string>>>"


def answers(cache: DataFrame) -> DataFrame:
    """(key, answer) of the cached parses that hold an object of the right form; code fences and a list around one object are taken off."""
    raw = text.unfenced(F.col("parsed_result"))
    one = F.when(raw.startswith("["), F.get(F.from_json(raw, f"array<{ANSWER}>"), F.lit(0))).otherwise(F.from_json(raw, ANSWER))
    return cache.select("key", one.alias("answer")).filter(valid_answer(F.col("answer")))


def parsed_cells(cells: DataFrame, cache: DataFrame | None) -> DataFrame:
    """cells (kaimai) -> (kaimai, village, streets) of each distinct cell that can be parsed.

    Simple cells go by the rules, others by the cache. Without a cache, cells that need it are left out; with one, a cell
    that it lacks falls back to the rules, but not a cell whose village by the rules is leftover street text.
    """
    by_rules = cells.select("kaimai").filter("kaimai is not null").distinct()
    by_rules = computed_once(by_rules, "own", text.location(F.col("kaimai")))
    hard = text.is_complex(F.col("kaimai"))
    if cache is None:
        out = by_rules.filter(~hard).withColumn("got", F.when(~text.suspicious_village(F.col("own.village")), F.col("own")))
    else:
        known = answers(cache).withColumnRenamed("answer", "given")
        streets = F.filter(F.transform("given.streets", lambda s: F.struct(text.strip(s["street"]).alias("street"), text.house_numbers(s["house_numbers"]).alias("house_numbers"))), lambda s: s["street"] != "")
        joined = by_rules.withColumn("key", ids.parser_cache_key(F.col("kaimai"))).join(known, "key", "left")
        cached = F.when(F.col("given").isNotNull(), F.struct(text.strip(F.col("given.village")).alias("village"), streets.alias("streets")))
        got = F.when(hard, F.coalesce(cached, F.col("own"))).when(text.suspicious_village(F.col("own.village")), cached).otherwise(F.col("own"))
        out = joined.withColumn("got", got)
    return out.select("kaimai", "got.village", "got.streets").filter("village <> ''")


def sheet_schedules(rows: DataFrame, months: list[str], year: int = 2026, cache: DataFrame | None = None) -> DataFrame:
    """rows (file, row, seniunija, kaimai, one column a month) -> (file, row, seniunija, village, street, house_numbers, dates, kaimai_str).

    One row per street of a cell, or one for the whole village. Rows without a district above, a cell, a village or a date are left out.
    """
    filled = filled_down(rows, "seniunija", ["file"], "row").withColumn("kaimai", F.nullif(text.strip(F.col("kaimai")), F.lit("")))
    every = F.array_sort(F.array_distinct(F.concat(*[dates.cell_dates(F.col(m), F.lit(m), year) for m in months])))
    dated = computed_once(filled.filter("seniunija is not null and kaimai is not null"), "dates", every).select("file", "row", "seniunija", "kaimai", "dates").filter(F.size("dates") > 0)
    placed = dated.join(parsed_cells(dated, cache), "kaimai")
    whole = F.array(F.struct(F.lit("").alias("street"), F.lit(None).cast("string").alias("house_numbers")))
    each = placed.withColumn("s", F.explode(F.when(F.size("streets") > 0, F.col("streets")).otherwise(whole)))
    return each.select("file", "row", "seniunija", "village", "s.street", "s.house_numbers", "dates", F.col("kaimai").alias("kaimai_str"))


def issues(rows: DataFrame, key: str) -> DataFrame:
    """(key, issue, critical): what is wrong with each schedule row; rows without issue don't appear."""
    blank = lambda c: F.length(text.strip(F.coalesce(F.col(c), F.lit("")))) == 0
    found = F.array_compact(
        F.array(
            F.when(blank("seniunija"), "empty seniunija"),
            F.when(blank("village"), "empty village").when(text.suspicious_village(F.col("village")), "invalid village format"),
            F.when(F.col("street").isNull(), "missing required key: street"),
            F.when(F.coalesce(F.size("dates"), F.lit(0)) <= 0, "no pickup dates"),
        )
    )
    out = rows.select(key, F.explode(found).alias("issue"))
    return out.withColumn("critical", is_critical(F.col("issue")))


def is_critical(message: Column) -> Column:
    out = F.lit(False)
    for part in CRITICAL:
        out = out | F.lower(message).contains(part)
    return out


def better_parse(first: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """The rows of the second parse if it has fewer critical issues than the first or none, else the first: decided by two counts."""
    a, b = (issues(d, key).filter("critical").count() for d in (first, again))
    return again if b < a or b == 0 else first


def latest_fetches(log: DataFrame) -> DataFrame:
    """The last successful or seeded fetch of each source (kind, source_url)."""
    good = log.filter(F.col("status").isin("success", "seeded"))
    rest = [c for c in log.columns if c not in ("kind", "source_url")]
    return good.groupBy("kind", "source_url").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("f")).select("kind", "source_url", *[F.col(f"f.{c}").alias(c) for c in rest])


def same_head(old: str, new: str) -> Column:
    """Whether metadata show a source to be unchanged: the tag, or else time and length, known on both sides and equal."""
    both = lambda c: F.coalesce(F.col(f"{old}.{c}") == F.col(f"{new}.{c}"), F.lit(False))
    tag = both("etag") & (F.length(f"{new}.etag") > 0)
    return tag | (both("last_modified") & (F.length(f"{new}.last_modified") > 0) & both("content_length"))


def source_plan(heads: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """(kind, source_url, action) for each offered source: `unchanged` by its metadata, `parsed` if its content was fetched with success before, else `fetch`."""
    last = latest_fetches(log).select("kind", "source_url", F.struct("etag", "last_modified", "content_length").alias("old"))
    seen = log.filter("status = 'success' and content_hash is not null").select("kind", "source_url", "content_hash").distinct().withColumn("seen", F.lit(True))
    joined = heads.withColumn("new", F.struct("etag", "last_modified", "content_length")).join(last, ["kind", "source_url"], "left").join(seen, ["kind", "source_url", "content_hash"], "left")
    action = F.when(F.lit(force), "fetch").when(F.col("old").isNotNull() & same_head("old", "new"), "unchanged").when(F.col("seen"), "parsed").otherwise("fetch")
    return joined.select("kind", "source_url", action.alias("action"))


def write_schedules(versions: store.Versions, rows: DataFrame, waste_type: str, now: Column, source: str) -> bool:
    """Takes schedule rows into the tables groups, locations, streams and links, and logs the fetch, as one version.

    rows (seniunija, village, street, house_numbers, dates, kaimai_str). If a row has a critical issue, or there is no
    row, only the log gets a line. The tables of the current version must exist. False: nothing but the log was written.
    """
    held = {t: versions.read(t) for t in ("groups", "locations", "streams", "links", "fetches")}
    found = issues(rows.withColumn("_key", ids.location_hash(F.col("kaimai_str"))), "_key").filter("critical")
    failed = rows.isEmpty() or not found.isEmpty()
    line = rows.sparkSession.createDataFrame([(source, "validation_error" if failed else "success")], "source string, status string").withColumn("created_at", now)
    log = held["fetches"].unionByName(line)
    if failed:
        versions.commit({**held, "fetches": log})
        return False
    keyed = rows.withColumn("kaimai_hash", ids.location_hash(F.col("kaimai_str")))
    each = keyed.groupBy("kaimai_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("dates"))
    each = each.select(
        ids.group_id(F.lit(waste_type), F.col("kaimai_hash")).alias("id"), "kaimai_hash", F.lit(waste_type).alias("waste_type"), "dates", ids.dates_hash(F.col("dates")).alias("dates_hash"),
        F.array_min("dates").alias("first_date"), F.array_max("dates").alias("last_date"), F.size("dates").cast("long").alias("date_count"),
    )
    groups = store.upsert_groups(held["groups"], each, now)
    place = ["seniunija", "village", "street", "house_numbers"]
    new = store.latest(keyed.select(*place, "kaimai_hash"), place, ["kaimai_hash"]).withColumn("updated_at", now)
    locations = store.upsert(held["locations"], new, place)
    after, links = streams.reconcile(held["streams"], held["links"], groups, now)
    unlinked = each.join(links.select(F.col("schedule_group_id").alias("id")), "id", "left_anti").select(F.col("id").alias("schedule_group_id"), *streams.PATTERN, "dates")
    after, placed = streams.find_or_create(after, unlinked, now)
    links = links.unionByName(placed.filter("stream_id is not null").select("schedule_group_id", F.col("stream_id").alias("calendar_stream_id")))
    versions.commit({"groups": groups, "locations": locations, "streams": after, "links": links, "fetches": log})
    return True
