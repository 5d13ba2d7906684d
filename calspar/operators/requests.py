"""A table of requests answered in one job: one row each, with its status, and what is wrong where nothing can be answered.

requests (n, method, path, params: map<string, string>). A parameter that isn't there and an empty one differ. Searches
by text aren't among them: `lookup.search` answers one for all locations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookup

PLACE = lookup.PLACE
ROOT = "/api/v1/"
# What answers say.
ONLY_GET = "Only GET method is allowed"
NEEDS_STREET = "This village has streets. Please select a street."
NEEDS_HOUSES = "This street has specific house numbers. Please select a house number."
NEEDS_PLACE = {
    "schedule": "Must provide either location_id or both seniunija and village",
    "schedule-multi": "Must provide seniunija and village",
    "streets": "seniunija and village parameters required",
    "house-numbers": "seniunija and village parameters required",
}
NO_LOCATION, NO_CALENDAR, NO_GROUP, NO_PATH = "Location not found", "Calendar not found", "Schedule group not found", "Not found"
DATES = "array<struct<date:date,waste_type:string>>"
BUCKETS = "array<struct<name:string,types:string>>"
ANSWER = "location_id long, schedule_group_id string, calendar_id string, calendar_status string"


def parameters(requests: DataFrame) -> DataFrame:
    """requests with their route and parameters as columns; `id` is what follows the route in the path."""
    tail = F.when(F.col("path").startswith(ROOT), F.substring(F.col("path"), len(ROOT) + 1, 4096))
    get = lambda k: F.try_element_at("params", F.lit(k))
    number = get("location_id")
    return requests.select(
        "n", "method", F.substring_index(tail, "/", 1).alias("route"), F.nullif(F.regexp_extract(tail, r"^[^/]+/(.+)$", 1), F.lit("")).alias("id"),
        # a number that isn't one, or 0, counts as not given
        F.nullif(F.when(number.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(number).cast("long")), F.lit(0)).alias("location_id"),
        *[F.coalesce(get(c), F.lit("")).alias(c) for c in PLACE], get("street").alias("street"), get("house_numbers").alias("houses"), F.coalesce(get("waste_type"), F.lit("bendros")).alias("waste_type"),
    )


def judged(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """parameters() with `status` and `error` where the parameters alone decide (else null), and the street that is asked for."""
    asked = parameters(requests).join(lookup.village_flags(locations), PLACE, "left").withColumn("has_streets", F.coalesce("has_streets", F.lit(False)))
    asked = asked.withColumn("street", F.when(F.col("route") == "house-numbers", F.coalesce("street", F.lit(""))).when(F.col("has_streets"), F.col("street")).otherwise(""))
    asked = asked.join(lookup.street_flags(locations), [*PLACE, "street"], "left").withColumn("has_buckets", F.coalesce("has_buckets", F.lit(False)))
    route = F.col("route")
    placed = (F.col("seniunija") != "") & (F.col("village") != "")
    by_id = (route == "schedule") & F.col("location_id").isNotNull()
    selects = route.isin("schedule", "schedule-multi") & ~by_id
    error = F.when(F.col("method") != "GET", ONLY_GET)
    for name, message in NEEDS_PLACE.items():
        error = error.when((route == name) & ~by_id & ~placed, message)
    error = error.when(selects & F.col("has_streets") & F.col("street").isNull(), NEEDS_STREET)
    error = error.when((route == "schedule") & ~by_id & F.col("has_buckets") & F.col("houses").isNull(), NEEDS_HOUSES)
    known = route.isin(*NEEDS_PLACE) & F.col("id").isNull() | route.isin("schedule-group", "calendar-info") & F.col("id").isNotNull() | (route == "villages")
    error = error.when(~F.coalesce(known, F.lit(False)), NO_PATH)
    status = F.when(error == ONLY_GET, 405).when(error == NO_PATH, 404).when(error.isNotNull(), 400)
    return asked.select(*asked.columns, error.alias("error"), status.alias("status"))


def answers(requests: DataFrame, locations: DataFrame, groups: DataFrame, pdf_rows: DataFrame, links: DataFrame, streams: DataFrame, dates: Callable[[Column], Column] | None = None, entries: Callable[[Column], Column] | None = None) -> DataFrame:
    """(n, route, status, error, location_id, schedule_group_id, calendar_id, calendar_status, dates, entries) of every request.

    dates: struct(date, waste_type), sorted. entries: struct(name, types) of the streets, house numbers or villages asked
    for. A schedule group that is unknown, or of another waste type, is an answer of status 200 with an error.

    Many requests have the same long answer. Where only something short of it is wanted, `dates` and `entries` say what,
    each as a function of the array: it is worked out once for each group, selection, village or street, and only its
    value goes along with the requests.
    """
    from .store import written

    as_dates, as_entries = dates or (lambda c: c), entries or (lambda c: c)
    no_dates, no_entries = as_dates(F.array().cast(DATES)), as_entries(F.array().cast(BUCKETS))
    pdf_rows = written(lookup.reduced(pdf_rows))
    asked = written(judged(requests, locations))
    good = asked.filter("error is null")
    held = locations.select("id", *PLACE, "street", "house_numbers", "kaimai_hash")
    dated = lambda g: F.transform(g, lambda d: F.struct(d.alias("date"), F.col("waste_type").alias("waste_type")))
    calendars = links.select(F.col("schedule_group_id"), F.col("calendar_stream_id").alias("_s")).join(streams.select(F.col("id").alias("_s"), "calendar_id", "calendar_synced_at"), "_s").drop("_s")
    group = groups.select(F.col("id").alias("schedule_group_id"), F.col("waste_type").alias("_type"), F.col("kaimai_hash"), as_dates(dated(F.array_sort("dates"))).alias("_dates")).join(calendars, "schedule_group_id", "left")

    # one location: by its id, or by the selection
    single = good.filter("route = 'schedule'")
    by_id = single.filter("location_id is not null").select("n", F.col("location_id").alias("id"))
    chosen = single.filter("location_id is null").select("n", *PLACE, "street", F.coalesce("houses", F.lit("")).alias("bucket"))
    by_place = lookup.location_of(chosen.select(*PLACE, "street", "bucket").distinct(), held)
    found = by_id.unionByName(chosen.join(by_place, [*PLACE, "street", "bucket"]).select("n", "id")).join(held.select("id", "kaimai_hash"), "id")
    general = group.filter("_type = 'bendros'")
    one = found.join(general, "kaimai_hash", "left").select("n", F.col("id").alias("location_id"), "schedule_group_id", "calendar_id", lookup.calendar_status().alias("calendar_status"), F.coalesce("_dates", no_dates).alias("dates"))

    # all types of a selection
    many = good.filter("route = 'schedule-multi'").select("n", *PLACE, "street", "houses")
    wanted = many.select(*PLACE, "street", F.col("houses").alias("bucket")).distinct()
    each = lookup.chosen_groups(wanted, locations, groups, pdf_rows)
    each = each.groupBy(*PLACE, "street", F.col("bucket").alias("_bucket")).agg(as_dates(F.array_sort(F.flatten(F.collect_list(dated(F.col("dates")))))).alias("dates"))
    multi = many.withColumn("_bucket", F.coalesce("houses", F.lit(""))).join(each, [*PLACE, "street", "_bucket"], "left").select("n", F.coalesce("dates", no_dates).alias("dates"))

    # a group, with its calendar, or why not
    named = good.filter("route = 'schedule-group'").select("n", F.col("id").alias("schedule_group_id"), "waste_type").join(group, "schedule_group_id", "left")
    wrong = F.when(F.col("_type").isNull(), NO_GROUP).when(F.col("_type") != F.col("waste_type"), F.concat(F.lit('Schedule group is for waste_type "'), "_type", F.lit('", not "'), "waste_type", F.lit('"')))
    right = wrong.isNull()
    grouped = named.select("n", wrong.alias("_said"), "schedule_group_id", F.when(right, F.col("calendar_id")).alias("calendar_id"), F.when(right, F.col("_dates")).otherwise(no_dates).alias("dates"))

    # lists of a village or a street
    entry = lambda name: as_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "types")))).alias("entries")
    of_village = lookup.streets(locations, groups, pdf_rows).groupBy(*PLACE).agg(entry("street"))
    of_street = lookup.house_numbers(locations, groups, pdf_rows).groupBy(*PLACE, "street").agg(entry("bucket"))
    every = lookup.villages(locations, groups, pdf_rows).select(F.concat_ws("/", *PLACE).alias("name"), F.col("available").alias("types")).agg(entry("name"))
    lists = good.filter("route = 'streets'").select("n", *PLACE).join(of_village, PLACE, "left").select("n", F.coalesce("entries", no_entries).alias("entries"))
    lists = lists.unionByName(good.filter("route = 'house-numbers'").select("n", *PLACE, "street").join(of_street, [*PLACE, "street"], "left").select("n", F.coalesce("entries", no_entries).alias("entries")))
    lists = lists.unionByName(good.filter("route = 'villages'").select("n", F.lit(1).alias("_k")).join(every.withColumn("_k", F.lit(1)), "_k").select("n", "entries"))
    calendar = good.filter("route = 'calendar-info'").select("n", F.col("id").alias("calendar_id")).join(streams.select("calendar_id").distinct(), "calendar_id", "left_semi")

    parts = [one, multi, grouped, lists, calendar.select("n", "calendar_id")]
    got = parts[0].withColumn("_said", F.lit(None).cast("string"))
    for part in parts[1:]:
        got = got.unionByName(part, allowMissingColumns=True)
    columns = [c.split(" ", 1) for c in ANSWER.split(", ")]
    out = asked.select("n", "route", "status", "error").join(got.withColumn("_found", F.lit(True)), "n", "left")
    missing = F.col("error").isNull() & F.col("_found").isNull()
    error = F.coalesce("error", "_said", F.when(missing & (F.col("route") == "schedule"), NO_LOCATION).when(missing & (F.col("route") == "calendar-info"), NO_CALENDAR))
    status = F.coalesce("status", F.when(missing, 404).otherwise(200))
    return out.select("n", "route", status.alias("status"), error.alias("error"), *[F.col(c).cast(kind).alias(c) for c, kind in columns], "dates", "entries")


def as_json(answered: DataFrame) -> DataFrame:
    """(n, status, body): the answers as JSON texts, an error alone where there is one."""
    body = F.to_json(F.struct(*[c for c in answered.columns if c not in ("n", "status", "error", "route")]))
    return answered.select("n", "status", F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(body).alias("body"))


def dates_text(dates: Column) -> Column:
    """Dates of an answer as "day type" texts, comma-joined."""
    return F.array_join(F.transform(dates, lambda x: F.concat_ws(" ", x["date"].cast("string"), x["waste_type"])), ",")


def dates_of(answered: DataFrame) -> Column:
    """The dates of answers as "day type" texts, comma-joined."""
    return dates_text(answered["dates"])
