"""Shared date patterns (calendar streams): find or create, reconcile with the groups, queues and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.dates import event_times, pending_until

PATTERN = ["waste_type", "dates_hash"]
PENDING = ["pending_clean_started_at", "pending_clean_until", "pending_clean_notice_sent_at"]


def open_streams(streams: DataFrame, exclude: str | None = None) -> DataFrame:
    """Per pattern the oldest stream that isn't pending clean-up, nor the one to exclude: (waste_type, dates_hash, stream_id)."""
    live = streams.filter("pending_clean_started_at is null and dates_hash <> ''")
    if exclude is not None:
        live = live.filter(F.col("id") != exclude)
    return live.groupBy(*PATTERN).agg(F.min(F.struct("created_at", "id")).alias("s")).select(*PATTERN, F.col("s.id").alias("stream_id"))


def find_or_create(streams: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(streams with those that wanted patterns lacked, wanted with stream_id). Patterns without dates get no stream."""
    patterns = wanted.filter("dates_hash <> ''").groupBy(*PATTERN).agg(F.first("dates").alias("dates"))
    known = open_streams(streams)
    generation = streams.groupBy(*PATTERN).agg(F.count("*").alias("g"))
    new = patterns.join(known, PATTERN, "left_anti").join(generation, PATTERN, "left")
    new = new.select(ids.stream_id(F.col("waste_type"), F.col("dates_hash"), F.coalesce("g", F.lit(0))).alias("id"), *PATTERN, "dates")
    rows = new.select(
        "id", *PATTERN, "dates", F.array_min("dates").alias("first_date"), F.array_max("dates").alias("last_date"), F.size("dates").cast("long").alias("date_count"),
        F.lit(None).cast("string").alias("calendar_id"), F.lit(None).cast("timestamp").alias("calendar_synced_at"),
        *[F.lit(None).cast("timestamp").alias(p) for p in PENDING], now.alias("created_at"), now.alias("updated_at"),
    )
    every = known.unionByName(new.select(*PATTERN, F.col("id").alias("stream_id")))
    return streams.unionByName(rows.select(streams.columns)), wanted.join(every, PATTERN, "left")


def reconcile(streams: DataFrame, links: DataFrame, groups: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(streams, links) once the groups' dates have changed; running it again changes nothing.

    A stream whose groups share one pattern takes it over and keeps its calendar. One whose groups differ is split:
    each pattern gets another stream, and the old one is marked for clean-up. A stream without groups is marked too.
    """
    linked = links.join(groups.select(F.col("id").alias("schedule_group_id"), "waste_type", "dates_hash", "dates"), "schedule_group_id")
    shape = linked.groupBy(F.col("calendar_stream_id").alias("id")).agg(
        F.count_distinct("dates_hash").alias("patterns"), F.first("dates_hash").alias("new_hash"), F.first("dates").alias("new_dates")
    )
    # one row per linked stream, so the join keeps the streams' rows
    state = streams.join(shape, "id", "left")
    one, many, none = F.col("patterns") == 1, F.col("patterns") > 1, F.col("patterns").isNull()
    starts = many | (none & F.col("pending_clean_started_at").isNull())
    changed = one & ~F.col("dates_hash").eqNullSafe(F.col("new_hash"))

    def take(old: str, new: Column) -> Column:
        return F.when(one, new).otherwise(F.col(old)).alias(old)

    updates = {
        "dates_hash": take("dates_hash", F.col("new_hash")),
        "dates": take("dates", F.col("new_dates")),
        "first_date": take("first_date", F.array_min("new_dates")),
        "last_date": take("last_date", F.array_max("new_dates")),
        "date_count": take("date_count", F.size("new_dates").cast("long")),
        "calendar_synced_at": F.when(changed, None).otherwise(F.col("calendar_synced_at")).alias("calendar_synced_at"),
        "pending_clean_started_at": F.when(starts, now).when(one, None).otherwise(F.col("pending_clean_started_at")).alias("pending_clean_started_at"),
        "pending_clean_until": F.when(starts, pending_until(now)).when(one, None).otherwise(F.col("pending_clean_until")).alias("pending_clean_until"),
        "pending_clean_notice_sent_at": F.when(starts | one, None).otherwise(F.col("pending_clean_notice_sent_at")).alias("pending_clean_notice_sent_at"),
        "updated_at": F.when(starts | changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    }
    moved = state.select(*[updates.get(c, F.col(c)) for c in streams.columns])
    split = shape.filter(many).select(F.col("id").alias("calendar_stream_id"))
    leaving = linked.join(split, "calendar_stream_id", "left_semi").select("schedule_group_id", *PATTERN, "dates")
    streams_after, placed = find_or_create(moved, leaving, now)
    staying = links.join(leaving.select("schedule_group_id"), "schedule_group_id", "left_anti")
    relinked = placed.filter("stream_id is not null").select("schedule_group_id", F.col("stream_id").alias("calendar_stream_id"))
    return streams_after, staying.select("schedule_group_id", "calendar_stream_id").unionByName(relinked)


def replace_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """links with those of changes in place of theirs; a change to null only unlinks."""
    kept = links.join(changes.select("schedule_group_id"), "schedule_group_id", "left_anti")
    return kept.unionByName(changes.filter("calendar_stream_id is not null").select(links.columns))


def needing_sync(streams: DataFrame) -> DataFrame:
    """The work queue: streams without a calendar or not synced since a change, and not pending clean-up."""
    return streams.filter("(calendar_id is null or calendar_synced_at is null) and pending_clean_started_at is null")


def in_order(queue: DataFrame) -> DataFrame:
    """The work queue with what has changed last at its head."""
    return queue.orderBy(F.desc("updated_at"), "id")


def pending_cleanup(streams: DataFrame, now: Column) -> DataFrame:
    return streams.filter(F.col("pending_clean_until").isNotNull() & (F.col("pending_clean_until") <= now)).orderBy("pending_clean_until", "id")


def unlinked(streams: DataFrame, links: DataFrame) -> DataFrame:
    return streams.join(links.select(F.col("calendar_stream_id").alias("id")), "id", "left_anti")


def orphan_calendars(external: DataFrame, streams: DataFrame) -> DataFrame:
    """External calendars that no stream names: what a clean-up would delete."""
    return external.join(streams.filter("calendar_id is not null").select("calendar_id"), "calendar_id", "left_anti")


def available_calendars(external: DataFrame, markers: list[str]) -> DataFrame:
    """External calendars whose summary holds every marker."""
    for m in markers:
        external = external.filter(F.col("summary").contains(m))
    return external


def subscriptions(streams: DataFrame, prefix: str) -> DataFrame:
    """Streams that have a calendar, with the link to subscribe to it."""
    return streams.filter("calendar_id is not null").withColumn("link", F.concat(F.lit(prefix), "calendar_id"))


def representative_district(streams: DataFrame, links: DataFrame, groups: DataFrame, locations: DataFrame) -> DataFrame:
    """Per stream the first district among its groups' locations, for the calendar's name."""
    own = links.join(groups.select(F.col("id").alias("schedule_group_id"), "kaimai_hash"), "schedule_group_id").join(locations.select("kaimai_hash", "seniunija"), "kaimai_hash")
    return own.groupBy(F.col("calendar_stream_id").alias("id")).agg(F.min("seniunija").alias("seniunija"))


def calendar_plan(streams: DataFrame, districts: DataFrame, names: dict[str, str], default: str = "") -> DataFrame:
    """Names of the calendars to be created: district - waste - start of the id."""
    from ..functions.dates import lookup

    shown = F.coalesce(F.try_element_at(lookup(names), F.col("waste_type")), F.col("waste_type"))
    joined = streams.filter("calendar_id is null").join(districts, "id", "left")
    return joined.select("id", F.concat_ws(" - ", F.coalesce("seniunija", F.lit(default)), shown, F.substring("id", 1, 6)).alias("name"))


def cleanup_notices(streams: DataFrame, zone: str = "Europe/Vilnius") -> DataFrame:
    """(id, calendar_id, d, start, end): three daily notices, from 09:00 to 11:00, from the day a stream is marked."""
    day = F.to_date("pending_clean_started_at")
    marked = streams.filter("pending_clean_started_at is not null and calendar_id is not null")
    days = marked.select("id", "calendar_id", F.explode(F.sequence(day, F.date_add(day, 2))).alias("d"))
    start, end = event_times(F.col("d"), zone, 9, 11)
    return days.select("id", "calendar_id", "d", start.alias("start"), end.alias("end"))


def notices_sent(streams: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """streams once the notices of some ids have been sent."""
    marked = streams.join(sent.select("id").distinct().withColumn("_sent", F.lit(True)), "id", "left")
    new = {c: F.when(F.col("_sent"), now).otherwise(F.col(c)).alias(c) for c in ("pending_clean_notice_sent_at", "updated_at")}
    return marked.select(*[new.get(c, F.col(c)) for c in streams.columns])
