"""Files of schedule rows replaced one at a time: only groups and streams that a replaced file touches are computed anew.

A group's dates are those of the last row of its key over all files. A file touches the keys of its rows, old and new;
of these only groups whose pattern changes matter further. A stream is touched if a changed group is linked to it, or if
it has a pattern that such groups now ask for, as they may join it. Those streams, with all their groups, are a model of
their own: reconciling them gives what reconciling everything gives, provided that everything was reconciled before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import store, streams

KEY = ["waste_type", "kaimai_hash"]


@dataclass
class Model:
    """rows (source_file, row, waste_type, kaimai_hash, dates), groups, streams and links."""

    rows: DataFrame
    groups: DataFrame
    streams: DataFrame
    links: DataFrame


def groups_of(rows: DataFrame) -> DataFrame:
    """The group of each key, by its last row that has a type, a place and dates."""
    usable = rows.filter("waste_type <> '' and kaimai_hash <> '' and size(dates) > 0")
    last = store.latest(usable.select(*KEY, "source_file", "row", "dates"), KEY, ["source_file", "row"])
    dates = F.array_sort(F.array_distinct("dates"))
    return last.select(*KEY, dates.alias("dates")).select(
        ids.group_id(F.col("waste_type"), F.col("kaimai_hash")).alias("id"), *KEY, "dates", ids.dates_hash(F.col("dates")).alias("dates_hash"),
        F.array_min("dates").alias("first_date"), F.array_max("dates").alias("last_date"), F.size("dates").cast("long").alias("date_count"),
    )


def link_new(held: DataFrame, links: DataFrame, groups: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(streams, links) once groups without a stream have one of their pattern."""
    alone = groups.join(links.select(F.col("schedule_group_id").alias("id")), "id", "left_anti").select(F.col("id").alias("schedule_group_id"), *streams.PATTERN, "dates")
    after, placed = streams.find_or_create(held, alone, now)
    return after, links.unionByName(placed.filter("stream_id is not null").select("schedule_group_id", F.col("stream_id").alias("calendar_stream_id")))


def touched_streams(held: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of the streams that changed groups (id, waste_type, dates_hash, ...) are linked to, and of those with the patterns that groups of these streams now have."""
    linked = links.join(changed.select(F.col("id").alias("schedule_group_id")), "schedule_group_id", "left_semi").select(F.col("calendar_stream_id").alias("id"))
    # a stream that is split sends its unchanged groups to streams of their pattern, too: its own pattern counts
    own = held.join(linked, "id", "left_semi").select(*streams.PATTERN)
    wanted = changed.select(*streams.PATTERN).unionByName(own).distinct()
    return linked.unionByName(held.join(wanted, streams.PATTERN, "left_semi").select("id")).distinct()


def reconcile_touched(held: DataFrame, links: DataFrame, groups: DataFrame, changed: DataFrame, now: Column, linking: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(streams, links, ids of the streams touched) after groups have changed; groups has the changed ones already.

    changed: those of groups that are new or have another pattern. linking: new groups get streams.
    """
    touched = store.written(touched_streams(held, links, changed))
    some = held.join(touched, "id", "left_semi")
    own_links = links.join(touched.withColumnRenamed("id", "calendar_stream_id"), "calendar_stream_id", "left_semi").select(links.columns)
    own_groups = groups.join(own_links.select(F.col("schedule_group_id").alias("id")), "id", "left_semi")
    after, linked = streams.reconcile(some, own_links, own_groups, now)
    if linking:
        fresh = changed.join(links.select(F.col("schedule_group_id").alias("id")), "id", "left_anti")
        after, more = link_new(after, linked, fresh.unionByName(own_groups.select(fresh.columns)), now)
        linked = more
    # read twice: streams and links are made from the same plan
    after, linked = store.written(after), store.written(linked)
    rest = held.join(touched, "id", "left_anti")
    other = links.join(touched.withColumnRenamed("id", "calendar_stream_id"), "calendar_stream_id", "left_anti")
    return rest.unionByName(after.select(rest.columns)), other.select(links.columns).unionByName(linked.select(links.columns)), touched


def replace_file(model: Model, file: str, new_rows: DataFrame, now: Column) -> tuple[Model, dict[str, int]]:
    """The model once a file's rows are replaced, and how many groups and streams were computed anew, and how many not.

    A group whose last row goes keeps its dates. new_rows without a row: the file goes.
    """
    new_rows = new_rows.withColumn("source_file", F.lit(file)).select(model.rows.columns)
    rows = model.rows.filter(F.col("source_file") != file).unionByName(new_rows)
    keys = store.written(model.rows.filter(F.col("source_file") == file).select(*KEY).unionByName(new_rows.select(*KEY)).distinct())
    fresh = groups_of(rows.join(keys, KEY, "left_semi"))
    before = model.groups.select("id", F.col("dates_hash").alias("_before"))
    changed = store.written(fresh.join(before, "id", "left").filter(~F.col("dates_hash").eqNullSafe(F.col("_before"))).drop("_before"))
    part = model.groups.join(changed.select("id"), "id", "left_semi")
    groups = model.groups.join(changed.select("id"), "id", "left_anti").unionByName(store.upsert_groups(part, changed, now).select(model.groups.columns))
    groups = store.written(groups)
    held, links, touched = reconcile_touched(model.streams, model.links, groups, changed, now)
    n_groups, n_streams = model.groups.count(), model.streams.count()
    seen, streams_seen = keys.count(), touched.count()
    known = model.groups.join(keys, KEY, "left_semi").count()
    counts = {"keys": seen, "groups_changed": changed.count(), "groups_untouched": n_groups - known, "streams_touched": streams_seen, "streams_untouched": n_streams - streams_seen}
    return Model(rows, groups, held, links), counts


def rebuilt(model: Model, rows: DataFrame, now: Column) -> Model:
    """The model once all groups of rows are computed anew and all streams reconciled."""
    groups = store.written(store.upsert_groups(model.groups, groups_of(rows), now))
    held, links = streams.reconcile(model.streams, model.links, groups, now)
    held, links = link_new(store.written(held), store.written(links), groups, now)
    return Model(rows, groups, held, links)
