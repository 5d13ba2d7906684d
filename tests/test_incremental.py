"""Replacing files one at a time against computing everything anew."""

import datetime
import random

from calspar.operators import incremental
from pyspark.sql import functions as F

D = datetime.date
ROW = "source_file string, row int, waste_type string, kaimai_hash string, dates array<date>"
GROUP = "id string, waste_type string, kaimai_hash string, dates array<date>, dates_hash string, first_date date, last_date date, date_count long, calendar_synced_at timestamp, created_at timestamp, updated_at timestamp"
STREAM = "id string, waste_type string, dates_hash string, dates array<date>, first_date date, last_date date, date_count long, calendar_id string, calendar_synced_at timestamp, pending_clean_started_at timestamp, pending_clean_until timestamp, pending_clean_notice_sent_at timestamp, created_at timestamp, updated_at timestamp"
LINK = "schedule_group_id string, calendar_stream_id string"


def file_rows(seed, n):
    r = random.Random(seed)
    # few patterns, so that streams are shared, split and joined
    return [(f"f{seed}", k, r.choice(["plastikas", "stiklas", ""]), r.choice(["", *(f"k{i}" for i in range(25))]), [D(2026, 1, d) for d in r.choice([[1, 8], [8, 1], [2], [2, 9, 16], [], [5]])]) for k in range(n)]


def state(model):
    groups = sorted((r["id"], r["dates_hash"], r["date_count"]) for r in model.groups.collect())
    streams = sorted((r["id"], r["waste_type"], r["dates_hash"], str(r["first_date"]), r["date_count"], r["pending_clean_started_at"] is not None) for r in model.streams.collect())
    return groups, streams, sorted(map(tuple, model.links.select("schedule_group_id", "calendar_stream_id").collect()))


def test_files(spark):
    now = lambda k: F.lit(f"2026-01-0{k}").cast("timestamp")
    empty = lambda schema: spark.createDataFrame([], schema)
    model = incremental.Model(empty(ROW), empty(GROUP), empty(STREAM), empty(LINK))
    rows = [r for s in (1, 2, 3) for r in file_rows(s, 20)]
    model = incremental.rebuilt(model, spark.createDataFrame(rows, ROW), now(1))
    held = [incremental.store.written(t) for t in (model.rows, model.groups, model.streams, model.links)]
    model = incremental.Model(*held)
    # one file changes a few rows; one is new; one goes
    changed = [(f, k, w, h, d if k % 4 else [D(2026, 2, 1)]) for f, k, w, h, d in file_rows(2, 20)]
    for step, (file, new) in enumerate([("f2", changed), ("f9", [("f9", k, w, h, d) for _, k, w, h, d in file_rows(9, 6)]), ("f1", [])], 2):
        rows = [r for r in rows if r[0] != file] + new
        got, counts = incremental.replace_file(model, file, spark.createDataFrame(new, ROW), now(step))
        want = incremental.rebuilt(model, spark.createDataFrame(rows, ROW), now(step))
        assert state(got) == state(want), file
        assert sorted(map(str, got.rows.collect())) == sorted(map(str, want.rows.collect()))
        assert counts["groups_untouched"] > 0 and counts["streams_touched"] + counts["streams_untouched"] == len(state(model)[1])
        model = incremental.Model(*[incremental.store.written(t) for t in (got.rows, got.groups, got.streams, got.links)])
    # the same file again changes nothing
    again, counts = incremental.replace_file(model, "f9", model.rows.filter("source_file = 'f9'"), now(8))
    assert state(again) == state(model) and counts["groups_changed"] == 0 and counts["streams_touched"] == 0
