"""Smaller parts that no registered query shows: writes by partition, values of keys, orders, times, selections."""

import datetime

import pytest
from calspar.functions import dates
from calspar.operators import lookup, store, streams
from pyspark.sql import functions as F

D, T = datetime.date, datetime.datetime


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, source_file string")
    store.replace_partition(rows((1, "a"), (2, "a"), (3, "b")), path)
    store.replace_partition(rows((9, "a")), path)
    assert sorted((r["id"], r["source_file"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_appends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ąž"), (2, None)], "id int, name string")
    for k in range(2):
        store.append(rows, str(tmp_path / "p"))
        store.append_json(rows, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert sorted((r["id"], r["name"]) for r in spark.read.schema("id int, name string").json(str(tmp_path / "j")).collect()) == [(1, "ąž"), (1, "ąž"), (2, None), (2, None)]


def test_set_value(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    changed, hit = store.set_value(table, "id", "b", n=F.lit(7), s=F.lit(None).cast("string"))
    assert hit and sorted(map(tuple, changed.collect())) == [("a", 1, "x"), ("b", 7, None)]
    same, hit = store.set_value(table, "id", "none", n=F.lit(7))
    assert not hit and sorted(map(tuple, same.collect())) == [("a", 1, "x"), ("b", 2, "y")]


def test_orders(spark):
    locations = spark.createDataFrame([("S", "V", "B"), ("S", "V", ""), ("S", "V", "A"), ("S", "V", "A"), ("R", "W", "C")], "seniunija string, village string, street string")
    assert [tuple(r) for r in lookup.streets_of_villages(locations).collect()] == [("R", "W", "C"), ("S", "V", ""), ("S", "V", "A"), ("S", "V", "B")]
    queue = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "id string, updated_at int")
    assert [r["id"] for r in streams.in_order(queue).collect()] == ["b", "c", "a"]


def test_times(spark):
    days = spark.createDataFrame([(D(2026, 1, 8),), (D(2026, 7, 1),)], "d date")
    start, end = dates.event_times(F.col("d"))
    got = days.select("d", F.date_format(start, "yyyy-MM-dd HH:mm").alias("s"), F.date_format(end, "HH:mm").alias("e"), dates.grid_offset(F.col("d")).alias("g")).orderBy("d").collect()
    # winter and summer time of the zone, shown in UTC; January 2026 begins on a Thursday, July on a Wednesday
    assert [tuple(r)[1:] for r in got] == [("2026-01-08 05:00", "07:00", 3), ("2026-07-01 04:00", "06:00", 2)]


def test_notices(spark):
    held = spark.createDataFrame([("a", "cal", T(2026, 1, 8, 15)), ("b", None, T(2026, 1, 8)), ("c", "cal2", None)], "id string, calendar_id string, pending_clean_started_at timestamp")
    got = streams.cleanup_notices(held).orderBy("d").select("id", "d", F.date_format("start", "HH:mm").alias("s"), F.date_format("end", "HH:mm").alias("e")).collect()
    assert [tuple(r) for r in got] == [("a", D(2026, 1, d), "07:00", "09:00") for d in (8, 9, 10)]
    none = F.lit(None).cast("timestamp")
    marked = streams.notices_sent(held.withColumn("pending_clean_notice_sent_at", none).withColumn("updated_at", none), spark.createDataFrame([("a",), ("a",)], "id string"), F.lit("2026-01-09").cast("timestamp"))
    assert {r["id"]: (r["pending_clean_notice_sent_at"] is not None, r["updated_at"] is not None) for r in marked.collect()} == {"a": (True, True), "b": (False, False), "c": (False, False)}


def test_open_streams(spark):
    held = spark.createDataFrame([("a", "x", "h", 1, None), ("b", "x", "h", 2, None), ("c", "x", "h", 0, 5), ("d", "x", "", 0, None)], "id string, waste_type string, dates_hash string, created_at int, pending_clean_started_at int")
    assert [r["stream_id"] for r in streams.open_streams(held).collect()] == ["a"]
    assert [r["stream_id"] for r in streams.open_streams(held, exclude="a").collect()] == ["b"]


def test_selections():
    assert lookup.check_selection(True, True, "A", "1") == ("A", "1")
    assert lookup.check_selection(False, False, None, None) == ("", None)
    for given in ((True, False, None, None), (False, True, "A", None)):
        with pytest.raises(lookup.SelectionError):
            lookup.check_selection(*given)
