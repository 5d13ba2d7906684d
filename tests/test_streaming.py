"""The sync worker's streams: runs that go on from each other, restarts, late rows, timers."""

import datetime

import pytest
from calspar.streaming import events, queue, runs
from pyspark.sql import functions as F

D, T = datetime.date, datetime.datetime


@pytest.fixture(scope="module")
def own(spark):
    return runs.stateful(spark)


def at(minutes):
    return T(2026, 1, 1, 8) + datetime.timedelta(minutes=minutes)


def row(id_, minutes, calendar=None, synced=None, pending=None, pattern="p1"):
    return (id_, "row", at(minutes), calendar, synced, pending, pattern, None, None)


def result(id_, minutes, pattern, attempt, ok):
    return (id_, "result", at(minutes), None, None, None, pattern, attempt, ok)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run_queue(own, tmp):
    runs.drain(queue.work_queue(runs.arriving(own, f"{tmp}/in", queue.ARRIVAL, 1)), f"{tmp}/log", f"{tmp}/state")
    return own.read.parquet(f"{tmp}/log")


def test_queue(spark, own, tmp_path):
    arrive(spark, tmp_path / "in", [row("a", 0), row("b", 0, "cal", at(0)), row("c", 0, None, None, at(0)), row("a", 0)], queue.ARRIVAL)
    assert [tuple(r) for r in queue.open_items(run_queue(own, tmp_path)).collect()] == [("a", "p1", 1)]
    # b needs sync since a change, a comes again, a stale row of b is passed over
    arrive(spark, tmp_path / "in", [row("b", 5, "cal", None, None, "p2"), row("a", 6), row("b", 1, "cal", at(1), None, "p0")], queue.ARRIVAL)
    log = run_queue(own, tmp_path)
    assert sorted(tuple(r) for r in queue.open_items(log).collect()) == [("a", "p1", 1), ("b", "p2", 1)]
    assert log.filter("event = 'due'").count() == 2
    # nothing has arrived: a run changes nothing
    assert run_queue(own, tmp_path).count() == log.count()
    # b is done; a fails, and a result of another attempt doesn't count
    arrive(spark, tmp_path / "in", [result("b", 10, "p2", 1, True), result("a", 10, "p1", 1, False), result("a", 11, "p1", 7, True)], queue.ARRIVAL)
    assert queue.open_items(run_queue(own, tmp_path)).collect() == []
    # once the watermark has passed half an hour, a is due again
    arrive(spark, tmp_path / "in", [row("z", 200, "cal", at(200))], queue.ARRIVAL)
    assert [tuple(r) for r in queue.open_items(run_queue(own, tmp_path)).collect()] == [("a", "p1", 2)]
    # too late to count: a would no longer need sync
    arrive(spark, tmp_path / "in", [row("a", 7, "cal", at(7))], queue.ARRIVAL)
    arrive(spark, tmp_path / "in", [row("a", 210, None, None, at(210))], queue.ARRIVAL)
    log = run_queue(own, tmp_path)
    assert queue.open_items(log).collect() == []
    assert [r["event"] for r in log.filter("id = 'a'").orderBy("n").collect()] == ["due", "failed", "due", "withdrawn"]


def pattern(stream, minutes, *days):
    return (stream, "pattern", at(minutes), [D(2026, 1, d) for d in days], None, None, None, None, None, None)


def answer(stream, minutes, day, action, attempt, ok):
    return (stream, "result", at(minutes), None, D(2026, 1, day), action, attempt, ok, f"e{day}" if ok else None, None if ok else "no answer")


def run_events(own, tmp, existing, retry_ms=None):
    runs.drain(events.event_log(runs.arriving(own, f"{tmp}/in", events.ARRIVAL, 1), existing, retry_ms=retry_ms), f"{tmp}/log", f"{tmp}/state")
    return own.read.parquet(f"{tmp}/log")


def states(existing, log):
    return {(r["stream"], r["d"].day): (r["status"], r["event_id"], r["error_message"]) for r in events.event_rows(existing, log).collect()}


def test_event_states(spark, own, tmp_path):
    seed = [("s", D(2026, 1, 1), "created", "old1", None), ("s", D(2026, 1, 2), "error", None, "before"), ("s", D(2026, 1, 3), "pending", None, None), ("t", D(2026, 1, 9), "created", "old9", None)]
    existing = own.createDataFrame(seed, events.SEED)
    arrive(spark, tmp_path / "in", [pattern("s", 0, 2, 3, 4), pattern("t", 0)], events.ARRIVAL)
    log = run_events(own, tmp_path, existing)
    todo = {(r["stream"], r["d"].day, r["action"], r["attempt"]) for r in events.open_actions(log).collect()}
    assert todo == {("s", 1, "delete", 1), ("s", 2, "retry", 1), ("s", 4, "add", 1)}
    # results, after a restart; one of an unknown attempt, and a pattern older than the last one
    arrive(spark, tmp_path / "in", [answer("s", 1, 1, "delete", 1, False), answer("s", 1, 2, "retry", 1, True), answer("s", 1, 4, "add", 1, False), answer("s", 2, 4, "add", 9, True), pattern("s", -5, 20)], events.ARRIVAL)
    log = run_events(own, tmp_path, existing)
    assert states(existing, log) == {("s", 2): ("created", "e2", None), ("s", 3): ("pending", None, None), ("s", 4): ("error", None, "no answer"), ("t", 9): ("created", "old9", None)}
    # the same pattern again tries the failed date again, and only that
    arrive(spark, tmp_path / "in", [pattern("s", 3, 2, 3, 4)], events.ARRIVAL)
    log = run_events(own, tmp_path, existing)
    assert [(r["d"].day, r["action"], r["attempt"]) for r in events.open_actions(log).collect()] == [(4, "retry", 2)]
    # wanted again while its deletion is under way: the deletion's late result changes nothing
    arrive(spark, tmp_path / "in", [answer("s", 4, 4, "retry", 2, True), pattern("s", 5, 3, 4)], events.ARRIVAL)
    arrive(spark, tmp_path / "in", [pattern("s", 6, 2, 3, 4), answer("s", 7, 2, "delete", 2, True)], events.ARRIVAL)
    log = run_events(own, tmp_path, existing)
    assert [(r["d"].day, r["action"], r["attempt"]) for r in events.open_actions(log).collect()] == [(2, "add", 3)]
    assert states(existing, log)[("s", 4)] == ("created", "e4", None)


def test_event_timer(spark, own, tmp_path):
    none = own.createDataFrame([], events.SEED)
    arrive(spark, tmp_path / "in", [pattern("s", 0, 2)], events.ARRIVAL)
    run_events(own, tmp_path, none, 1000)
    arrive(spark, tmp_path / "in", [answer("s", 1, 2, "add", 1, False)], events.ARRIVAL)
    assert events.open_actions(run_events(own, tmp_path, none, 1000)).collect() == []
    arrive(spark, tmp_path / "in", [pattern("z", 300, 5)], events.ARRIVAL)
    log = run_events(own, tmp_path, none, 1000).filter("stream = 's'")
    assert [(r["d"].day, r["action"], r["attempt"]) for r in events.open_actions(log).collect()] == [(2, "retry", 2)]
    assert log.select(F.max("n")).first()[0] == 3
