"""A sync round in one chain: plan, messages, what the service answers, and the tables that follow from it.

Messages have keys that follow from the version of the tables and from what is to be done. A round that is cut off and run
again makes the same messages, asks the service which of them it has answered, and sends the others only. The answers are
written down before anything is made of them, so they are asked for once; the tables then change in one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, streams, sync


@dataclass(frozen=True)
class Message:
    """One thing to do. calendar_id is null in a message that creates the calendar only."""

    key: str
    stream: str
    action: str
    d: object
    event_id: str | None
    calendar_id: str | None
    name: str


class Client(Protocol):
    """What a service offers to a task. Both methods may raise; only what `send` raises counts as the service's answer."""

    def answered(self, keys: list[str]) -> dict[str, str | None]:
        """The ids given for those keys that were carried out before."""

    def send(self, message: Message) -> str | None:
        """Carries a message out; the id of the calendar or event that it made, if it made one."""


MESSAGE = "key string, stream string, rank int, action string, d date, event_id string, calendar_id string, name string"
ANSWER = pa.schema([("key", pa.string()), ("stream", pa.string()), ("action", pa.string()), ("d", pa.date32()), ("ok", pa.bool_()), ("event_id", pa.string()), ("error_message", pa.string())])
RANKS = {"create": 0, "delete": 1, "add": 2, "retry": 3}
#: Streams whose messages a task holds at once.
STREAMS = 64


def messages(due: DataFrame, events: DataFrame, version: int) -> DataFrame:
    """The messages of due streams (id, dates, calendar_id, name) for events (stream, d, status, event_id), in the order of `rank` within a stream.

    A stream without a calendar gets one first. One without dates has nothing to be done for its events.
    """
    desired = due.select(F.col("id").alias("stream"), F.explode("dates").alias("d"))
    todo = sync.plan(desired, events).join(events.select("stream", "d", "event_id"), ["stream", "d"], "left")
    todo = todo.join(due.select(F.col("id").alias("stream"), "calendar_id", "name"), "stream")
    create = due.filter("calendar_id is null").select(F.col("id").alias("stream"), F.lit(None).cast("date").alias("d"), F.lit("create").alias("action"), F.lit(None).cast("string").alias("event_id"), "calendar_id", "name")
    every = create.unionByName(todo)
    key = F.sha2(F.concat_ws("|", F.lit(str(version)), "stream", "action", F.coalesce(F.col("d").cast("string"), F.lit(""))), 256)
    rank = F.coalesce(*[F.when(F.col("action") == a, k) for a, k in RANKS.items()])
    return every.select(key.alias("key"), "stream", rank.alias("rank"), "action", "d", "event_id", "calendar_id", "name")


def send(todo: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """(key, stream, action, d, ok, event_id, error_message) for every message that was sent, now or by a task that was lost.

    A stream's messages go in order from one task, whose client is made once. Those of a stream that gets no calendar
    aren't sent and have no row. Each reading of the result sends: write it down.
    """

    def answers(service: Client, held: list[Message]) -> Iterator[tuple]:
        known = service.answered([m.key for m in held])
        made: dict[str, str | None] = {}
        lost: set[str] = set()
        for m in held:
            if m.stream in lost:
                continue
            if m.stream in made:
                m = Message(m.key, m.stream, m.action, m.d, m.event_id, made[m.stream], m.name)
            ok, given, error = True, None, None
            if m.key in known:
                given = known[m.key]
            else:
                try:
                    given = service.send(m)
                except Exception as e:  # the service's answer, whatever it is
                    ok, error = False, str(e)
            if m.action == "create":
                made[m.stream] = given
                if not ok:
                    lost.add(m.stream)
            yield m.key, m.stream, m.action, m.d, ok, given, error

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = client()
        held: list[Message] = []
        seen: set[str] = set()

        def told() -> pa.RecordBatch:
            rows = list(answers(service, held))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWER)], schema=ANSWER)

        for batch in batches:
            for key, stream, _, action, d, event_id, calendar_id, name in zip(*(c.to_pylist() for c in batch.columns)):
                if stream not in seen and len(seen) == STREAMS:
                    yield told()
                    held, seen = [], set()
                seen.add(stream)
                held.append(Message(key, stream, action, d, event_id, calendar_id, name))
        if held:
            yield told()

    dealt = todo.repartition("stream").sortWithinPartitions("stream", "rank", "d")
    return dealt.mapInArrow(work, "key string, stream string, action string, d date, ok boolean, event_id string, error_message string")


def after(held_streams: DataFrame, events: DataFrame, due: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(streams, events) once the answers are in. A stream that has a calendar is synced, whether all its events worked or not."""
    made = answers.filter("action = 'create' and ok").select(F.col("stream").alias("id"), F.col("event_id").alias("made"))
    round_ = due.select("id").join(made, "id", "left").withColumn("in_round", F.lit(True))
    joined = held_streams.join(round_, "id", "left")
    calendar = F.coalesce("calendar_id", "made")
    synced = F.when(F.col("in_round") & calendar.isNotNull(), now).otherwise(F.col("calendar_synced_at"))
    new = {"calendar_id": calendar, "calendar_synced_at": synced}
    streams_after = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in held_streams.columns])
    results = answers.filter("action <> 'create'")
    return streams_after, sync.apply_results(events.drop("updated_at"), results, now)


def sync_round(versions: store.Versions, client: Callable[[], Client], now: Column, names: Column | None = None) -> DataFrame:
    """One round over the tables `streams` and `events`; gives (stream, added, deleted, retried, failed) of the streams that messages went out for.

    names: an expression over streams for the calendars to be made, their id if null. The answers of a round stay in
    `answers-<version>` beside the tables; a round that was cut off after it wrote them goes on from there.
    """
    spark, base = versions.spark, versions.current()
    held, events = versions.read("streams", base), versions.read("events", base)
    due = streams.needing_sync(held).withColumn("name", names if names is not None else F.col("id"))
    folder = f"{versions.root}/answers-{base}"
    if not versions.holds(f"{folder}/_SUCCESS"):
        send(messages(due, events, base), client).write.mode("overwrite").parquet(folder)
    answers = spark.read.parquet(folder)
    streams_after, events_after = after(held, events, due, answers, now)
    versions.commit({"streams": streams_after, "events": events_after}, base=base)
    worked = lambda a: F.count_if((F.col("action") == a) & F.col("ok"))
    return answers.groupBy("stream").agg(worked("add").alias("added"), worked("delete").alias("deleted"), worked("retry").alias("retried"), F.count_if(~F.col("ok")).alias("failed"))
