"""The states of calendar events as a stream: pending, created, error and retry of every date of every calendar stream.

What arrives are patterns (the dates that a stream should have) and results of actions. A pattern is compared with the dates
held in the state: dates that it lacks are to be deleted, new ones added, those in error tried again. The log names the
actions to carry out and the states that results lead to. The table of events that are there already seeds the state.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runs import last_rows, micros, moment

ARRIVAL = "stream string, kind string, at timestamp, dates array<date>, d date, action string, attempt int, ok boolean, event_id string, error_message string"
#: What the state is told of a row; each column of each row costs time in Python.
TOLD = ["stream", "kind", "at", "dates", "d", "attempt", "ok", "event_id", "error_message"]
LOG = "stream string, d date, action string, status string, event_id string, error_message string, attempt int, at timestamp, n long"
HELD = "at long, n long, dates array<struct<d: int, status: string, event_id: string, error_message: string, attempt: int>>"
SEED = "stream string, d date, status string, event_id string, error_message string"


class EventStates(StatefulProcessor):
    """Per stream the states of its dates. A pattern older than the last one, and a result of another attempt than the last one, are passed over.

    They are one value, read once a batch and written once if it changes: each call to the state is an exchange with the JVM.
    A deleted date goes once its result is there, whether the deletion worked or not. With `retry_ms` dates in error are
    tried again so long after the failure, else only when a pattern comes that still has them.
    """

    def __init__(self, retry_ms: int | None = None):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def read(self) -> tuple:
        """The time of the last pattern, the number of the last row, and the state of each date."""
        at, n, dates = self.held.get() or (None, 0, ())
        return at, n, {datetime.date.fromordinal(d): tuple(value) for d, *value in dates}

    def write(self, at: int | None, n: int, held: dict) -> None:
        self.held.update((at, n, [(d.toordinal(), *value) for d, value in held.items()]))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.write(None, 0, {x["d"]: (x["status"], x["event_id"], x["error_message"], 0) for x in initialState.dates})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, n, held = self.read()
        at, out = last, []
        for _, kind, when, dates, d, attempt, ok, event_id, message in sorted(rows, key=itemgetter(2, 1)):
            if kind != "pattern":
                changes = self.answered(held, d, attempt, when, ("created", event_id, None) if ok else ("error", None, message))
            elif at is None or micros(when) >= at:
                at = micros(when)
                changes = self.compared(held, set(dates or ()))
            else:
                changes = []
            for d, action, value in changes:
                n += 1
                if value[0] == "deleted":
                    held.pop(d)
                else:
                    held[d] = value
                out.append(Row(stream=key[0], d=d, action=action, status=value[0], event_id=value[1], error_message=value[2], attempt=value[3], at=when, n=n))
        if out or at != last:
            self.write(at, n, held)
        yield from out

    def compared(self, held: dict, wanted: set) -> list[tuple]:
        """(date, action, new state) where a pattern differs from what is held; without dates nothing is to be done."""
        if not wanted:
            return []
        out = [(d, "delete", ("leaving", v[1], v[2], v[3] + 1)) for d, v in held.items() if d not in wanted and v[0] != "leaving"]
        for d in wanted:
            if d not in held:
                out.append((d, "add", ("pending", None, None, 1)))
            elif held[d][0] == "leaving":
                out.append((d, "add", ("pending", None, None, held[d][3] + 1)))
            elif held[d][0] == "error":
                out.append((d, "retry", ("retry", None, held[d][2], held[d][3] + 1)))
        order = {"delete": 0, "add": 1, "retry": 2}
        return sorted(out, key=lambda x: (order[x[1]], x[0]))

    def answered(self, held: dict, d: datetime.date, attempt: int, when: datetime.datetime, result: tuple) -> list[tuple]:
        status, _, _, last = held.get(d, (None,) * 4)
        if status not in ("pending", "retry", "leaving") or last != attempt:
            return []
        if status == "leaving":
            return [(d, None, ("deleted", None, None, attempt))]
        if result[0] == "error" and self.retry_ms is not None:
            self.handle.registerTimer(micros(when) // 1000 + self.retry_ms)
        return [(d, None, (*result, attempt))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, n, held = self.read()
        when = moment(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        out = []
        for d, v in sorted((d, v) for d, v in held.items() if v[0] == "error"):
            n += 1
            held[d] = ("retry", None, v[2], v[3] + 1)
            out.append(Row(stream=key[0], d=d, action="retry", status="retry", event_id=None, error_message=v[2], attempt=v[3] + 1, at=when, n=n))
        if out:
            self.write(at, n, held)
        yield from out

    def close(self) -> None:
        pass


def event_log(arrivals: DataFrame, existing: DataFrame | None = None, delay: str = "1 hour", retry_ms: int | None = None) -> DataFrame:
    """The log of a stream of ARRIVAL rows; existing (stream, d, status, event_id, error_message) seeds the state in the first run. Rows later than `delay` are dropped."""
    seed = existing.groupBy("stream").agg(F.collect_list(F.struct("d", "status", "event_id", "error_message")).alias("dates")).groupBy("stream") if existing is not None else None
    return arrivals.select(TOLD).withWatermark("at", delay).groupBy("stream").transformWithState(EventStates(retry_ms), LOG, "append", "eventTime", initialState=seed)


def open_actions(log: DataFrame) -> DataFrame:
    """(stream, d, action, attempt) of the actions that have no result yet."""
    return last_rows(log, ["stream", "d"]).filter("action is not null").select("stream", "d", "action", "attempt")


def event_rows(existing: DataFrame, log: DataFrame) -> DataFrame:
    """(stream, d, status, event_id, error_message) of all dates that are there: the log's last state, or what was there before."""
    last = last_rows(log, ["stream", "d"])
    untouched = existing.join(last.select("stream", "d"), ["stream", "d"], "left_anti").select("stream", "d", "status", "event_id", "error_message")
    return untouched.unionByName(last.filter(F.col("status") != "deleted").select("stream", "d", "status", "event_id", "error_message"))
