"""The work queue as a stream: which calendar streams are due for sync, each pattern once, failed ones again after a while.

What arrives are rows of calendar streams as they change, and results of syncs. The state of a stream is small: the time
of its last row, whether an item is open for it, of which pattern and at which attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runs import last_rows, micros, moment

#: A failed item is due again after so many milliseconds.
RETRY_MS = 1800 * 1000

ARRIVAL = "id string, kind string, at timestamp, calendar_id string, calendar_synced_at timestamp, pending_clean_started_at timestamp, dates_hash string, attempt int, ok boolean"
ITEM = "id string, dates_hash string, event string, attempt int, at timestamp, n long"
HELD = "at long, dates_hash string, open boolean, attempt int, n long"


class WorkQueue(StatefulProcessor):
    """Per stream: `due` when it needs sync and isn't waiting with this pattern, `withdrawn` when it no longer does, `done` or, on failure, `due` again later.

    Rows older than the last one are passed over, and so are results of other patterns or attempts than the open one.
    """

    def __init__(self, retry_ms: int = RETRY_MS):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, pattern, is_open, attempt, n = self.held.get() if self.held.exists() else (None, None, False, 0, 0)
        out = []

        def tell(event: str, when) -> None:
            nonlocal n
            n += 1
            out.append(Row(id=key[0], dates_hash=pattern, event=event, attempt=attempt, at=when, n=n))

        for r in sorted(rows, key=lambda r: (r.at, r.kind)):
            if r.kind == "result":
                if is_open and (r.dates_hash, r.attempt) == (pattern, attempt):
                    if r.ok:
                        is_open = False
                        tell("done", r.at)
                    else:
                        tell("failed", r.at)
                        self.handle.registerTimer(micros(r.at) // 1000 + self.retry_ms)
            elif at is None or micros(r.at) >= at:
                at = micros(r.at)
                needs = (r.calendar_id is None or r.calendar_synced_at is None) and r.pending_clean_started_at is None
                if needs and not (is_open and pattern == r.dates_hash):
                    pattern, is_open, attempt = r.dates_hash, True, 1
                    tell("due", r.at)
                elif not needs and is_open:
                    is_open = False
                    tell("withdrawn", r.at)
        self.held.update((at, pattern, is_open, attempt, n))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, pattern, is_open, attempt, n = self.held.get()
        if is_open:
            when = moment(expiredTimerInfo.getExpiryTimeInMs() * 1000)
            self.held.update((at, pattern, is_open, attempt + 1, n + 1))
            yield Row(id=key[0], dates_hash=pattern, event="due", attempt=attempt + 1, at=when, n=n + 1)

    def close(self) -> None:
        pass


def work_queue(arrivals: DataFrame, delay: str = "1 hour", retry_ms: int = RETRY_MS) -> DataFrame:
    """The log (id, dates_hash, event, attempt, at, n) of a stream of ARRIVAL rows; rows later than `delay` are dropped. n numbers a stream's rows from 1."""
    return arrivals.withWatermark("at", delay).groupBy("id").transformWithState(WorkQueue(retry_ms), ITEM, "append", "eventTime")


def open_items(log: DataFrame) -> DataFrame:
    """(id, dates_hash, attempt) of what is due and not yet answered."""
    return last_rows(log, ["id"]).filter("event = 'due'").select("id", "dates_hash", "attempt")
