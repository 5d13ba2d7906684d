"""How often the stream of events asks its state: once a stream and batch, however many dates the stream has."""

import datetime

from calspar.streaming import events
from pyspark.sql import Row

DAYS = [datetime.date(2026, 1, k + 1) for k in range(30)]


class Handle:
    """One value kept in memory, with a count of the calls; other states aren't to be had."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def told(minute, kind, **filled):
    return Row(*events.TOLD)(*[({"stream": "s", "kind": kind, "at": datetime.datetime(2026, 1, 1, 8, minute)} | filled).get(c) for c in events.TOLD])


def test_one_read_and_one_write_a_batch():
    states, handle = events.EventStates(), Handle()
    states.init(handle)
    states.handleInitialState(("s",), Row(stream="s", dates=[{"d": d, "status": "created", "event_id": "old", "error_message": None} for d in DAYS[:10]]), None)
    assert handle.calls == ["update"]
    log = list(states.handleInputRows(("s",), iter([told(0, "pattern", dates=DAYS[5:])]), None))
    assert [(r.action, r.d.day) for r in log] == [("delete", k) for k in range(1, 6)] + [("add", k) for k in range(11, 31)]
    assert handle.calls == ["update", "get", "update"]
    results = [told(1, "result", d=r.d, attempt=r.attempt, ok=r.d.day % 2 == 0, event_id="new", error_message="no answer") for r in log]
    log = list(states.handleInputRows(("s",), iter(results), None))
    assert [(r.d.day, r.status) for r in log] == [(k, "deleted") for k in range(1, 6)] + [(k, "error" if k % 2 else "created") for k in range(11, 31)]
    assert [r.n for r in log] == list(range(26, 51))
    assert handle.calls == ["update", "get", "update"] + ["get", "update"]
    # the same results again change nothing, and nothing is written
    assert list(states.handleInputRows(("s",), iter(results), None)) == []
    assert handle.calls[5:] == ["get"]
    assert [d for d, *_ in handle.value[2]] == [d.toordinal() for d in DAYS[5:]]
