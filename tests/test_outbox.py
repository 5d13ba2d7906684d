"""The sync round: a service that counts what it is sent, rounds that are cut off, and writers that meet."""

import datetime
import os
from pathlib import Path

import pytest
from calspar.operators import outbox, store
from pyspark.sql import functions as F

D = datetime.date
STREAM = "id string, dates array<date>, calendar_id string, calendar_synced_at timestamp, pending_clean_started_at timestamp"
EVENT = "stream string, d date, status string, event_id string, error_message string"


def round_of(versions, service):
    return outbox.sync_round(versions, lambda: Service(service), F.lit("2026-02-01").cast("timestamp"))


class Service:
    """Keeps a line for each message in a folder; fails for some; dies, once, at a chosen message."""

    def __init__(self, root):
        self.root = Path(root)

    def answered(self, keys):
        return {k: (self.root / k).read_text() or None for k in keys if (self.root / k).exists()}

    def send(self, m):
        with (self.root / "calls").open("a") as f:
            f.write(f"{m.stream} {m.action} {m.d} {m.calendar_id}\n")
        if m.stream == "nocal" or m.d == D(2026, 1, 13):
            raise ValueError("refused")
        made = f"cal_{m.name}" if m.action == "create" else f"ev_{m.stream}_{m.d}"
        (self.root / m.key).write_text(made)
        if (self.root / "die").exists() and m.d == D(2026, 1, 5):
            (self.root / "die").unlink()
            os._exit(3)
        return made


def start(spark, root):
    days = lambda *ds: [D(2026, 1, d) for d in ds]
    held = [("a", days(1, 5, 9, 13), None, None, None), ("b", days(2, 3), "cal_b", None, None), ("nocal", days(4), None, None, None), ("done", days(6), "cal_d", datetime.datetime(2026, 1, 1), None), ("empty", [], "cal_e", None, None), ("going", days(7), None, None, datetime.datetime(2026, 1, 1))]
    events = [("b", D(2026, 1, 1), "created", "old1", None), ("b", D(2026, 1, 2), "error", None, "before"), ("done", D(2026, 1, 6), "created", "old6", None), ("empty", D(2026, 1, 8), "created", "old8", None)]
    versions = store.Versions(spark, str(root))
    versions.commit({"streams": spark.createDataFrame(held, STREAM), "events": spark.createDataFrame(events, EVENT)})
    return versions


def tables(versions):
    streams = {r["id"]: (r["calendar_id"], r["calendar_synced_at"] is not None) for r in versions.read("streams").collect()}
    events = {(r["stream"], r["d"].day): (r["status"], r["event_id"], r["error_message"]) for r in versions.read("events").collect()}
    return streams, events


WANT = (
    {"a": ("cal_a", True), "b": ("cal_b", True), "nocal": (None, False), "done": ("cal_d", True), "empty": ("cal_e", True), "going": (None, False)},
    {("a", 1): ("created", "ev_a_2026-01-01", None), ("a", 5): ("created", "ev_a_2026-01-05", None), ("a", 9): ("created", "ev_a_2026-01-09", None), ("a", 13): ("error", None, "refused"),
     ("b", 2): ("created", "ev_b_2026-01-02", None), ("b", 3): ("created", "ev_b_2026-01-03", None), ("done", 6): ("created", "old6", None), ("empty", 8): ("created", "old8", None)},
)


@pytest.mark.parametrize("dies", [False, True])
def test_round(spark, tmp_path, dies):
    versions, service = start(spark, tmp_path / "tables"), tmp_path / "service"
    service.mkdir()
    if dies:
        (service / "die").write_text("")
        with pytest.raises(Exception, match="(?i)python worker|crash|exit"):
            round_of(versions, service)
        assert versions.current() == 1 and not (service / "die").exists()
    counts = {r["stream"]: tuple(r)[1:] for r in round_of(versions, service).collect()}
    assert counts == {"a": (3, 0, 0, 1), "b": (1, 1, 1, 0), "nocal": (0, 0, 0, 1)}
    assert tables(versions) == WANT
    calls = (service / "calls").read_text().splitlines()
    done = [c for c in calls if "nocal" not in c and "2026-01-13" not in c]
    assert len(set(done)) == len(done) == 7  # nothing that was carried out is sent twice
    assert [c for c in calls if c.startswith("a ")][0].startswith("a create") and "a add 2026-01-05 cal_a" in calls
    assert [c.split()[1] for c in done if c.startswith("b ")] == ["delete", "add", "retry"]
    # the next round has only the stream without a calendar to do
    round_of(versions, service)
    assert tables(versions) == WANT
    assert [c for c in (service / "calls").read_text().splitlines()[len(calls) :]] == ["nocal create None None"]


def test_answers_are_kept(spark, tmp_path, monkeypatch):
    """A round that is cut off between the answers and the commit sends nothing when it is run again."""
    versions, service = start(spark, tmp_path / "tables"), tmp_path / "service"
    service.mkdir()
    with monkeypatch.context() as m:
        m.setattr(store.Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            round_of(versions, service)
    calls = (service / "calls").read_text()
    round_of(versions, service)
    assert tables(versions) == WANT and (service / "calls").read_text() == calls


def test_two_writers(spark, tmp_path):
    """The one that commits second loses, and what the first wrote stays whole."""
    versions, other = store.Versions(spark, str(tmp_path / "t")), store.Versions(spark, str(tmp_path / "t"))
    one, two = spark.range(1), spark.range(2)
    versions.commit({"x": one})
    assert versions.read("x").count() == 1
    with pytest.raises(store.Conflict):
        versions.commit({"x": one}, check=lambda _: other.commit({"x": two}))
    assert versions.current() == 2 and versions.read("x").count() == 2 and versions.read("x", 1).count() == 1
    with pytest.raises(ZeroDivisionError):  # fails after the other has committed
        versions.commit({"x": one}, check=lambda _: (other.commit({"x": spark.range(3)}), 1 / 0))
    assert versions.current() == 3 and versions.read("x").count() == 3
    with pytest.raises(store.Conflict):
        versions.commit({"x": one}, base=2)
    # a writer that was cut off while it made its file: the number is passed over
    (tmp_path / "t" / "COMMITTED-4").write_text("")
    assert versions.current() == 3 and versions.commit({"x": spark.range(5)}) == 5 and versions.read("x").count() == 5
