"""The source of changed files: what is opened in each run, and what is parsed."""

import os

from calspar.sources import changed
from calspar.streaming import runs
from pyspark.sql import functions as F


def put(path, text, at):
    path.write_text(text)
    os.utime(path, ns=(at * 10**9, at * 10**9))


def test_changed_files(spark, tmp_path):
    own = runs.stateful(spark)
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)

    def run():
        """(name, content, seen) of the files opened in a run."""
        before = os.path.exists(tmp_path / "log") and own.read.parquet(str(tmp_path / "log")).count()
        rows = changed.fetches(changed.changed_files(own, str(folder), str(tmp_path / "listings"), "*.txt")).withColumn("run", F.lit(before or 0))
        runs.drain(rows, str(tmp_path / "log"), str(tmp_path / "state"))
        log = own.read.parquet(str(tmp_path / "log")).filter(F.col("run") == (before or 0))
        return sorted((r["name"], r["content"].decode(), r["seen"]) for r in log.collect())

    put(folder / "a.txt", "a1", 1)
    put(folder / "b.txt", "b1", 1)
    put(folder / "deep" / "c.txt", "c1", 1)
    put(folder / "d.bin", "not of the pattern", 1)
    put(folder / ".hidden.txt", "x", 1)
    assert run() == [("a.txt", "a1", 0), ("b.txt", "b1", 0), ("deep/c.txt", "c1", 0)]
    # nothing has changed; b is told by its tag alone: it isn't opened, or its other text would be seen
    put(folder / "b.txt", "B!", 1)
    assert run() == []
    # a has changed, c was only touched, e is new
    put(folder / "a.txt", "a2", 2)
    put(folder / "deep" / "c.txt", "c1", 2)
    put(folder / "e.txt", "", 2)
    assert run() == [("a.txt", "a2", 0), ("deep/c.txt", "c1", 1), ("e.txt", "", 0)]
    # a is as it was at first, b has gone
    put(folder / "a.txt", "a1", 3)
    (folder / "b.txt").unlink()
    assert run() == [("a.txt", "a1", 1)]


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.txt", bytearray(b"one")), ("2.txt", None)], "name string, content binary")
    changed.write_files(rows, str(tmp_path / "out"))
    changed.write_files(rows.filter("name = 'x/1.txt'").withColumn("content", F.lit("two").cast("binary")), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out" / "x")) == ["1.txt"]
    assert (tmp_path / "out" / "x" / "1.txt").read_text() == "two" and (tmp_path / "out" / "2.txt").read_text() == ""


def test_groups(tmp_path, monkeypatch):
    """Files go to tasks in groups of bounded size."""
    monkeypatch.setattr(changed, "GROUP_BYTES", 10)
    for k, size in enumerate((4, 6, 1, 30, 2)):
        put(tmp_path / f"{k}.txt", "x" * size, 1)
    reader = changed.ChangedReader({"path": str(tmp_path), "state": str(tmp_path / "_listings")})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [[n for n, _ in p.names] for p in parts] == [["0.txt", "1.txt"], ["2.txt"], ["3.txt"], ["4.txt"]]
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


