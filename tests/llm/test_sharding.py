"""Shards hold every row once, equal texts together, with gapless slots."""

import zlib
from collections import defaultdict

from calspar.llm import sharding
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def test_shards(spark):
    texts = ["a" * (7 * k % 41) for k in range(200)] + ["same"] * 30 + [None, "", "žąsis", "b" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = sharding.shard_documents(docs, 16).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == zlib.crc32(data) and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 16).count() == 0


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, a hot text, a long one, and columns named like the operator's own."""
    rows = [(None, "x"), (1, "x"), (1, "x"), (1, "y"), (2, None), (3, "")] + [(10 + k, "hot text " * 9) for k in range(400)] + [(900, "long " * 200_000)] + [(1000 + k, f"text {k} " * 60) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("group", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("a.b", F.lit(0)).repartition(5)
    out = sharding.shard_documents(docs, 16).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(d), len((t or "").encode()) + 1) for d, t in rows)
    slots, load = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in out if r["size"] == 82}) == 1
    giant = next(r["shard"] for r in out if r["size"] > 10**6)
    even = sum(v for k, v in load.items() if k != giant) / 15
    assert len(slots[giant]) == 1 and max(v for k, v in load.items() if k != giant) < max(1.5 * even, 400 * 82 + 1000)


def test_native_plan(spark):
    plan = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "b")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
