"""Substring dedup against brute force on small windows; hashes of runs; odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from calspar.llm import repeats, wordhash
from pyspark.sql import functions as F


def brute(docs, length):
    split = {}
    for k, (doc_id, text) in enumerate(docs):
        split[k] = (doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    first = {}
    for doc_id, w in split.values():
        if doc_id is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, w in split.values():
        gone = set()
        for i in range(len(w) - length + 1):
            if doc_id is not None and first[tuple(w[i : i + length])] < doc_id:
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, seed", [(10, 4), (6, 2), (12, 11)])
def test_against_brute_force(spark, length, seed):
    random.seed(length)
    pool = "a b c d e f Été ß \x1fx 日本 \x85y".split(" ")
    passages = [" ".join(random.choice(pool) + str(random.randrange(9)) for _ in range(random.randint(5, 40))) for _ in range(8)]
    docs = [(k, random.choice([" ", "\n", "\t ", "  "]).join(random.choice(passages) if random.random() < 0.5 else " ".join(random.choice(pool) for _ in range(random.randint(0, 15))) for _ in range(random.randint(0, 6)))) for k in range(120)]
    docs += [(200, "head " * 60), (201, "head " * 90), (202, "head " * 30 + "tail " * 30), (203, None), (204, ""), (None, passages[0] * 2), (7, docs[7][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", F.lit(1)).repartition(5)
    got = sorted(map(tuple, repeats.repeat_digest(table, length, seed).collect()), key=str)
    assert got == brute(docs, length)
    assert sum(r[2] for r in got) > 100


def test_runs_and_minima():
    words = wordhash.Words([b"a b  c\td", b"", b"c d e", b"longer" * 50 + b" A"])
    assert words.n == 9 and words.bounds.tolist() == [0, 4, 4, 7, 9]
    assert words.left().tolist() == [4, 3, 2, 1, 3, 2, 1, 2, 1]
    runs = wordhash.Runs(words)
    assert runs.of(np.array([2]), np.array([4])) == runs.of(np.array([4]), np.array([6]))
    assert words.hash[0] != words.hash[8] and wordhash.Words([b"A"], lower=True).hash[0] == words.hash[0]
    x = np.random.default_rng(0).integers(0, 99, 100).astype(np.uint64)
    for width in (1, 3, 7, 100):
        assert wordhash.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(101 - width)]
    assert wordhash.Words([]).n == wordhash.Words([b""]).n == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeat_digest(empty).count() == 0
    one = spark.createDataFrame([(1, "b a")], "doc_id long, text string")
    assert repeats.remove_repeats(one).first()["text"] == "b a"
