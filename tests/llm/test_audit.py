"""The filter audit against plain counting, and galloping merges against sets."""

import re
from itertools import permutations

import numpy as np
from calspar.llm import audit
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    texts = [t or "" for _, t, _ in docs]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    parts = {}
    for (d, _, source), t in zip(docs, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
                 "E": d is not None and any(e is not None and e < d and u == t for (e, _, _), u in zip(docs, texts))}
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, rows in parts.items():
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                kept = sum(not r[0] & (before | {f}) for r in rows)
                shapley[f] += len(here)
                steps.append((part, order, k + 1, kept, len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def got(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def rows_of(n):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{k}" for k in range(230))
    kinds = ["", "few words", long, long + " #", long.upper(), "one two " * 150, "A B", "aa " * 199, "aa\x0bbb\x1ccc " * 120, "ž" * 98 + "AB", "ž" * 99 + "AB"]
    return [(int(k), kinds[int(rng.integers(len(kinds)))] + ("" if k % 3 else str(k % 7)), f"s{k % 4}" if k % 5 else "hot") for k in rng.permutation(n)]


def test_audit(spark, monkeypatch):
    docs = rows_of(300)
    labels = [(k, k % 2, (k % 7 == 0) + 0) for k in range(0, 300, 2)]
    monkeypatch.setattr(audit, "RANGE_BITS", 4)  # many ranges
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert got(audit.interactions(df, spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_odd_rows(spark):
    """Nulls in every column, equal rows and ids, several labels for a document, a very long text, clashing columns."""
    docs = [(None, "same text", None), (1, "same text", ""), (1, "same text", ""), (2, None, "x"), (3, "", "x"), (None, None, None), (4, "B" * 10, "y"), (4, "x" * 10, "y"), (9, "word " * 200_000 + "end", "y")]
    labels = [(1, None, 1), (1, 1, None), (None, 1, 1), (2, 0, 1), (77, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("p")).withColumn("number", F.lit(1)).withColumn("good", F.lit(True))
    marks = spark.createDataFrame(labels, LABELS).withColumn("first", F.lit(0))
    assert got(audit.interactions(df, marks)) == brute(docs, labels)
    assert audit.interactions(df.limit(0), marks).collect() == []
    assert got(audit.interactions(df, marks.limit(0))) == brute(docs, [])


@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_galloping(a, b):
    x, y = (np.array(sorted(s), dtype=np.int32) for s in (a, b))
    assert audit.difference(x, y).tolist() == sorted(a - b)
    assert audit.union(x, y).tolist() == sorted(a | b)
    assert [v for v, k in zip(x.tolist(), audit.gallop(x, y)) if k] == sorted(a & b)
