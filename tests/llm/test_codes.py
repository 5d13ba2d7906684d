"""Vector codes against plain k-means over whole numbers."""

import hashlib
import math

import numpy as np
from calspar.llm import codes, whole
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, width):
    """(vec_id, code, error, label_error, digest) of plain Python, for rows (vec_id, vector, label); width: a part's length."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(1024 * float(np.float32(c))) for c in v]
            kept.append((i, x + [0] * (4 * width - len(x)), label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(v, p)[1], []).append(part(v, p))
            books[p] = [[sum(x) // len(x) for x in zip(*held[e])] if e in held else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in kept:
        found = [near(v, p) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    return sorted(map(str, ((i, c, e, total[label], digest) for i, c, e, label in out)))


def got(df):
    return sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in df.collect())


def test_codes(spark):
    """More rows than entries, few labels, a vector that a third of the rows have, over several partitions."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in (rng.normal(size=8) * 0.2 if k % 3 else np.full(8, -0.1))], k % 4 or None) for k in range(700)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert got(codes.code_digest(df)) == brute(rows, 2)


def test_odd_rows(spark):
    """Nulls, non-finite, short and uneven vectors, repeated rows and ids, a column named like the operator's own."""
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.1] * 5, 1), (3, [0.1] * 5, 1), (3, [-0.2], None), (None, [0.5, 0.25], 1), (1, [], 2), (4, None, 1), (5, [None], 1), (6, [nan], 1), (7, [-inf], 1), (8, [900.0, -900.0], None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("code", F.lit("x")).withColumn("part", F.lit(1)).withColumn("v", F.lit(0))
    assert got(codes.code_digest(df)) == brute(rows, 2)
    assert codes.code_digest(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_balls_are_exact(data):
    """With any entries held so far, balls give what comparing all entries gives, ties included."""
    n, k, dim = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 12)), data.draw(st.integers(1, 3))
    rng = np.random.default_rng(data.draw(st.integers(0, 999)))
    points, entries = whole.exact(dim, rng.integers(-4, 5, (n, dim)), rng.integers(-4, 5, (k, dim)))
    want = codes.all_nearest(points, entries)
    for held in (rng.integers(0, k, n), want[0]):
        have = codes.ball_nearest(points, entries, held)
        assert (have[0] == want[0]).all() and (have[1] == want[1]).all()
