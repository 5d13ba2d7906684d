"""Exact top-k search against brute force."""

import math

import numpy as np
from calspar.llm import kdtree
from hypothesis import given, settings
from hypothesis import strategies as st

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20, scale=64):
    """Answers of plain Python, for rows (vec_id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for m, (i, b) in enumerate(kept) if m != n)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in df.collect())


def test_search_is_exact(spark):
    """Several shards and leaves, ties, a vector that a third of the rows have."""
    rng = np.random.default_rng(5)
    rows = [(k, np.float32(rng.normal(size=6) * 0.3).tolist()) for k in range(900)]
    rows = [(k, [0.5, 0.25, 0.0, -0.5, 0.125, 0.3]) if k % 3 == 1 else r for k, r in enumerate(rows)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS).repartition(4)
    assert got(kdtree.top_k(df, shard_rows=100, leaf=8)) == brute(rows)
    assert got(kdtree.top_k(df)) == brute(rows)


def test_odd_rows(spark):
    """Nulls everywhere, non-finite and short and huge vectors, repeated rows and ids, clashing columns, fewer than k rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0]), (20, []), (None, [1.0, 2.0]), (3, None), (40, [None, 1.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [-1.5, 0.01]), (-20, [3.0, 3.0]), (7, [1e18, -1e18]), (120, [-1e18, 1e18])]
    df = spark.createDataFrame([(*r, None) for r in rows], ROWS)
    from pyspark.sql import functions as F

    df = df.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("v", F.lit(2)).withColumn("shard", F.lit(None))
    limit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    exact = [(i, v) for i, v in rows]
    want = []
    kept = [(i, [limit(math.floor(64 * float(np.float32(x)))) for x in v]) for i, v in exact if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (q, a) in enumerate(kept):
        if q is not None and q % 20 == 0:
            scored = sorted((-limit(sum(x * y for x, y in zip(a, b))), i is None, i or 0) for m, (i, b) in enumerate(kept) if m != n)
            want += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:20])]
    assert got(kdtree.top_k(df)) == sorted(map(str, want))
    assert kdtree.top_k(df.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_tree_search(data):
    """The search inside one shard, with a limit from elsewhere, for any small vectors."""
    n, dim, k = data.draw(st.integers(1, 40)), data.draw(st.integers(1, 3)), data.draw(st.integers(1, 5))
    rng = np.random.default_rng(data.draw(st.integers(0, 999)))
    vectors, ids = rng.integers(-2, 3, (n, dim)), rng.permutation(60)[:n]
    order = kdtree.tree_order(vectors, ids, 3)
    tree = kdtree.tree_of(vectors[order], ids[order], 3)
    queries = rng.integers(-2, 3, (7, dim))
    best = kdtree.Best.none(7, k)
    best.limit[:], best.limit_id[:] = -1, 30
    kdtree.search(tree, queries, best)
    for q in range(7):
        s = vectors @ queries[q]
        want = sorted((-s[j], ids[j]) for j in range(n) if s[j] > -1 or (s[j] == -1 and ids[j] < 30))[:k]
        assert [(-a, b) for a, b in zip(best.scores[q], best.ids[q]) if a != kdtree.whole.LEAST] == want


def test_boxes_are_left_out():
    """On clustered rows most leaves are never opened."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-100, 100, (32, 8))
    vectors = np.repeat(centres, 64, axis=0) + rng.integers(-2, 3, (2048, 8))
    ids = np.arange(2048)
    order = kdtree.tree_order(vectors, ids, 16)
    tree = kdtree.tree_of(vectors[order], ids[order], 16)
    queries = centres[:4].astype(np.int64)
    best = kdtree.Best.none(4, 5)
    kdtree.search(tree, queries, best)
    bounds = kdtree.box_bounds(queries, tree.low[-1], tree.high[-1])
    assert (bounds >= best.scores[:, -1:]).mean() < 0.2
