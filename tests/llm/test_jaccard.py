"""Jaccard join against brute force; components; odd rows."""

import random
import re

import numpy as np
import pytest
from calspar.llm import components, jaccard
from pyspark.sql import functions as F


def brute(docs, n, percent):
    def shingles(t):
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("n, percent, more", [(2, 75, 64), (3, 60, 2), (1, 80, 8)])
def test_against_brute_force(spark, monkeypatch, n, percent, more):
    monkeypatch.setattr(jaccard, "MORE", more)
    random.seed(n)
    pool = [f"{a}{b}" for a in "aBcdÉ" for b in "vwxyz1"]
    bases = [[random.choice(pool) for _ in range(random.randint(1, 40))] for _ in range(12)]
    docs = []
    for k in range(150):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
            w[random.randrange(len(w))] = random.choice(pool)
        docs.append((k * 3, random.choice([" ", "\n", " \t"]).join(w if random.random() < 0.7 else [x.upper() if x.isascii() else x for x in w])))
    docs += [(1, None), (2, ""), (4, " \n "), (None, docs[0][1]), (docs[5][0], docs[5][1]), (5, "one"), (7, "one"), (8, "ONE")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x")).repartition(6)
    got = sorted(map(tuple, jaccard.similar_components(table, n, percent).collect()), key=str)
    assert got == brute(docs, n, percent)
    kept = jaccard.keep_one(table, n, percent)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _, c in got if d == c)


def test_bounds_decide_without_comparison(spark):
    known = spark.createDataFrame([(1, 9, 100, 100, 99, 100, 98), (2, 9, 100, 100, 97, 100, 97), (3, 9, 100, 100, 90, 100, 20)], "x long, y long, m int, n int, p int, q int, both int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "x long, y long")
    assert {tuple(r) for r in jaccard.derived(pairs, known, 75).collect()} == {(1, 2, True), (1, 3, False), (1, 4, None)}


def test_long_texts_and_clashing_columns(spark):
    """A text of 60,000 words, its copy less a tenth, and columns named like the operator's own, one with a dot."""
    random.seed(4)
    words = [f"w{random.randrange(10**6)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:54_000])), (3, " ".join(words[:30_000])), (4, "w1 " * 50_000), (5, "w1 " * 40_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("component", F.lit("c")).withColumn("a.b", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(table, 5, 75).collect()}
    assert got == {1: (59_996, 1), 2: (53_996, 1), 3: (29_996, 3), 4: (1, 4), 5: (1, 4)}
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_group_without_a_centre(spark):
    """Copies of a text that isn't there itself, each with changes of its own: links by brute force, lists stay open for several turns."""
    random.seed(9)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(random.choice([1, 2, 3, 4, 5])):
            w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
        docs.append((k, " ".join(w)))
    got = sorted(map(tuple, jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 75).collect()), key=str)
    assert got == brute(docs, 3, 75)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(30)] + [(500, 500), (60, 200), (200, 250)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 131)) and got[250] == got[200] == 60
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_components(empty).count() == 0
    one = spark.createDataFrame([(3, "a b c d e f g")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.similar_components(one).collect()] == [(3, 3, 3)]


def test_shingles_are_sets_of_words():
    sets = jaccard.Shingles([b"a b a b a b", b"", b"x", b"A B a"], 2)
    assert np.diff(sets.bounds).tolist() == [2, 0, 1, 2] and set(sets.values[:2]) == set(sets.values[3:])
