"""Line dedup against brute force, odd rows, and native plans."""

import hashlib
import random

from calspar.llm import lines
from pyspark.sql import functions as F


def within(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    seen = []
    for doc_id, text in docs:
        for i, l in enumerate(text.split("\n") if text is not None else []):
            w = l.lower().strip(" ").split(" ")
            if w != [""]:
                seen.append(((doc_id, i), w))
    first = {}
    for at, w in sorted(seen):
        first.setdefault(tuple(w), at)
    near = {w for w, at in first.items() if len(w) >= 8 and any(len(v) >= 8 and b < at and within(list(w), list(v)) for v, b in first.items())}
    out = []
    for doc_id, text in docs:
        ls = text.split("\n") if text is not None else []
        kept = [l for i, l in enumerate(ls) for w in [tuple(l.lower().strip(" ").split(" "))] if w == ("",) or (first[w] == (doc_id, i) and w not in near)]
        out.append((doc_id, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    random.seed(8)
    pool = "one two three four five six seven eight nine ten Été ß".split()
    base = [" ".join(random.choice(pool) for _ in range(random.choice([1, 2, 3, 7, 8, 9, 12, 20]))) for _ in range(40)]

    def edited(l):
        w = l.split(" ")
        k = random.randrange(len(w) + 1)
        return " ".join(random.choice([w, w[:k] + ["new"] + w[k:], w[:k] + w[k + 1 :], w[:k] + [random.choice(pool)] + w[k + 1 :], w[:k] + ["a", "b"] + w[k:]]))

    docs = [(k, "\n".join(random.choice([random.choice(base), edited(random.choice(base)), "", "  " + random.choice(base).upper() + " "]) for _ in range(random.randint(0, 12)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "head " * 3000 + "\n" + "head " * 2999 + "tail")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("flags", F.lit("clash")).repartition(4)
    got = sorted(map(tuple, lines.line_digest(table).collect()))
    assert got == brute(docs)
    assert any(r[2] for r in got)
    out = lines.dedup_lines(table)
    assert out.columns == table.columns and {r["flags"] for r in out.collect()} == {"clash"}


def test_odd_rows(spark):
    same = "the very same line stands here in both of them\nand a line of its own kind that nobody else has"
    rows = [(1, same, 5), (1, same, 5), (None, same, 5), (2, same, 5), (3, None, 0), (4, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, lines.line_digest(docs).select("doc_id", "n_lines", "n_removed").collect()), key=str)
    assert got == sorted([(None, 2, 0), (1, 2, 2), (1, 2, 2), (2, 2, 2), (3, 0, 0), (4, 1, 0)], key=str)
    left = {(r["doc_id"], r["n_chars"]) for r in lines.dedup_lines(docs).collect()}
    assert left == {(None, len(same)), (3, None), (4, 0)}
    assert lines.line_digest(docs.limit(0)).count() == 0


def test_bound_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two three 4"), (3, "one 2 3 4"), (4, "}"), (5, "}\n\n")], "doc_id long, text string")
    removed = lambda n: {r["doc_id"]: r["n_removed"] for r in lines.line_digest(docs, n).collect()}
    assert removed(4) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    assert removed(5) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_clashing_columns(spark):
    names = ["doc_id", "text", "row", "k", "lost", "line", "h1", "h2", "first", "near", "a.b"]
    docs = spark.createDataFrame([(1, "same line\nx", *"abcdefghi"), (2, "same line\ny", *"abcdefghi")], names)
    out = lines.dedup_lines(docs)
    assert out.columns == names and sorted(r["text"] for r in out.collect()) == ["same line\nx", "y"]


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.line_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
