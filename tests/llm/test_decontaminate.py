"""Decontamination against brute force, with a table of bits that tells little, too; long texts and shared passages."""

import hashlib
import random
import re

import pytest
from calspar.llm import decontaminate as d

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    def split(t):
        return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for item_id, item in items:
            for win in d.windows_of(split(item)):
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [26, 7])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(d, "TABLE_BITS", bits)
    random.seed(4)
    pool = ["the", "of", "Über", "x1", "日本", "rare", "a", "b", "c"]
    items = [(k, " ".join(random.choice(pool) for _ in range(random.choice([0, 1, 3, 9, 10, 14])))) for k in range(9)] + [(10, None), (2, "the the, THE")]
    docs = [(k, " - ".join(random.choice(pool) for _ in range(random.choice([0, 2, 30, 200]))), "n") for k in range(40)]
    docs += [(100 + k, f"pre_{random.choice(pool)} {items[k][1] or ''} {items[k][1] or ''} tail\n", "n") for k in range(9)] + [(200, None, "n"), (7, docs[7][1], "n")]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.contamination(table, bench).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    kept = {r["doc_id"] for r in d.keep_uncontaminated(table, bench).collect()}
    assert kept == {r[0] for r in want if not r[5]} and d.keep_uncontaminated(table, bench).columns == table.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in d.contamination(docs, bench).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (2, 0, 0, none, False), None: (0, 0, 0, none, False)}
    assert d.contamination(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).count() == 0


def test_long_text_and_shared_passage(spark):
    """A passage that all items share, in a text of 100,000 words and in many copies, with columns named like the operator's own."""
    shared = [f"s{k}" for k in range(30)]
    items = [(k, " ".join([f"i{k}a", *shared, f"i{k}b"])) for k in range(50)]
    long_text = " ".join([*(f"w{k % 977}" for k in range(60_000)), *shared, *(f"w{k % 977}" for k in range(40_000))])
    docs = [(1, long_text)] + [(2 + k, " ".join(shared)) for k in range(100)] + [(500, " ".join(shared[:9]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k1", "'x' as words", "2 as `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in d.contamination(table, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (100_030, 30, 50) and got[2]["n_hit"] == 30 and not got[500]["contaminated"]
    assert got[1]["items_sha256"] == hashlib.sha256(",".join(sorted(str(k) for k in range(50))).encode()).hexdigest()
    kept = d.keep_uncontaminated(table, bench)
    assert kept.columns == table.columns and [r["doc_id"] for r in kept.collect()] == [500]
