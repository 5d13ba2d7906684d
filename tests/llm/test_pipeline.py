"""The pipeline's stages on a small table, each held against a plain reading of what it does."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from calspar.llm import decontaminate, quality
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_lines import brute as brute_lines
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], DATA).write.parquet(str(tmp_path / str(k)))
        outs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(o.columns == columns for o in outs[:-1])
    rows = [{r["doc_id"]: r for r in o.collect()} for o in outs[:-1]]

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality.learned(docs, labels)
    stats = quality.with_statistics(docs.select("doc_id", "text"), "text").collect()
    score = rules.score(np.array([tuple(r["s"]) for r in stats]))
    assert set(rows[1]) == {r["doc_id"] for r, s in zip(stats, score) if s >= 0.7}

    import hashlib

    want = {d: (removed, sha) for d, _, removed, sha in brute_lines([(r["doc_id"], r["text"]) for r in rows[1].values()])}
    for d, r in rows[2].items():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[d][1] and r["n_chars"] == len(r["text"])
    assert all(want[d][0] > 0 for d in set(rows[1]) - set(rows[2]))

    parts = brute_components([(d, r["text"]) for d, r in rows[2].items()], 5, 75)
    assert set(rows[3]) == {d for d, _, c in parts if d == c}

    items = [decontaminate.windows_of(decontaminate.words(r["text"].encode())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {w for i in items for w in i}

    def clean(text):
        w = decontaminate.words(text.encode())
        return not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    assert set(rows[4]) == {d for d, r in rows[3].items() if clean(r["text"])}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {d: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows[4].items()}
    pieces = outs[-1].groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == total


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_tables(spark):
    """Every stage on null ids and texts, empty and very long texts, repeated rows, columns named like its own, and an empty table."""
    from pyspark.sql import functions as F

    good = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    long = "a long line of several words that goes on\n" + "word " * 300_000
    rows = [(None, "a text without an id of several words in a line", "en", "s", 5), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, long, "en", None, 9), (9004, "the same short text here", "en", "s", 1), (9004, "the same short text here", "en", "s", 1)]
    odd = good.unionByName(spark.createDataFrame(rows, good.schema))
    clashing = ("k1", "k2", "_k1", "score", "id", "group", "component", "component_id", "words", "line", "range", "shingle", "label", "quality", "n_hit", "pid", "first")
    docs = odd.withColumns({c: F.lit(None).cast("string") for c in clashing})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns, name
        got = out.collect()
        assert got and stage(spark, docs.limit(0), DATA).collect() == [], name
        if name == "line dedup" or name == "n-gram Jaccard join":
            assert sum(r["text"] is None for r in got) == 2, name
        if name == "benchmark decontamination":
            assert sum(r["doc_id"] == 9004 for r in got) == 2 and sum(r["text"] is None for r in got) == 2
        if name == "packing":
            assert sum(r["length"] for r in got if r["doc_id"] == 9002) == 1 and sum(r["length"] for r in got if r["doc_id"] == 9003) > 300_000
