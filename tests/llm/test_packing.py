"""Packing: an exact round trip against the library's ids."""

import zlib

import numpy as np
import public_tokenizers
from calspar.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, monkeypatch):
    texts = ["The first, here.", None, "", "Zweiter Text: größer!", "<|endoftext|> a b", "long words here " * 3000, "The first, here.", "\x1c odd\x1dspace 日本"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "null id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    pieces = packing.pack(docs, PATH, length=64)
    got = [r.asDict() for r in pieces.collect()]
    library = Tokenizer.from_file(PATH)
    sequences = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or k == len(sequences) - 1
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        if i == 3:
            continue
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        ids = [x for r in by_doc[i] for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == want and {r["doc_tokens"] for r in by_doc[i]} == {len(want)}
    assert sum(r["length"] for r in by_doc[3]) == 2 * by_doc[3][0]["doc_tokens"]
    digest = {(r["doc_id"], r["start"], r["sequence_id"]): r["ids_crc32"] for r in packing.packed_digest(pieces).collect()}
    assert all(digest[r["doc_id"], r["start"], r["sequence_id"]] == zlib.crc32(r["ids"]) for r in got)


def test_rows_and_stores_are_bounded():
    encoder = packing.Encoder(PATH, 100)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)]
    ids, counts = encoder.encode(texts)
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == list(map(len, want))
    assert encoder.encode([])[0].tolist() == [] and encoder.encode([""])[1].tolist() == [0]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
