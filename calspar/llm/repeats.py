"""Substring dedup by seed and extend.

Every window of LENGTH words has a seed: the least hash of the SEED-word runs in it, so equal windows have equal
seeds wherever they stand. Consecutive windows of one seed are one stretch, which is the seed extended both ways as
far as its windows reach. Documents are joined on seeds: stretches that are equal as a whole match at once, and only
where stretches of one seed differ (at the edges of repeats) are single windows compared, those of the smallest
document of each different stretch. Matching windows that overlap form the maximal repeats of LENGTH words or more; from every document
all words of windows that a document of a smaller id has too are removed.

Nothing is paired within a group: stretches and windows are reduced to their smallest document by partial aggregates,
so a passage of a third of all documents is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import SECOND, Runs, Words, sliding_min

LENGTH, SEED = 50, 16
#: Text bytes that are hashed at a time.
SLICE = 2 << 20


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text): k tells apart texts of one id; text as UTF-8, empty for null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("k"), text.cast("binary").alias("text"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def stretches(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed's hash, first window, last window) of each stretch; windows are numbered by their first word."""
    if words.n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(words.n - seed + 1)
    least = sliding_min(Runs(words).of(at, at + seed), length - seed + 1)  # one per window
    windows = np.flatnonzero(words.left()[: len(least)] >= length)
    text = np.searchsorted(words.bounds, windows, side="right")
    value = least[windows]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(windows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows))[: len(first)] - 1
    return value[first], windows[first], windows[last]


def seeds(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, doc_id) of every stretch, each once for a slice of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, SLICE):
                words = Words(batch.column(2).to_pylist())
                value, first, _ = stretches(words, length, seed)
                text = np.searchsorted(words.bounds, first, side="right") - 1
                yield pa.RecordBatch.from_arrays([signed(value), batch.column(0).take(pa.array(text))], ["seed", "doc_id"])

    return texts.mapInArrow(work, "seed long, doc_id long")


def stretch_table(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, g1, g2, doc_id, k, low, high): every stretch with the hash of all its words and its windows' range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, SLICE):
                words = Words(batch.column(2).to_pylist())
                value, first, last = stretches(words, length, seed)
                text = np.searchsorted(words.bounds, first, side="right") - 1
                place, zero = pa.array(text), words.bounds[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(value), signed(Runs(words).of(first, last + length)), signed(Runs(words, SECOND).of(first, last + length)),
                        batch.column(0).take(place), batch.column(1).take(place), pa.array((first - zero).astype(np.int32)), pa.array((last - zero).astype(np.int32)),
                    ],
                    ["seed", "g1", "g2", "doc_id", "k", "low", "high"],
                )

    return texts.mapInArrow(work, "seed long, g1 long, g2 long, doc_id long, k long, low int, high int")


def window_table(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc_id, k, low): the windows in the wanted ranges (doc_id, k, ranges array<struct<low, high>>)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 2, SLICE):
                words = Words(batch.column(2).to_pylist())
                text, low = [], []
                for t, ranges in enumerate(batch.column(3).to_pylist()):
                    for r in ranges:
                        low.append(np.arange(r["low"], r["high"] + 1) + words.bounds[t])
                        text.append(np.full(r["high"] + 1 - r["low"], t))
                if not low:
                    continue
                text, low = np.concatenate(text), np.concatenate(low)
                place = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [signed(Runs(words).of(low, low + length)), signed(Runs(words, SECOND).of(low, low + length)), batch.column(0).take(place), batch.column(1).take(place), pa.array((low - words.bounds[text]).astype(np.int32))],
                    ["w1", "w2", "doc_id", "k", "low"],
                )

    rows = texts.join(common.sized(wanted, 400), ["doc_id", "k"]).select("doc_id", "k", "text", "ranges")
    return rows.mapInArrow(work, "w1 long, w2 long, doc_id long, k long, low int")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, k, low, end): word ranges of texts that also stand in a text of a smaller id; together they cover all such windows."""
    texts = texts.filter("doc_id is not null")
    shared = seeds(texts, length, seed).groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("seed")
    shared = common.cut(shared)
    found = common.cut(stretch_table(texts, length, seed).join(common.sized(shared, 32), "seed", "left_semi"))
    group = ["seed", "g1", "g2"]
    kinds = common.cut(found.groupBy(*group).agg(F.min("doc_id").alias("e")))
    placed = found.join(kinds, group)
    whole = placed.filter("e < doc_id").select("doc_id", "k", "low", (F.col("high") + length).alias("end"))
    several = kinds.groupBy("seed").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("z")).filter("n > 1 and a < z").select("seed")
    edges = placed.filter("e = doc_id").join(several, "seed", "left_semi")
    wanted = common.cut(edges.groupBy("doc_id", "k").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    windows = common.cut(window_table(texts, wanted, length))
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z")
    single = windows.join(first, ["w1", "w2"]).filter("a < doc_id").select("doc_id", "k", "low", (F.col("low") + length).alias("end"))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, k, text, removed array<struct<low, end>>): every input row, with the word ranges that go (null: none)."""
    texts = texts_of(docs)
    ranges = repeated_ranges(texts, length, seed)
    ranges = common.cut(ranges.groupBy("doc_id", "k").agg(F.collect_list(F.struct("low", "end")).alias("removed")))
    return texts.join(common.sized(ranges, 600), ["doc_id", "k"], "left")


def kept_words(text: bytes, removed: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not removed:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for r in removed:
        gone[r["low"]] += 1
        gone[r["end"]] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist()) if s], len(words)


def repeat_digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words; rows with a null id neither lose words nor make others lose any; rows of one id never
    make each other lose words; a text of fewer than `length` words has no windows; further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def work(doc_id, text, removed):
        kept, n = kept_words(text, removed)
        yield doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return without_repeats(docs, length, seed).select("doc_id", "text", "removed").mapInArrow(common.by_rows(work, schema), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text): the words that stay, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(doc_id, text, removed):
        yield doc_id, b" ".join(kept_words(text, removed)[0]).decode()

    return without_repeats(docs, length, seed).select("doc_id", "text", "removed").mapInArrow(common.by_rows(work, schema), "doc_id long, text string")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) as s from d, unnest(range(1, len(w) - 48)) as t(k)
), early as (select s, min(doc_id) as a from win group by s having min(doc_id) < max(doc_id)
), gone as (
  select distinct doc_id, x from (select win.doc_id, k from win join early on win.s = early.s and early.a < win.doc_id), unnest(range(k, k + 50)) as t(x)
), word as (select doc_id, i, x from d, unnest(w) with ordinality as t(x, i)
), kept as (
  select word.doc_id, count(*) filter (gone.x is not null) as n_removed, string_agg(word.x, ' ' order by i) filter (gone.x is null) as text
  from word left join gone on gone.doc_id = word.doc_id and gone.x = word.i group by word.doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""
