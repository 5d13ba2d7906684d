"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of WINDOW consecutive words of an item (a shorter item is one window). Its shingles, runs of SHINGLE
words, are ordered by rarity, counted over all documents; to hold a window, a document must hold all its shingles, so
a window with a shingle that no document has is out, and the rarest shingle of each other one is the necessary prefix
on which windows and documents are joined. A match gives the place where the window would lie; places that leave the
document are out by length and position, and the rest is verified word by word over the window's own span.

Neither windows nor items reach the driver. What is sent to the tasks is a table of bits of a fixed size that tells
which shingles may be those of a window; the join then finds out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import FIRST, SECOND, Words, mixed

WINDOW, SHINGLE = 10, 3
#: The table of bits has 2 ** TABLE_BITS of them, 8 MB; with more shingles than that it lets more rows through to the join.
TABLE_BITS = 26
SLICE = 2 << 20

# Lower-case a-z, digits and bytes of characters beyond ASCII are of words; every other byte separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, runs of digits, letters and all characters beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(item: list[bytes], length: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[k : k + length]) for k in range(max(1, len(item) - length + 1))]


def shingles(own: Words, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words from each word on; those that leave their text are of no use."""
    h = np.zeros(own.n, np.uint64)
    for k in range(min(size, own.n)):
        h[: own.n - k] = h[: own.n - k] * FIRST + own.hash[k:]
    return mixed(h ^ (np.array([size], np.uint64) * SECOND))


def window_table(benchmark: DataFrame, length: int) -> DataFrame:
    """(item_id, words, shingles): every distinct window of every item, with its shingles in order."""
    schema = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))])

    def work(item_id, text):
        item = words(text)
        if not item:
            return
        n = min(length, len(item))
        size = min(SHINGLE, n)
        h = shingles(Words([b" ".join(item)]), size).view(np.int64).tolist()
        seen = set()
        for k, w in enumerate(windows_of(item, length)):
            if w not in seen:
                seen.add(w)
                yield item_id, [x.decode() for x in w], h[k : k + n - size + 1]

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(common.by_rows(work, schema), "item_id string, words array<string>, shingles array<long>")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bytes of 2 ** TABLE_BITS bits, with those of a column `shingle` set."""
    slot = F.shiftrightunsigned("shingle", 64 - TABLE_BITS)
    blocks = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("block")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - TABLE_BITS}) & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[blocks["block"].to_numpy()] = blocks["bits"].to_numpy()
    return table


def listed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - (64 * len(table)).bit_length() + 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], Words]]:
    for whole in batches:
        for batch in common.slices(whole, column, SLICE):
            texts = [(t or b"").translate(WORD_BYTES) for t in batch.column(column).to_pylist()]
            yield batch, texts, Words(texts)


def shingle_counts(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often each wanted shingle stands in the texts; those that stand nowhere don't appear."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in sliced(batches, 0):
            left = own.left()
            for size in sizes:
                h = shingles(own, size)[left >= size]
                found, n = np.unique(h[listed(sent.value, h)], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = texts.select("text").mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counts.join(wanted, "shingle", "left_semi")


def prefix_table(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, place, words): each window that may occur, by its rarest shingle and that shingle's place in it."""
    each = windows.select("words", F.posexplode("shingles").alias("place", "shingle"))
    counts = shingle_counts(texts, each.select("shingle").distinct(), sizes)
    known = each.join(counts, "shingle", "left")
    best = known.groupBy("words").agg(F.min(F.struct("n", "shingle", "place")).alias("b"), F.count_if(F.col("n").isNull()).alias("absent"))
    return best.filter("absent = 0").select("b.shingle", "b.place", "words")


CANDIDATE = pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("near", pa.list_(pa.string()))])


def candidates(texts: DataFrame, prefixes: DataFrame, sizes: list[int], length: int) -> DataFrame:
    """(doc_id, k1, k2, n_words, found): for every row, the places of shingles that may be prefixes, each with the words around it that a window could cover."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(prefixes.select("shingle")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, own in sliced(batches, 3):
            found: list[list | None] = [None] * len(texts)
            left = own.left()
            for size in sizes:
                h = shingles(own, size)
                hits = np.flatnonzero((left >= size) & listed(sent.value, h))
                owners = np.searchsorted(own.bounds, hits, side="right") - 1
                docs, firsts = np.unique(owners, return_index=True)
                for doc, a, b in zip(docs.tolist(), firsts, [*firsts[1:], len(hits)]):
                    split, start = texts[doc].split(), int(own.bounds[doc])
                    for at in hits[a:b].tolist():
                        low = max(0, at - start - length + 1)
                        near = [w.decode() for w in split[low : at - start + length]]
                        found[doc] = found[doc] or []
                        found[doc].append({"pos": at - start, "shingle": int(h[at].view(np.int64)), "at": at - start - low, "near": near})
            n = np.diff(own.bounds).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(found, pa.list_(CANDIDATE))], ["doc_id", "k1", "k2", "n_words", "found"])

    rows = texts.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "text")
    return rows.mapInArrow(work, "doc_id long, k1 long, k2 long, n_words long, found array<struct<pos: int, shingle: long, at: int, near: array<string>>>")


def verified(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(k1, k2, start, words): the occurrences of windows in the texts of these keys, each once."""
    each = rows.filter("found is not null").select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*")
    met = each.join(common.sized(prefixes, 400), "shingle")
    first, n = F.col("at") - F.col("place"), F.size("words")
    inside = (first >= 0) & (first + n <= F.size("near"))
    same = F.when(inside, F.slice("near", F.when(inside, first + 1).otherwise(1), n) == F.col("words")).otherwise(False)
    return met.filter(same).select("k1", "k2", (F.col("pos") - F.col("place")).alias("start"), "words").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as `candidates` gives them, occurrences, windows with their items), the first two computed once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    table = common.cut(window_table(benchmark, length))
    windows = table.select("words", "shingles").distinct()
    sizes = sorted(r[0] for r in table.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most
    prefixes = common.cut(prefix_table(texts, windows, sizes))
    rows = common.cut(candidates(texts, prefixes, sizes, length))
    return rows, common.cut(verified(rows, prefixes)), table


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words; items without words have no windows; null ids and repeated rows stay;
    a null item_id counts as no item, though its windows hit; further columns are ignored. An empty benchmark hits nothing.
    docs is read twice and must give the same rows both times.
    """
    rows, found, table = occurrences(docs, benchmark, length)
    # words that spans cover: a span adds what lies beyond the farthest end before it
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("words")).alias("end"))))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    covered = found.groupBy("k1", "k2").agg(spans.alias("spans")).select("k1", "k2", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"]).cast("long").alias("n_hit"))
    owners = table.filter("item_id is not null").select("words", "item_id").distinct()
    items = found.select("k1", "k2", "words").distinct().join(common.sized(owners, 400), "words").select("k1", "k2", "item_id").distinct()
    items = items.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hits = common.cut(covered.join(items, ["k1", "k2"], "left").select("k1", "k2", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256")))
    out = rows.select("doc_id", "k1", "k2", "n_words").join(common.sized(hits, 160), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of docs, columns unchanged, in which no window of an item occurs.

    Null and wordless texts, null ids and repeated rows of clean texts stay; an empty benchmark leaves all rows.
    """
    _, found, _ = occurrences(docs, benchmark, length)
    hit = common.cut(found.select("k1", "k2").distinct())
    text = F.col("_docs.text").cast("binary")
    on = (F.xxhash64(text) == F.col("_hit.k1")) & (F.xxhash64(text, F.lit(1)) == F.col("_hit.k2"))
    return docs.alias("_docs").join(common.sized(hit, 32).alias("_hit"), on, "left_anti")


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item_id, len(w[k : k + 9]) as n, array_to_string(w[k : k + 9], ' ') as s
  from b, unnest(range(1, greatest(1, len(w) - 9) + 1)) as t(k) where len(w) > 0
), short as (select distinct n from win), place as (
  select r, n, k, array_to_string(w[k : k + n - 1], ' ') as s
  from d, short, unnest(range(1, len(w) - n + 2)) as t(k)
), hits as (select r, k, place.n, item_id from place join win on place.s = win.s and place.n = win.n
), covered as (select r, count(distinct x) as n_hit from hits, unnest(range(k, k + n)) as t(x) group by r
), items as (select r, count(*) as n_items, string_agg(i, ',' order by i) as l from (select distinct r, cast(item_id as varchar) as i from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join items using (r)
"""
