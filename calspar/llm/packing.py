"""Packing by concatenate and cut.

First pass: every document becomes its token ids and an end id, with the running count of ids within its partition;
the rows are written once to the shared folder. Second pass: the partitions' totals, summed up to each partition,
turn running counts into global offsets; fixed windows of the global stream are the sequences, and a document that
crosses windows gives one piece for each (the boundary records). Only the last sequence is short.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Ids that one stored row holds at most: a longer document is stored as several rows, so that no row grows with a text.
ROW_IDS = 1 << 16
#: Distinct words that a worker keeps the ids of, about, and 50,000 fewer pieces; a full store is emptied and filled anew. Half as many save
#: about 100 MB a worker and cost a third more time.
STORED_WORDS = 450_000


class Numbers(dict):
    """Numbers words in order of first sight and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Encoder:
    """Ids of texts as the tokenizers library gives them: pieces are encoded by its model, once per distinct piece."""

    kept: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, stored: int = STORED_WORDS):
        self.stored = stored
        self.v = tokens.Vocabulary(path)
        self.library, self.model = self.v.library, self.v.library.model
        self.pieces = tokens.Cache(self.encode_piece, max(stored - 50_000, 1))
        self.special = {t: np.array([i], "<i4").tobytes() for t, i in self.v.special.items()}
        self.empty()

    @classmethod
    def of(cls, path: str, stored: int = STORED_WORDS) -> Encoder:
        if (path, stored) not in cls.kept:
            cls.kept = {(path, stored): cls(path, stored)}
        return cls.kept[path, stored]

    def empty(self) -> None:
        self.numbers, self.held = Numbers(), 0
        self.ids, self.starts = np.zeros(1 << 20, np.int32), np.zeros(2 * self.stored + 1, np.int64)

    def encode_piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(self.v.letters_of(piece))], "<i4").tobytes()

    def encode_word(self, word: str) -> bytes:
        return self.special.get(word) or b"".join([self.pieces[p] for p in tokens.split_word(self.library, word)])

    def learn(self) -> None:
        """Appends the ids of the new words to the store."""
        new, self.numbers.new = self.numbers.new, []
        found = [self.encode_word(w) for w in new]
        first, ends = len(self.numbers) - len(new), self.held + np.cumsum([len(f) // 4 for f in found], dtype=np.int64)
        if len(self.numbers) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.numbers) + 1, np.int64)])
        self.starts[first + 1 : first + 1 + len(new)] = ends
        flat = np.frombuffer(b"".join(found), "<i4")
        if self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[self.held : self.held + len(flat)] = flat
        self.held += len(flat)

    def words(self, text: str) -> list[str]:
        """Words without white space; special strings stand alone."""
        if "<|" in text and self.v.split_special:
            return [w for k, part in enumerate(self.v.split_special.split(text)) for w in ([part] if k % 2 else tokens.words_of(part))]
        return tokens.words_of(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many are each text's."""
        own = [self.words(t) for t in texts]
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in runs(own, self.stored):
            if len(self.numbers) > self.stored:
                self.empty()
            index = np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part))
            if self.numbers.new:
                self.learn()
            start, length = self.starts[index], self.starts[index + 1] - self.starts[index]
            ends = np.cumsum(length)
            ids.append(self.ids[np.repeat(start - ends + length, length) + np.arange(ends[-1])])
            lengths.append(length)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(ids), np.diff(ends[np.cumsum([0, *map(len, own)])])


def runs(own: list[list[str]], stored: int) -> Iterator[list[str]]:
    """The words of all texts in runs of at most so many."""
    words = list(chain.from_iterable(own))
    for a in range(0, len(words), stored):
        yield words[a : a + stored]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, stored: int) -> DataFrame:
    """Rows (pid, doc_id, first, within, doc_tokens, ids): runs of at most ROW_IDS ids of a document, with the count of ids before them in the document and in the partition."""

    schema = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("within", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pid, within = Encoder.of(tokenizer_path, stored), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in common.slices(whole, 1, 1 << 20):
                all_ids, counts = encoder.encode(batch.column(1).to_pylist())
                rows, at = [], 0
                for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                    own = np.append(all_ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for first in range(0, len(own), ROW_IDS):
                        part = own[first : first + ROW_IDS]
                        rows.append((pid, doc_id, first, within, len(own), part.tobytes()))
                        within += len(part)
                yield common.as_batch(rows, schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "pid int, doc_id long, first long, within long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", stored: int = STORED_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A null or empty text is the end id alone; null ids and repeated rows are documents like any other; further columns
    are ignored; an empty table gives no pieces. Documents follow one another in the order of the table's partitions.
    """
    spark = docs.sparkSession
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    encoded(docs, tokenizer_path, end_id, id_col, text_col, stored).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    # one row a partition of the first pass
    totals = stored.groupBy("pid").agg(F.sum(F.length("ids") / 4).cast("long").alias("total"))
    bases = totals.select("pid", F.coalesce(F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = stored.join(F.broadcast(bases), "pid")
    begin = F.col("base") + F.col("within")
    n = F.length("ids") / 4
    rows = rows.select("doc_id", "first", "doc_tokens", "ids", begin.alias("begin"), (begin + n).cast("long").alias("end"))
    window = F.explode(F.sequence(F.expr(f"begin div {length}"), F.expr(f"(end - 1) div {length}"))).alias("sequence_id")
    rows = rows.select("*", window)
    low, high = F.greatest("begin", F.col("sequence_id") * length), F.least("end", (F.col("sequence_id") + 1) * length)
    rows = rows.select("doc_id", "first", "doc_tokens", "ids", "begin", "sequence_id", low.alias("low"), high.alias("high"))
    skip = F.col("low") - F.col("begin")
    return rows.select(
        "doc_id",
        (F.col("first") + skip).alias("start"),
        (F.col("high") - F.col("low")).alias("length"),
        "doc_tokens",
        "sequence_id",
        (F.col("low") - F.col("sequence_id") * length).alias("offset"),
        F.substring("ids", (4 * skip + 1).cast("int"), (4 * (F.col("high") - F.col("low"))).cast("int")).alias("ids"),
    )


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
