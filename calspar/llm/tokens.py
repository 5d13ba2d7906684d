"""Exact token counts at every prefix, by dynamic programming over a byte-pair vocabulary with word ends.

A sequence of tokens is the encoding of their concatenation exactly when each neighbouring pair is the encoding of
its own concatenation. So the last token of a prefix is the one token that ends there and stands rightly after the
last token of the prefix before it, and its count is that prefix's count plus one. `Prefixes` keeps both for each
prefix of a word; over a text, counts add up at word boundaries. `prefix_counts` stores the count at every character, which answers truncation and budget
questions: no text is encoded again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tokenizer file's format: its pattern of pieces, for texts of ASCII and Latin-1 letters only.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Words of these characters are normalised by lower() alone; all others go through the library's own normaliser.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: White space in Python's split() but not in the tokenizer's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, WORD = re.compile(f"[{SPACES}]+"), re.compile(f"[^{SPACES}]+")
#: Entries that a worker's caches hold; a full cache is emptied and filled anew.
WORD_CACHE, PIECE_CACHE = 400_000, 400_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Vocabulary:
    """Merges and pieces of a tokenizers .json file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        made = {}
        for r, (a, b) in enumerate(merges):
            made.setdefault(a + b, (r, a, b))
        self.made = made  # a merged token: its rank and its two halves
        self.longest = max(map(len, self.ids))
        self.stands: dict[tuple[str, str], bool] = {}

    def letters_of(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def follows(self, left: str, right: str) -> bool:
        """Whether encoding left + right gives these two tokens: undo, last first, the merges that face the seam, looking for one that would have crossed it sooner."""
        known = self.stands.get((left, right))
        if known is None:
            if len(self.stands) > 2_000_000:
                self.stands.clear()
            known = self.stands[left, right] = self._follows(left, right)
        return known

    def _follows(self, left: str, right: str) -> bool:
        whole = 1 << 60
        before = whole  # only merges of a lower rank than this come before what has been undone
        ahead = 0  # 1 if what was undone last lies right of the seam: a crossing merge of the same rank wins from the left
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and (crossing < before or crossing == before and ahead):
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left, ahead = a[0], a[2], 0
            else:
                # of equal ranks the left one is merged first, so the right one is undone first
                before, right, ahead = b[0], b[1], 1


class Prefixes:
    """Counts of tokens at every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def inner(self, s: str) -> tuple[list[str], list[int]]:
        """For each prefix of s, not ended: its last token and its count."""
        ids, follows, longest = self.v.ids, self.v.follows, self.v.longest
        last, count = [""], [0]
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - longest), i):
                t = s[j:i]
                if t in ids and (j == 0 or follows(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of a piece")
        return last, count

    def ended(self, s: str, i: int, last: list[str], count: list[int]) -> int:
        """The count of the prefix of i letters as a piece of its own, whose last token has the word end."""
        ids, follows, suffix = self.v.ids, self.v.follows, self.v.suffix
        for j in range(max(0, i - self.v.longest), i):
            t = s[j:i] + suffix
            if t in ids and (j == 0 or follows(last[j], t)):
                return count[j] + 1
        raise ValueError("no token ends the piece")

    def total(self, piece: str) -> int:
        s = self.v.letters_of(piece)
        if s + self.v.suffix in self.v.ids:
            return 1
        last, count = self.inner(s[:-1])
        return self.ended(s, len(s), last, count)

    def all(self, piece: str) -> list[int]:
        """Counts of each prefix of the piece's letters, from one letter on, each as a piece of its own."""
        s = self.v.letters_of(piece)
        last, count = self.inner(s[:-1])
        return [self.ended(s, i, last, count) for i in range(1, len(s) + 1)]


    def characters(self, piece: str) -> list[int]:
        """`all` at the ends of characters only."""
        s, ends = self.v.letters_of(piece), np.cumsum([len(c.encode()) for c in piece]).tolist()
        last, count = self.inner(s[:-1])
        return [self.ended(s, i, last, count) for i in ends]


class Cache(dict):
    """A bounded dict whose missing entries are made by a function."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Counter:
    """Token counts of words, with caches that live as long as the Python worker."""

    kept: dict[str, Counter] = {}

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.prefixes = Prefixes(self.v)
        self.pieces = Cache(self.prefixes.total, PIECE_CACHE)
        self.words = Cache(lambda w: sum(map(self.pieces.__getitem__, self.split(w))), WORD_CACHE)
        self.inside = Cache(self.prefixes.characters, PIECE_CACHE // 4)

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def split(self, word: str) -> list[str]:
        """Pieces of a word without white space."""
        return split_word(self.v.library, word)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(end in characters, tokens) of each word and each special string, in order."""
        parts = self.v.split_special.split(text) if "<|" in text and self.v.split_special else [text]
        at = 0
        for k, part in enumerate(parts):
            if k % 2:
                yield at + len(part), 1
            else:
                for m in WORD.finditer(part):
                    yield at + m.end(), self.words[m[0]]
            at += len(part)

    def word_prefixes(self, word: str) -> list[int]:
        """Counts of each prefix of a word without white space, from one character on."""
        norm = word.lower()
        if PLAIN.fullmatch(word):
            spans = [m.span() for m in PIECES.finditer(norm)]
        else:
            normal = self.v.library.normalizer.normalize_str
            norm = normal(word)
            if len(norm) != len(word) or norm != "".join(map(normal, word)):  # characters that join or grow: no prefix follows from another
                return [sum(map(self.pieces.__getitem__, self.split(word[:i]))) for i in range(1, len(word) + 1)]
            spans = [at for _, at in self.v.library.pre_tokenizer.pre_tokenize_str(norm)]
        out, before = [], 0
        for a, b in spans:
            piece = norm[a:b]
            out += [before] * (a - len(out))
            if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # cut short, 're is two pieces
                out += [before + sum(map(self.pieces.__getitem__, self.split(piece[:i]))) for i in range(1, len(piece) + 1)]
            else:
                out += [before + n for n in self.inside[piece]]
            before = out[-1]
        return out + [before] * (len(word) - len(out))

    def every(self, text: str) -> list[int]:
        """Tokens of each prefix of a text, from one character on."""
        parts = self.v.split_special.split(text) if "<|" in text and self.v.split_special else [text]
        out, total = [], 0
        for k, part in enumerate(parts):
            if k % 2:  # cut short, a special string is letters and signs that go on with the word before it
                run = parts[k - 1][len(parts[k - 1]) - len(next(iter(WORD.findall(parts[k - 1])[-1:]), "")) :] if WORD.match(parts[k - 1][-1:]) else ""
                base = out[len(out) - len(run) - 1] if len(out) > len(run) else 0
                out += [base + n for n in self.word_prefixes(run + part[:-1])[len(run) :]]
                total += 1
                out.append(total)
                continue
            at = 0
            for m in WORD.finditer(part):
                out += [total] * (m.start() - at)
                out += [total + n for n in self.word_prefixes(m[0])]
                total, at = out[-1], m.end()
            out += [total] * (len(part) - at)
        return out

    def count(self, text: str) -> int:
        parts = self.v.split_special.split(text) if "<|" in text and self.v.split_special else [text]
        return sum(sum(map(self.words.__getitem__, words_of(part))) if k % 2 == 0 else 1 for k, part in enumerate(parts))


def words_of(text: str) -> list[str]:
    if ODD_SPACE.search(text):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def split_word(library, word: str) -> list[str]:
    if PLAIN.fullmatch(word):
        return PIECES.findall(word.lower())
    word = library.normalizer.normalize_str(word)
    # byte-level letters have one character a byte: offsets give the piece back
    return [word[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(word)]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library without added tokens; special strings inside texts count as one.
    A null text counts as empty (0 tokens); null ids and repeated rows stay; further columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer_path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ends array<int>, counts array<int>, prefixes array<int>.

    counts[k] is the exact count of the text's first ends[k] characters; ends are those of words. prefixes[k] is that
    of its first k + 1 characters, inside words too. A null text has empty arrays, a blank one no ends. `tokens_at` and `cut_at` answer from these columns.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer_path)
        for batch in batches:
            ends, counts, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                spans = list(counter.spans(text))
                ends.append([e for e, _ in spans])
                counts.append(np.cumsum([n for _, n in spans], dtype=np.int64).tolist())
                prefixes.append(np.array(counter.every(text), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(prefixes, pa.list_(pa.int32()))], ["doc_id", "ends", "counts", "prefixes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ends array<int>, counts array<int>, prefixes array<int>")


def tokens_at(characters):
    """Tokens of the first `characters` characters, from prefix_counts' columns."""
    within = F.least(F.size("prefixes"), F.lit(characters))
    return F.when(within > 0, F.get("prefixes", within - 1)).otherwise(0)


def cut_at(budget, inside: bool = False):
    """The length in characters of the longest prefix of whole words that has at most `budget` tokens; with `inside`, of any prefix that doesn't end in white space."""
    if not inside:
        within = F.size(F.filter("counts", lambda n: n <= budget))
        return F.when(within > 0, F.element_at("ends", within)).otherwise(0)
    fits = F.array_position(F.reverse(F.transform("prefixes", lambda n: n <= budget)), True)
    longest = F.when(fits > 0, F.size("prefixes") - fits + 1).otherwise(0).cast("int")
    # a word's first character adds a token: a count as at the last end means white space after it
    whole = F.size(F.filter("ends", lambda e: e <= longest))
    end, n = (F.when(whole > 0, F.get(c, whole - 1)).otherwise(0) for c in ("ends", "counts"))
    return F.when((longest > 0) & (F.get("prefixes", longest - 1) > n), longest).otherwise(end)
