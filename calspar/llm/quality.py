"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown over the statistics of a bounded labelled sample; every path from a root is a
conjunctive rule; an l1-penalised logistic regression keeps the few rules that matter. The result is compiled into
one Spark column expression, so scoring is plain SQL over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are learned from at most (about; chosen by a hash of the id).
SAMPLE = 20_000
TREES, DEPTH, LEAF, SHRINK, CUTS, SEED = 40, 3, 10, 0.2, 32, 5
PENALTY, STEPS = 0.004, 400
STATISTICS = ["chars", "words", "word_length", "upper", "symbols", "bars", "bangs", "digits", "stops", "distinct_words", "distinct_lines", "words_a_line"]

Condition = tuple[int, bool, float]  # statistic, whether above, bound


def statistics(text: Column) -> list[Column]:
    """Two steps of columns (helpers, then STATISTICS) over a text column; a null text counts as empty, and an empty text has 0 in each."""
    return [
        text.alias("text"),
        F.regexp_replace(text, r"[\p{L}\s]+", "").alias("rest"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("capitals"),
        F.split(text, r"\s+").alias("w"),
        F.split(text, "\n").alias("l"),
    ]


def with_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with the columns of STATISTICS in a struct `s`; the text column goes."""
    others = [c for c in rows.columns if c != text_col]
    rows = rows.select(*others, *statistics(F.coalesce(F.col(text_col), F.lit(""))))
    chars = F.greatest(F.length("text"), F.lit(1))
    words, lines = F.size("w"), F.size("l")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace("rest", pattern, "")) / chars

    values = [
        F.length("text"),
        words,
        F.length("text") / words,
        F.col("capitals") / chars,
        share(r"[^#$%&*@^~<>{}\[\]=_\\+]+"),
        share(r"[^|]+"),
        share(r"[^!?]+"),
        share(r"\P{N}+"),
        share(r"[^.,;:]+"),
        F.size(F.array_distinct("w")) / words,
        F.size(F.array_distinct("l")) / lines,
        words / lines,
    ]
    empty = F.length("text") == 0
    s = F.struct(*[F.when(empty, 0.0).otherwise(v.cast("double")).alias(n) for n, v in zip(STATISTICS, values)])
    return rows.select(*others, F.explode(F.array(s)).alias("s"))  # generated, so that no filter on s computes the statistics anew for every rule


@dataclass
class Rules:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self, s: str = "s") -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            total = total + F.when(self.holds(conditions, s), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    @staticmethod
    def holds(conditions: tuple[Condition, ...], s: str) -> Column:
        out = F.lit(True)
        for k, above, bound in conditions:
            value = F.col(f"{s}.{STATISTICS[k]}")
            out = out & ((value > bound) if above else (value <= bound))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.bias + sum((w * applies(c, x) for c, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))

    def __str__(self) -> str:
        def say(c: Condition) -> str:
            return f"{STATISTICS[c[0]]} {'>' if c[1] else '<='} {c[2]:.4g}"

        return "\n".join([f"{self.bias:+.3f}", *(f"{w:+.3f} if {' and '.join(map(say, c))}" for c, w in self.rules)])


def applies(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in conditions:
        out &= (x[:, k] > bound) == above
    return out


def grow(x: np.ndarray, bins: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], found: dict, value: np.ndarray) -> None:
    """Grows one tree on the gradients; found gets every path, value the leaves' steps."""
    best = None
    g, h = gradient[rows].sum(), weight[rows].sum()
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for k, bounds in enumerate(bins):
            if not len(bounds):
                continue
            at = np.searchsorted(bounds, x[rows, k], side="left")  # bin b: above bounds[b - 1], at most bounds[b]
            n = np.cumsum(np.bincount(at, minlength=len(bounds) + 1))[:-1]
            gl = np.cumsum(np.bincount(at, gradient[rows], len(bounds) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, weight[rows], len(bounds) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
            b = int(np.argmax(gain))
            if gain[b] > 1e-3 and (best is None or gain[b] > best[0]):
                best = (gain[b], k, float(bounds[b]))
    if best is None:
        value[rows] = g / (h + 1)
        return
    for above in (False, True):
        own = (*path, (best[1], above, best[2]))
        found[tuple(sorted(own))] = None
        grow(x, bins, gradient, weight, rows[(x[rows, best[1]] > best[2]) == above], own, found, value)


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from statistics x and labels y (0 or 1). Without two classes the score is the share of label 1, smoothed."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) < 4 * LEAF or y.min() == y.max():
        return Rules(bias, [])
    random = np.random.default_rng(SEED)
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[:-1])) for c in x.T]
    bins = [b[b < c.max()] for b, c in zip(bins, x.T)]
    logit, found = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows = np.flatnonzero(random.random(len(y)) < 0.7)
        value = np.zeros(len(y))
        tree: dict = {}
        grow(x, bins, y - p, p * (1 - p), rows, (), tree, value)
        step = np.zeros(len(y))
        step[rows] = value[rows]
        logit += SHRINK * np.clip(step, -4, 4)
        found |= tree
    return lasso(x, y, list(found), bias)


def lasso(x: np.ndarray, y: np.ndarray, rules: list[tuple[Condition, ...]], bias: float) -> Rules:
    """Accelerated proximal gradient steps on the l1-penalised logistic loss; the bias has no penalty."""
    columns = {c.tobytes(): (r, c) for r, c in ((r, applies(r, x)) for r in rules) if LEAF <= c.sum() <= len(y) - LEAF}
    rules = [r for r, _ in columns.values()]
    if not rules:
        return Rules(bias, [])
    a = np.array([c for _, c in columns.values()], float).T
    scale = np.maximum(a.std(axis=0), 0.05)
    centre = a.mean(axis=0)
    z = (a - centre) / scale
    lipschitz = 0.25 * (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b = np.zeros(len(rules)), bias
    v, c, t = w, b, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        moved = v - z.T @ error / len(y) / lipschitz
        w_next = np.sign(moved) * np.maximum(np.abs(moved) - PENALTY / lipschitz, 0)
        b_next = c - error.mean() / lipschitz
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    kept = np.abs(w) > 1e-4
    return Rules(float(b - (w * centre / scale)[kept].sum()), [(r, float(k)) for r, k, use in zip(rules, w / scale, kept) if use])


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column) -> Rules:
    """Fits on about SAMPLE labelled rows for which `learn` (over doc_id) holds; rows without a label, and labels without a document, don't count."""
    own = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0) & F.coalesce(learn, F.lit(False)))
    share = min(1.0, SAMPLE / max(1, own.count()))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / float(1 << 53)
    own = common.sized(own.filter(draw < share), 64)  # about SAMPLE rows
    rows = docs.select("doc_id", "text").join(own, "doc_id")
    sample = sorted(tuple(r[0]) + (r[1],) for r in with_statistics(rows.select("text", "label"), "text").select("s", "label").collect())
    data = np.array(sample, float).reshape(len(sample), len(STATISTICS) + 1)
    return fit(data[:, :-1], data[:, -1])


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def learned(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules from all labelled rows but those whose crc32(doc_id) mod 4 is 2."""
    return fit_on(docs, labels, fold() != 2)


def quality_scores(docs: DataFrame, labels: DataFrame, bar: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null texts count as empty; null ids are never held out; repeated rows stay."""
    rules = learned(docs, labels)
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text"), "text")
    rows = rows.select("doc_id", "held_out", rules.column().alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= bar, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, bar: float = 0.7) -> DataFrame:
    """The rows of docs, columns unchanged, whose score is at least bar.

    Null texts count as empty and are scored like any other; null ids and repeated rows are kept or dropped by their
    texts alone; an empty table gives no rows, and without labels every row has the same score.
    """
    rules = learned(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return with_statistics(rows, "text").filter(rules.column() >= bar).select("row.*")
