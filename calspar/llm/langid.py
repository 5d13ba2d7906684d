"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is a stream of lower-case letters with one space for each run of anything else; its subwords are the runs of
2 to 4 characters of that stream, hashed into BUCKETS embeddings whose mean goes through a linear softmax. Both layers
are trained by stochastic gradient descent. As the mean and the output layer are linear, a trained model is folded
into one row of class scores per bucket, and predicting a text of any length is a sum of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The learning sample: about PER_LANGUAGE rows of every language, all of them if it has fewer, and of a long text a span of SPAN_CHARS
#: characters, or fewer where there are so many languages that the spans would come to more than SAMPLE_CHARS together.
PER_LANGUAGE, SPAN_CHARS, SAMPLE_CHARS = 500, 64 << 10, 128 << 20
#: More languages than this aren't languages: the model would hold a number for each of them in every bucket.
MOST_LANGUAGES = 2000
BUCKETS, WIDTH, SUBWORDS = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 4.0, 17
#: Of the sample, one text in CALIBRATION sets temperature and rejection; accepted predictions should err no more than ERRORS.
CALIBRATION, ERRORS = 5, 0.01
#: Characters that are hashed at a time.
SPAN = 1 << 20

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _letter


def stream(text: str) -> np.ndarray:
    """Code points of the lower-case letters, each run of others as one space, with a space before and after; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    before = np.concatenate([[False], is_letter[:-1]])
    kept = is_letter | before
    out = np.where(is_letter, points, 32)[kept]
    return np.concatenate([[32] * int(out[0] != 32), out, [32] * int(out[-1] != 32)]).astype(np.uint32)


def subwords(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the subwords, a span of characters at a time."""
    for a in range(0, len(points), SPAN):
        span = points[a : a + SPAN + max(SUBWORDS) - 1].astype(np.uint64)
        for n in SUBWORDS:
            count = min(SPAN, len(span) - n + 1)
            if count > 0:
                h = np.full(count, n, np.uint64)
                for k in range(n):
                    h = (h ^ span[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield (h >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    total = np.zeros(BUCKETS, np.int64)
    for ids in subwords(stream(text)):
        total += np.bincount(ids, minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids] / max(1, total.sum())


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray = field(repr=False)  # class scores per bucket
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    least: float = 0.0  # predictions below this score are rejected

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for ids in subwords(stream(text)):
            total += np.bincount(ids, minlength=BUCKETS) @ self.rows if len(ids) > BUCKETS else self.rows[ids].sum(axis=0)
            n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ('und', 0.0) for null or letterless texts, or without a learned language."""
        logits = self.logits(text) if text and self.languages else None
        if logits is None:
            return "und", 0.0
        p = softmax(logits / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Trains on all but one in CALIBRATION of the texts, which set temperature and rejection."""
    data = [(counted(t), lang) for t, lang in zip(texts, langs)]
    data = [(x, lang) for x, lang in data if len(x[0])]
    names = sorted({lang for _, lang in data})
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    random = np.random.default_rng(SEED)
    order = random.permutation(len(data))
    held = [data[i] for i in order[::CALIBRATION]] if len(data) >= 2 * CALIBRATION else []
    train = [data[i] for k, i in enumerate(order) if k % CALIBRATION or not held]
    embedding = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    output, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    place = {name: k for k, name in enumerate(names)}
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(train)):
            (ids, share), lang = train[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ embedding[ids]
            error = softmax(mean @ output + bias)
            error[place[lang]] -= 1
            embedding[ids] -= rate * np.outer(share, output @ error) * 8  # shares are small: the embeddings learn at a higher rate
            output -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
    model = Model(names, embedding @ output, bias)
    if held:
        logits = np.array([share @ model.rows[ids] + bias for (ids, share), _ in held])
        truth = np.array([place.get(lang, -1) for _, lang in held])
        calibrate(model, logits[truth >= 0], truth[truth >= 0])
    return model


def calibrate(model: Model, logits: np.ndarray, truth: np.ndarray) -> None:
    """Sets the temperature of least log loss, and the least score from which on the error is within ERRORS."""

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(truth)), truth]
        return float(-np.log(np.clip(p, 1e-9, 1)).mean())

    model.temperature = float(min(np.geomspace(0.25, 256, 81), key=loss))
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= ERRORS)
    model.least = float(score[order[fine[-1]]]) if len(fine) else 1.0


def fit_on(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of the rows for which `learn` holds: every language is learned, however rare, whatever its name and however long its texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    rows = rows.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return fit([], [])
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, PER_LANGUAGE / n)) for lang, n in counts.items()], "lang string, share double")
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) / float(1 << 53)
    span = min(SPAN_CHARS, SAMPLE_CHARS // (PER_LANGUAGE * len(counts)))
    # where a longer text's span begins is drawn, too
    start = 1 + F.pmod(F.xxhash64("id", F.lit("span")), F.greatest(F.length("text") - span + 1, F.lit(1)).cast("long")).cast("int")
    chosen = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("id", F.substring("text", start, F.lit(span)).alias("text"), "lang")
    sample = chosen.collect()
    sample.sort(key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected, from the text alone.

    Null texts and texts without a letter are 'und' with score 0 and rejected. Null ids and repeated rows stay;
    further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number per language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            out = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([not x[1] or x[1] < own.least for x in out], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; rows whose crc32(doc_id) mod folds is 0 are held out of learning (a null id is never learned from nor held out)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = fit_on(docs, F.coalesce(fold != 0, F.lit(False)))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
