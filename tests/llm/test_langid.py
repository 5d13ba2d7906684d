"""Language identification: held-out accuracy, rejection, odd rows."""

import numpy as np
import pytest
from calspar.llm import langid

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and held
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_uses_the_text_alone(spark):
    texts, langs = ["der die und das nicht"] * 30 + ["the and of that with"] * 30, ["de"] * 30 + ["en"] * 30
    model = langid.fit(texts, langs)
    assert model.predict("und die")[0] == "de" and model.predict("that the")[0] == "en"
    assert model.predict(None) == model.predict("") == model.predict("12 34 $$") == ("und", 0.0)
    long = model.predict("the and " * 400_000)
    assert long[0] == "en"


def test_rare_and_long_classes(spark):
    """A language of long texts, one of four rows and one that is called und are learned like the others."""
    words = {"de": "der die und das nicht ist", "fr": "le la et les dans que", "en": "the and of that with this", "und": "ovo je nije samo kako treba"}
    rows = [(k, (words["de"] + " ") * 4000, "de") for k in range(60)] + [(k, words["fr"] + f" mot{k}", "fr") for k in range(100, 105)] + [(k, words["en"] + f" word{k}", "en") for k in range(200, 260)] + [(k, words["und"] + f" x{k}", "und") for k in range(300, 330)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {k: lang for k, _, lang in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if truth[r["doc_id"]] != "fr")
    assert sum(r["lang_pred"] == "fr" for r in got if truth[r["doc_id"]] == "fr") >= 4


def test_prediction_by_plain_python():
    """A prediction is the softmax of the mean of the subwords' rows: computed again, subword by subword."""
    texts, langs = ["der die und das nicht"] * 30 + ["the and of that with"] * 30, ["de"] * 30 + ["en"] * 30
    model = langid.fit(texts, langs)

    def bucket(part):
        h = len(part)
        for c in part:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
            h ^= h >> 29
        return (h >> 16) % langid.BUCKETS

    for text in ("Der und  the!", "ÄÖ-x", "a" * 50, "die 12 nicht"):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        line = f" {letters} "
        parts = [line[i : i + n] for n in langid.SUBWORDS for i in range(len(line) - n + 1)]
        logits = (sum(model.rows[bucket(p)] for p in parts) / len(parts) + model.bias) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert model.predict(text) == (model.languages[int(p.argmax())], pytest.approx(float(p.max())))


def test_odd_tables(spark, docs):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "...", None, 1), (None, "the and", "en", 1), (4, "the and", "en", 1), (4, "the and", "en", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.language_id(odd)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"] and got.count() == 6
    assert {r["lang_pred"] for r in got.filter("doc_id < 4").collect()} == {"und"}
    assert langid.language_id(odd.limit(0)).count() == 0
    unlabelled = langid.language_id(docs.select("doc_id", "text", docs.source.alias("x")).selectExpr("*", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_calibration_follows_errors():
    logits = np.array([[40.0, 0.0]] * 90 + [[40.0, 0.0]] * 10)
    truth = np.array([0] * 90 + [1] * 10)
    model = langid.Model(["a", "b"], np.zeros((1, 2)), np.zeros(2))
    langid.calibrate(model, logits, truth)
    assert abs(langid.softmax(logits[:1] / model.temperature)[0, 0] - 0.9) < 0.05
