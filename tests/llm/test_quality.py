"""Quality rules: compiled columns equal numpy scores, held-out accuracy, odd rows."""

import numpy as np
from calspar.llm import quality
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_compiled_rules(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    rules = quality.learned(docs, labels)
    assert 0 < len(rules.rules) < 200 and "if" in str(rules)
    rows = quality.with_statistics(docs.select("doc_id", "text"), "text").select("doc_id", "s", rules.column().alias("score")).collect()
    want = rules.score(np.array([tuple(r["s"]) for r in rows]))
    assert np.allclose(want, [r["score"] for r in rows])


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert str(quality.learned(docs, labels)) == str(quality.learned(docs, turned))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z", "d"), (5, "long " * 20000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels)
    assert got.count() == 6 and got.filter("score between 0 and 1").count() == 6
    assert quality.keep_good(docs, labels, 0.0).columns == ["doc_id", "text", "score"]
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == 6
    values = quality.with_statistics(docs, "text").filter("doc_id < 3").select("s.*").collect()
    assert all(v == 0 for r in values for v in r)


def test_lasso_keeps_what_matters():
    random = np.random.default_rng(1)
    x = random.random((2000, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.8)).astype(float)
    rules = quality.fit(x, y)
    assert np.mean((rules.score(x) > 0.5) == y) > 0.98
    assert len(rules.rules) < 60
