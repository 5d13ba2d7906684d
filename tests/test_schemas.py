"""Schemas with a history: tables two versions old read as the present one."""

import datetime

import pytest
from calspar.operators import schemas
from pyspark.sql import functions as F

D = datetime.date
OLD = schemas.History("t", "id int, dates_json string")
STEPS = (schemas.add("kind", "string", lambda: F.concat(F.lit("k"), "id")), schemas.rename("dates_json", "dates"), schemas.retype("dates", "array<date>", lambda: schemas.json_dates("dates")))


def test_two_versions_old(spark, tmp_path):
    rows = spark.createDataFrame([(1, '["2026-01-08", "2026-01-01"]', "own")], "id int, dates_json string, kind string")
    schemas.Table(spark, str(tmp_path), OLD).append(rows)
    middle = schemas.Table(spark, str(tmp_path), schemas.History("t", OLD.first, STEPS[:1]))
    assert [tuple(r) for r in middle.read().collect()] == [(1, '["2026-01-08", "2026-01-01"]', "k1")]
    middle.append(rows.withColumn("id", F.lit(2)))
    present = schemas.Table(spark, str(tmp_path), schemas.History("t", OLD.first, STEPS))
    present.append(spark.createDataFrame([(3, [D(2026, 1, 5)], "new", 7)], "id int, dates array<date>, kind string, other int"))
    assert present.versions() == [1, 2, 4]
    days = [D(2026, 1, 8), D(2026, 1, 1)]
    assert sorted((r["id"], r["dates"], r["kind"]) for r in present.read().collect()) == [(1, days, "k1"), (2, days, "own"), (3, [D(2026, 1, 5)], "new")]
    # older code doesn't read what it doesn't know
    with pytest.raises(ValueError, match="version"):
        schemas.Table(spark, str(tmp_path), schemas.History("t", OLD.first, STEPS[:1])).read()


def test_model(spark, tmp_path):
    """Every table of the model is there, empty at first, and takes rows of its present schema."""
    for name, table in schemas.open_model(spark, str(tmp_path)).items():
        assert table.read().collect() == [], name
        table.append(spark.createDataFrame([(None,)], "nothing string"))
        assert table.read().count() == 1 and table.read().columns == table.history.schema_of(spark, table.history.version).names
    groups = schemas.MODEL["groups"]
    old = spark.createDataFrame([("g", '["2026-01-01"]', 9)], "id string, dates string, date_count int")
    table = schemas.Table(spark, str(tmp_path / "g"), groups)
    table.append(old, 1)
    row = table.read().first()
    assert row["dates"] == [D(2026, 1, 1)] and row["date_count"] == 1 and row["calendar_synced_at"] is None
