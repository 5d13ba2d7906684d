"""Place cells: answers of several forms, what makes them unusable, rows of streets, and the cache's touches."""

import datetime
import json

from calspar.operators import answers, places
from pyspark.sql import functions as F

D = datetime.date
ROWS = "doc int, t int, section int, r int, location string, waste_type string, dates array<date>"


def answer_of(spark, raw):
    row = spark.createDataFrame([(raw,)], "raw string").select(places.cell_answer(F.col("raw")).alias("a")).first()["a"]
    return row and (row["seniunija"], [g["village"] for g in row["groups"]])


def test_answers(spark):
    a, b = {"seniunija": None, "groups": [{"village": "A"}]}, {"seniunija": "T sen.", "groups": [{"village": "B"}, {"village": "C"}]}
    assert answer_of(spark, json.dumps(b)) == ("T sen.", ["B", "C"])
    assert answer_of(spark, f"```json\n{json.dumps(a)}\n```") == (None, ["A"])
    assert answer_of(spark, json.dumps([b])) == ("T sen.", ["B", "C"])
    assert answer_of(spark, json.dumps([a, b, {"seniunija": "U"}])) == ("T sen.", ["A", "B", "C"])
    assert answer_of(spark, "{}") == (None, []) and answer_of(spark, "[]") == (None, [])
    assert answer_of(spark, "no JSON") is None and answer_of(spark, None) is None and answer_of(spark, '"text"') is None
    assert answer_of(spark, '{"groups": [{"include_streets": []}]}') is None
    assert answer_of(spark, '{"groups": [{"village": "A", "include_streets": [{"house_numbers": "1"}]}]}') is None


def error_of(spark, cell, seniunija, groups):
    raw = json.dumps({"seniunija": seniunija, "groups": [{"seniunija": s, "village": v} for s, v in groups]})
    return spark.createDataFrame([(cell, raw)], "c string, raw string").select(places.answer_error(F.col("c"), places.cell_answer(F.col("raw"))).alias("e")).first()["e"]


def test_errors(spark):
    two = "Avižienių sen. Bajorai, Riešės seniūnija Gilužiai"
    assert error_of(spark, "Bajorai", None, [(None, "Bajorai")]) is None
    assert error_of(spark, "Avižienių sen. Bajorai", None, [(None, "Bajorai")]) == "no district named"
    assert error_of(spark, "Avižienių sen. Bajorai", "Avižienių", [(None, "Bajorai")]) is None
    assert error_of(spark, "Bajorai", None, [(None, "Kiti kaimai")]) == "a heading for a village"
    assert error_of(spark, two, None, [("Avižienių sen.", "Bajorai"), (" ", "Gilužiai")]) == "a group without district"
    assert error_of(spark, two, None, [("Avižienių sen.", "Bajorai"), ("avižienių seniūnija", "Gilužiai")]) == "too few districts"
    assert error_of(spark, two, None, [("Avižienių sen.", "Bajorai"), ("Riešės sen.", "Gilužiai")]) is None
    assert error_of(spark, two, None, []) is None


def test_rows(spark):
    days = [D(2026, 1, 8), D(2026, 1, 1), D(2026, 1, 8)]
    table = [(1, 0, 1, 1, "Vieta (Aukso g. 1-9, Beržo g.)", "stiklas", days), (1, 0, 1, 2, "Vieta (Beržo g.)", "stiklas", days), (2, 0, 1, 1, "Vieta (Beržo g.)", "stiklas", []), (1, 0, 1, 3, " ", "stiklas", days),
             (1, 0, 1, 4, "Sunki vieta", "stiklas", days), (1, 0, 1, 5, "Sunki vieta", "plastikas", days)]
    rows = spark.createDataFrame(table, ROWS)
    got = sorted((r["doc"], r["r"], r["village"], r["street"], r["house_numbers"], len(r["dates"])) for r in places.place_rows(rows.filter("location <> 'Sunki vieta'")).collect())
    # the second row of doc 1 repeats a street of the first
    assert got == [(1, 1, "Vieta", "Aukso g.", "1-9", 2), (1, 1, "Vieta", "Beržo g.", None, 2), (2, 1, "Vieta", "Beržo g.", None, 0)]
    known = {"seniunija": "T", "groups": [{"village": " M. Riešės k.", "exclude_streets": [{"street": "Uosių g.", "house_numbers": None}]}, {"village": "B", "seniunija": "U", "include_streets": [{"street": "x", "house_numbers": "2"}]}]}
    from calspar.functions import ids

    cache = spark.createDataFrame([("Sunki vieta", "stiklas", json.dumps(known))], "s string, waste_type string, parsed_result string").select(ids.location_hash(F.col("s")).alias("kaimai_hash"), "waste_type", "parsed_result")
    got = sorted((r["r"], r["seniunija"], r["village"], r["street"], r["house_numbers"], [s["street"] for s in r["exclude_streets"]]) for r in places.place_rows(rows.filter("location = 'Sunki vieta'"), cache).collect())
    assert got == [(4, "T", "Mažosios Riešės k.", "", None, ["Uosių g."]), (4, "U", "B", "x", "2", []), (5, "", "Sunki vieta", "", None, [])]


def test_cache(spark, tmp_path):
    at = lambda k: F.lit(f"2026-01-0{k} 00:00:00")
    cache = answers.AnswerCache(spark, str(tmp_path), ["kaimai_hash", "waste_type"])
    keys = spark.createDataFrame([("a", "x"), ("b", "x"), ("zz", "x"), ("a", "x")], "kaimai_hash string, waste_type string")
    assert cache.get(keys, at(1)).collect() == [] and cache.entries().collect() == []
    cache.put(spark.createDataFrame([("a", "x", "one", 5), ("b", "x", "two", None)], "kaimai_hash string, waste_type string, parsed_result string, tokens_used int"), at(2))
    assert sorted(tuple(r) for r in cache.get(keys.filter("kaimai_hash <> 'b'"), at(4)).collect()) == [("a", "x", "one")]
    cache.get(keys, at(3))  # a touch may be written late
    cache.put(spark.createDataFrame([("b", "x", "new", 1)], "kaimai_hash string, waste_type string, parsed_result string, tokens_used int"), at(5))
    got = {r["kaimai_hash"]: (r["parsed_result"], r["created_at"].day, r["last_used_at"].day, r["reads"]) for r in cache.entries().collect()}
    assert got == {"a": ("one", 2, 4, 2), "b": ("new", 5, 5, 1)}
