"""Answers of which only something short is wanted: it is worked out once for each group, and no array goes along with the requests."""

import datetime

from pyspark.sql import functions as F

from calspar.operators import requests as r

D = datetime.date


def test_short_answers(spark):
    locations = spark.createDataFrame([(1, "S", "V", "Aukso g.", "1-9", "k1"), (3, "S", "V", "Beržo g.", None, "k3")], "id long, seniunija string, village string, street string, house_numbers string, kaimai_hash string")
    groups = spark.createDataFrame([("g1", "k1", "bendros", [D(2026, 1, 2), D(2026, 1, 1)]), ("g3", "k3", "bendros", [D(2026, 1, 3)]), ("g5", "k3", "stiklas", [D(2026, 1, 4), D(2026, 1, 3)])], "id string, kaimai_hash string, waste_type string, dates array<date>")
    rows = spark.createDataFrame([(1, "S", None, "V", None, "Beržo g.", None, None, "stiklas", "k3")], "id long, seniunija string, mapped_seniunija string, village string, mapped_village string, street string, mapped_street string, house_numbers string, waste_type string, kaimai_hash string")
    links = spark.createDataFrame([("g1", "c1")], "schedule_group_id string, calendar_stream_id string")
    streams = spark.createDataFrame([("c1", "cal1", D(2026, 1, 1))], "id string, calendar_id string, calendar_synced_at date")
    place = {"seniunija": "S", "village": "V"}
    asked = [("schedule", {"location_id": "1"}), ("schedule-multi", {**place, "street": "Beržo g."}), ("schedule-multi", {**place, "street": "none"}), ("schedule-group/g5", {"waste_type": "stiklas"}), ("schedule-group/none", {}), ("streets", place), ("house-numbers", {**place, "street": "Aukso g."}), ("villages", {}), ("elsewhere", {})]
    table = spark.createDataFrame([(n, "GET", f"/api/v1/{p}", q) for n, (p, q) in enumerate(asked)], "n int, method string, path string, params map<string,string>")
    model = (table, locations, groups, rows, links, streams)
    short = r.answers(*model, dates=r.dates_text, entries=F.size)
    assert dict(short.dtypes)["dates"] == "string" and dict(short.dtypes)["entries"] == "int"
    whole = r.answers(*model)
    want = {x["n"]: x for x in whole.select("n", "status", "error", r.dates_of(whole).alias("dates"), F.size("entries").alias("entries")).collect()}
    got = {x["n"]: x for x in short.select("n", "status", "error", "dates", "entries").collect()}
    assert got == want
    assert got[1]["dates"] == "2026-01-03 bendros,2026-01-03 stiklas,2026-01-04 stiklas" and got[2]["dates"] == "" and got[5]["entries"] == 2
