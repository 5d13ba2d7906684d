"""Requests answered in one job: every error, and one answer of each kind."""

import datetime
import json

from calspar.operators import requests as r

D = datetime.date
LOCATIONS = [(1, "S", "V", "Aukso g.", "1-9", "k1"), (2, "S", "V", "Aukso g.", None, "k2"), (3, "S", "V", "Beržo g.", None, "k3"), (4, "S", "W", "", None, "k4")]
GROUPS = [("g1", "k1", "bendros", [D(2026, 1, 2), D(2026, 1, 1)]), ("g3", "k3", "bendros", [D(2026, 1, 3)]), ("g5", "k3", "stiklas", [D(2026, 1, 4)]), ("g4", "k4", "bendros", [D(2026, 1, 5)])]
ROWS = [(1, "S", "V", "Beržo g.", None, "stiklas", "k3")]


def test_requests(spark):
    locations = spark.createDataFrame(LOCATIONS, "id long, seniunija string, village string, street string, house_numbers string, kaimai_hash string")
    groups = spark.createDataFrame(GROUPS, "id string, kaimai_hash string, waste_type string, dates array<date>")
    rows = spark.createDataFrame([(i, s, None, v, None, st, None, h, w, k) for i, s, v, st, h, w, k in ROWS], "id long, seniunija string, mapped_seniunija string, village string, mapped_village string, street string, mapped_street string, house_numbers string, waste_type string, kaimai_hash string")
    links = spark.createDataFrame([("g1", "c1"), ("g3", "c3")], "schedule_group_id string, calendar_stream_id string")
    streams = spark.createDataFrame([("c1", "cal1", D(2026, 1, 1)), ("c3", None, None)], "id string, calendar_id string, calendar_synced_at date")
    place = {"seniunija": "S", "village": "V"}
    asked = [
        ("POST", "schedule", {}, 405, r.ONLY_GET), ("GET", "schedule", {}, 400, r.NEEDS_PLACE["schedule"]), ("GET", "schedule", {"seniunija": "S", "village": ""}, 400, r.NEEDS_PLACE["schedule"]),
        ("GET", "schedule", place, 400, r.NEEDS_STREET), ("GET", "schedule", {**place, "street": "Aukso g."}, 400, r.NEEDS_HOUSES), ("GET", "schedule", {**place, "street": "nowhere"}, 404, r.NO_LOCATION),
        ("GET", "schedule", {"location_id": "77"}, 404, r.NO_LOCATION), ("GET", "schedule", {"location_id": "x"}, 400, r.NEEDS_PLACE["schedule"]), ("GET", "schedule-multi", {"village": "V"}, 400, r.NEEDS_PLACE["schedule-multi"]),
        ("GET", "schedule-multi", place, 400, r.NEEDS_STREET), ("GET", "streets", {}, 400, r.NEEDS_PLACE["streets"]), ("GET", "house-numbers", {"seniunija": "S"}, 400, r.NEEDS_PLACE["streets"]),
        ("GET", "schedule-group/none", {}, 200, r.NO_GROUP), ("GET", "schedule-group/g5", {}, 200, 'Schedule group is for waste_type "stiklas", not "bendros"'), ("GET", "calendar-info/none", {}, 404, r.NO_CALENDAR),
        ("GET", "nothing", {}, 404, r.NO_PATH), ("GET", "schedule-group", {}, 404, r.NO_PATH),
        ("GET", "schedule", {"location_id": "1"}, 200, None), ("GET", "schedule", {**place, "street": "Aukso g.", "house_numbers": "1-9"}, 200, None), ("GET", "schedule", {**place, "street": "Aukso g.", "house_numbers": ""}, 200, None),
        ("GET", "schedule", {"seniunija": "S", "village": "W", "street": "ignored"}, 200, None), ("GET", "schedule-multi", {**place, "street": "Beržo g."}, 200, None), ("GET", "schedule-multi", {**place, "street": "Aukso g."}, 200, None),
        ("GET", "schedule-group/g1", {}, 200, None), ("GET", "schedule-group/g5", {"waste_type": "stiklas"}, 200, None), ("GET", "streets", place, 200, None), ("GET", "house-numbers", {**place, "street": "Aukso g."}, 200, None),
        ("GET", "calendar-info/cal1", {}, 200, None), ("GET", "villages", {}, 200, None), ("GET", "streets", {"seniunija": "none", "village": "none"}, 200, None),
    ]
    table = spark.createDataFrame([(n, m, f"/api/v1/{p}", q) for n, (m, p, q, _, _) in enumerate(asked)], "n int, method string, path string, params map<string,string>")
    out = r.answers(table, locations, groups, rows, links, streams)
    got = {x["n"]: x for x in out.collect()}
    assert [(got[n]["status"], got[n]["error"]) for n in range(len(asked))] == [(s, e) for *_, s, e in asked]
    good = [got[n] for n in range(len(asked)) if asked[n][3] == 200 and asked[n][4] is None]
    days = lambda x: [(d["date"].day, d["waste_type"]) for d in x["dates"]]
    entries = lambda x: [tuple(e) for e in x["entries"]]
    by_id, by_place, bare, whole, multi, split, g1, g5, streets, houses, info, villages, nowhere = good
    assert (by_id["location_id"], by_id["schedule_group_id"], by_id["calendar_id"], by_id["calendar_status"], days(by_id)) == (1, "g1", "cal1", "synced", [(1, "bendros"), (2, "bendros")])
    assert by_place["location_id"] == 1 and (bare["location_id"], bare["calendar_status"], days(bare)) == (2, "pending", [])
    assert (whole["location_id"], days(whole)) == (4, [(5, "bendros")])
    assert days(multi) == [(3, "bendros"), (4, "stiklas")] and days(split) == []
    assert days(g1) == [(1, "bendros"), (2, "bendros")] and g1["calendar_id"] == "cal1" and days(g5) == [(4, "stiklas")]
    assert entries(streets) == [("Aukso g.", "bendros"), ("Beržo g.", "bendros,stiklas")] and entries(houses) == [("1-9", "bendros")]
    assert info["calendar_id"] == "cal1" and entries(villages) == [("S/V", "bendros,stiklas"), ("S/W", "bendros")] and entries(nowhere) == []
    bodies = {x["n"]: json.loads(x["body"]) for x in r.as_json(out).collect()}
    assert bodies[0] == {"error": r.ONLY_GET} and bodies[17]["dates"][0] == {"date": "2026-01-01", "waste_type": "bendros"}
