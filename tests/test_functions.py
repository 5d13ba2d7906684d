"""Literal cases of the text, date and identity functions."""

import datetime
import hashlib

import pytest
from calspar.functions import dates, ids, text
from pyspark.sql import functions as F


def values(spark, function, cases):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    return [r["v"] for r in df.select("k", function(F.col("c")).alias("v")).orderBy("k").collect()]


def test_streets(spark):
    cases = {
        "Žvejų skg.": ("Žvejų skg.", None), "Perkūno g. 3, 15": ("Perkūno g.", "3, 15"), "Saulės g.,(nuo Nr. 7 iki 21)": ("Saulės g.", "nuo Nr. 7 iki 21"),
        "Saulės g. (nuo Nr. 9B iki 4, 6 )": ("Saulės g.", "nuo Nr. 9B iki 4, 6"), "Rūko g.,nuo 2 iki 2C": ("Rūko g.", "nuo 2 iki 2C"), "": ("", None), None: ("", None),
    }
    assert [tuple(v) for v in values(spark, text.street, cases)] == list(cases.values())


def test_locations(spark):
    got = values(spark, text.location, ["Pavilnė", "Gojus (Žvejų skg., Rasos g.)", "", None, "A (B g. (1, 2), C g., (nuo 1 iki (2), 3), ,D)"])
    assert (got[0]["village"], got[0]["streets"]) == ("Pavilnė", [])
    assert [tuple(s) for s in got[1]["streets"]] == [("Žvejų skg.", None), ("Rasos g.", None)]
    assert got[2] is None and got[3] is None
    assert [s["street"] for s in got[4]["streets"]] == ["B g.", "C g.", "(nuo 1 iki", "D"]


def test_routing(spark):
    simple = ["Pavilnė", "Gojus (Rasos g., Senoji arka)", "Malūno 1-oji, 2-oji g.", "Užupis (Upės g., Tilto g.)"]
    hard = ["Gojus Rasos g. (Nr. 4-1, 4-3, 8)", "Perkūno g. 3, 15", "Rūko g.,nuo 2 iki 2C", "Gojus (Rasos g.) Sodo g.", "Užupis Upės g., Tilto g.", "ŠĄ. 5"]
    assert values(spark, text.is_complex, simple + hard) == [False] * len(simple) + [True] * len(hard)


def test_house_numbers(spark):
    cases = {
        "3, 15": "3,15", "71, 71A,71C": "71,71A,71C", "nuo 2 iki 2C": "2-2C", "nuo Nr. 4 iki 6": "4-6", "nuo 52": "≥52", "iki Nr.8": "≤8", "m": None, "x": None, None: None,
        "": None, "5": "5", "nuo Nr. 4 iki 30B, nuo 3 iki 29": "4-30B,3-29", "nuo Nr.61, 61B iki 75": "61,61B-75", "nuo 1 iki 5, 7": "1-5",
    }
    assert values(spark, text.house_numbers, cases) == list(cases.values())


def test_cells_and_months(spark):
    df = spark.createDataFrame([("8 d.", "Sausio"), ("3 d., 17 d., 29 d.", "Balandžio"), ("", "Kovo"), (None, "Kovo"), ("30, 31, 8", "Vasario"), ("1", "Nope"), ("8.0", "Sausio"), ("5 d. 7", "Sausio")], "c string, m string")
    got = [[d.isoformat() for d in r[0]] for r in df.select(dates.cell_dates(F.col("c"), F.col("m"))).collect()]
    assert got == [["2026-01-08"], ["2026-04-03", "2026-04-17", "2026-04-29"], [], [], ["2026-02-08"], [], ["2026-01-08"], ["2026-01-05", "2026-01-07"]]
    suffix = df.select(dates.cell_dates(F.col("c"), F.col("m"), with_suffix=True)).collect()[-1][0]
    assert suffix == [datetime.date(2026, 1, 5)]
    assert values(spark, dates.month_name, [" Sausis. ", "RUGPJŪČIO", "birzelis", "x", None]) == ["Sausio", "Rugpjūčio", "Birželio", None, None]
    assert values(spark, dates.load_dates, ['["2026-01-08", "x"]', "broken", None]) == [[datetime.date(2026, 1, 8)], [], []]


def test_identities(spark):
    assert values(spark, ids.location_hash, ["Aleksandravas"]) == ["k1_0b7da8f02aba"]
    a, b = [datetime.date(2026, 1, 8), datetime.date(2026, 1, 22)], [datetime.date(2026, 1, 22), datetime.date(2026, 1, 8)]
    df = spark.createDataFrame([(a,), (b,), ([],), (None,)], "d array<date>")
    got = [r[0] for r in df.select(ids.dates_hash(F.col("d"))).collect()]
    assert got == [hashlib.sha256(b"2026-01-08,2026-01-22").hexdigest()[:16]] * 2 + ["", ""]
    assert len(values(spark, lambda c: ids.group_id(F.lit("bendros"), c), ["k1_0b7da8f02aba"])[0]) == 15


@pytest.mark.parametrize("strict", [True, False])
def test_compared_forms(spark, strict):
    got = values(spark, lambda c: text.compared(c, ["g", "k"], strict), ["  Šilo  g., ", "Žemyna k."])
    assert got == (["silo  g", "zemyna k"] if strict else ["silo", "zemyna"])
    assert values(spark, text.stem, ["Užupys", "Užupių", "as", "Neries", "Ñandú"]) == ["uzup", "uzup", "as", "neri", "nand"]
    assert values(spark, text.compared_houses, ["ALL", " 1 , 2A", None]) == ["", "1,2a", ""]


def test_labels(spark):
    assert values(spark, text.district_labels, ["Gojaus sen. Užupio seniūnija Gojaus seniūnijos", "be"]) == [["Gojaus sen.", "Užupio sen."], []]
    assert values(spark, text.waste_type, ["Pakuotė", "STIKLAS", "x"]) == ["plastikas", "stiklas", "bendros"]
    assert values(spark, text.village_name, ["D. Riešės kaimas", " Žemyna k. "]) == ["Didžiosios Riešės kaimas", "Žemyna k."]
    assert values(spark, lambda c: text.like_ascii(c, F.lit("sil")), ["Šilas", "SILAS", "x"]) == [False, True, False]
    assert values(spark, text.unfenced, ["```json\n{}\n```", " [] "]) == ["{}", "[]"]
    assert values(spark, text.suspicious_village, ["A (B g.", "A g. B g.", "Village", "x, y g."]) == [True, True, False, True]
