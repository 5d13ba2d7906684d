"""Cells of one text: a parse that the cache holds answers each of them, whatever row it was made for."""

import duckdb
from calspar.functions.dates import MONTHS
from calspar.operators import ingest
from calspar.plans import arrivals
from pyspark.sql import functions as F


def test_rows_of_one_text_share_a_parse(spark):
    cell, other = "Vieta5 (Aukso g. nuo 1 iki 9)", "Vieta6 (Aukso g. nuo 1 iki 9)"
    rows = [("f0", 66, "S", cell, "2 d."), ("f1", 8042, "S", f" {cell} ", "2 d."), ("f1", 8043, "S", other, "2 d.")]
    sheet = spark.createDataFrame(rows, f"file string, row long, seniunija string, kaimai string, {MONTHS[0]} string")
    parse = '{"village": "Answered", "streets": [{"street": "Aukso g.", "house_numbers": "1 iki 9"}]}'
    cache = spark.createDataFrame([(cell, parse)], "text string, parsed_result string").select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), "parsed_result")
    got = {r["row"]: r["village"] for r in ingest.sheet_schedules(sheet, MONTHS[:1], cache=cache).collect()}
    assert got == {66: "Answered", 8042: "Answered", 8043: "Vieta6"}


def test_the_query_gives_rows_of_one_text_the_same_places(spark, tmp_path):
    """Texts repeat after 7,976 customers. Rows not divisible by 11 are as in the SQL; one that is has the places of the SQL's other row of its text."""
    duck, apart = duckdb.connect(), 997 * 8
    for name, some in (("nation", "true"), ("customer", f"c_custkey % {apart} between 24 and 323"), ("orders", f"o_custkey % {apart} between 24 and 323")):
        duck.execute(f"copy (select * from read_parquet('/root/testdata/sf0.1/{name}.parquet') where {some}) to '{tmp_path}/{name}.parquet' (format parquet)")
        duck.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")

    def places(rows):
        out = {}
        for r in rows:
            out.setdefault(r["row"], []).append((r["village"], r["street"], r["house_numbers"] or ""))
        return {row: sorted(found) for row, found in out.items()}

    got = places(r.asDict() for r in arrivals.sheet_schedules_cached(spark, str(tmp_path)).collect())
    want = places(duck.execute(arrivals.oracle_sql()["sheet_schedules_cached"]).to_arrow_table().to_pylist())
    others = {row for row in got.keys() | want.keys() if row % 11}
    assert others and all(got.get(row) == want.get(row) for row in others)
    pairs = [(row, other) for row in got if row % 11 == 0 for other in (row - apart, row + apart) if other in want]
    assert pairs and all(got[row] == want[other] for row, other in pairs)
