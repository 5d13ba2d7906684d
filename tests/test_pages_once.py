"""Pages are parsed once, however often their rows are read, and answers are read only for cells that occur."""

from calspar.operators import places, sections
from calspar.sources.html import html_tables

PAGE = "<table><tr><th>Seniūnijos pavadinimas</th><th>Atliekos</th><th>Sausio</th></tr><tr><td>V k.</td><td>Stiklas</td><td>2 d.</td></tr><tr><td>W k.</td><td></td><td>3 d.</td></tr></table>"


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, PAGE)], "doc int, html string")
    out = sections.table_schedules(html_tables(pages, "doc", "html"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert sorted((r.location, r.waste_type, r.dates[0].day) for r in out.collect()) == [("V k.", "stiklas", 2), ("W k.", "stiklas", 3)]


def test_answers_meet_cells_before_they_are_read(spark):
    cells = spark.createDataFrame([("V k.", "stiklas"), ("W k.", "stiklas")], "location string, waste_type string")
    key = places.ids.location_hash(places.F.lit("V k."))
    cache = spark.createDataFrame([("stiklas", '{"groups": [{"village": "X"}]}')], "waste_type string, parsed_result string").withColumn("kaimai_hash", key)
    out = places.parsed_places(cells, cache)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Join")
    assert sorted((r.location, r.by, r.cell.groups[0].village) for r in out.collect()) == [("V k.", "answer", "X"), ("W k.", "rules", "W k.")]
