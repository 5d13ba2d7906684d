"""Sheets, HTML tables, sections, checks, and the way of a sheet into the tables, against literal cases."""

import datetime
import io
import zipfile

import pytest
from calspar.functions.dates import MONTHS
from calspar.operators import ingest, sections, store, streams
from calspar.sources import html, xlsx
from pyspark.sql import functions as F

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
STRINGS = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{}</sst>'
D = datetime.date


def workbook(rows):
    """A small XLSX: odd columns as shared strings, even ones inline, numbers as numbers."""
    shared, lines = [], []
    for k, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            at = f"{chr(65 + c)}{k}"
            if value is None:
                continue
            if isinstance(value, int):
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
            elif c % 2:
                cells.append(f'<c r="{at}" t="s"><v>{len(shared)}</v></c>')
                shared.append(f"<si><r><t>{value[:2]}</t></r><r><t>{value[2:]}</t></r></si>")
            else:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>')
        lines.append(f'<row r="{k}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format("".join(lines)))
        book.writestr("xl/sharedStrings.xml", STRINGS.format("".join(shared)))
    return out.getvalue()


HEADS = ["Seniūnija", "Kaimai", *MONTHS[:6]]
ROWS = [
    ["title"], HEADS,
    [None, "Be seniūnijos", "1 d."], ["Gojaus", "Pavilnė", "8 d., 22 d.", None, 5], [None, "Gojus (Žvejų skg., Rasos g.)", None, "3 d."], [" ", "  ", "4 d."], [None, "Tuščia"],
    ["Užupio", "Užupis, Upės g.", "1 d."], [None, "Perkūno g. 3, 15", "2 d."],
]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(ROWS))
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "c.xlsx").write_bytes(workbook([["t"], ["Kaimai", "Sausio"]]))
    rows = xlsx.read_xlsx(spark, str(tmp_path))
    errors = {r["file"]: r["error"] for r in xlsx.structure_errors(rows, ["Seniūnija", "Kaimai"], MONTHS).collect()}
    assert set(errors) == {"b.xlsx", "c.xlsx"} and errors["b.xlsx"].startswith("BadZipFile") and errors["c.xlsx"] == "missing columns: Seniūnija"
    sheet = xlsx.with_headings(rows.filter("error is null"), HEADS).select("file", "row", F.col("Seniūnija").alias("seniunija"), F.col("Kaimai").alias("kaimai"), *MONTHS[:6])
    got = sorted(tuple(r)[2:] for r in ingest.sheet_schedules(sheet, MONTHS[:6]).collect())
    want = [("Gojaus", "Gojus", s, None, [D(2026, 2, 3)], ROWS[4][1]) for s in ("Rasos g.", "Žvejų skg.")] + [("Gojaus", "Pavilnė", "", None, [D(2026, 1, 8), D(2026, 1, 22), D(2026, 3, 5)], "Pavilnė")]
    assert got == sorted(want)
    empty = spark.createDataFrame([], "key string, parsed_result string")
    assert {r["village"] for r in ingest.sheet_schedules(sheet, MONTHS[:6], cache=empty).collect()} == {"Gojus", "Pavilnė", "Perkūno g. 3, 15"}


def test_html_spans(spark):
    page = """<p>x</p><table><tr><th rowspan=2>A</th><th colspan="2">B</th></tr><tr><td>c<br>d</td></tr><tr><td></td></tr>
    <tr><td>e<table><tr><td>in &amp; out</td></tr></table><td>f</tr></table><table><tr><td>last"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "doc int, html string")
    got = sorted(map(tuple, html.html_tables(pages, "doc", "html").collect()))
    assert got == [(1, 0, 0, ["A", "B", "B"]), (1, 0, 1, ["A", "c\nd", ""]), (1, 0, 2, ["e", "f", ""]), (1, 1, 0, ["in & out"])]


def rows_of(spark, tables):
    rows = [(1, t, r, cells) for t, table in enumerate(tables) for r, cells in enumerate(table)]
    return spark.createDataFrame(rows, "doc int, t int, r int, cells array<string>")


def test_sections(spark):
    head = ["Seniūnijos pavadinimas", "Atliekos", "Sausio", "Vasario", "Kovo"]
    tables = [
        [["Antra k.", "Stiklas", "1 d.", "", ""], head, ["Gojus k.", "Pakuotė", "2 d.", "", ""], ["Ilgas", "", "", "", ""], ["vardas k.", "", "3 d.", "4 d.", ""], ["Parengė : x", "", "", "", ""]],
        [["Be antraštės k.", "", "", "5 d.", ""]],
        [["Kita k.", "Stiklas", "6 d."]],
        [["Gyvenvietės pavadinimas", "Atliekos", "Sausio", "Vasario"], ["Poslinkis k.", "Stiklas", "7 d.", ""]],
        [["Gyvenvietės pavadinimas", "Atliekos", "", ""], ["", "", "Sausio", "Vasario"], ["Dviejų eilučių k.", "Stiklas", "7 d.", ""]],
        [["Gyvenvietės pavadinimas", "Atliekos", "Sausio", ""], ["Blogas k.", "Stiklas", "8 d.", ""], ["Gegužės", "", "", ""]],
        [["x"] * 20],
    ]
    got = sorted(tuple(r)[1:] for r in sections.table_schedules(rows_of(spark, tables)).collect())
    assert got == [
        (0, 0, 0, "Antra k.", "stiklas", [D(2026, 1, 1)], None),
        (0, 1, 2, "Gojus k.", "plastikas", [D(2026, 1, 2)], None),
        (0, 1, 3, "Ilgas vardas k.", "plastikas", [D(2026, 1, 3), D(2026, 2, 4)], None),
        (1, 0, 0, "Be antraštės k.", "bendros", [D(2026, 2, 5)], None),
        (2, 0, 0, "Kita k.", "stiklas", [D(2026, 1, 6)], None),
        (3, 1, 1, "Poslinkis k.", "stiklas", [D(2026, 2, 7)], None),
        (4, 1, 2, "Dviejų eilučių k.", "stiklas", [D(2026, 1, 7)], None),
        (5, 1, 1, "Blogas k.", "stiklas", [D(2026, 2, 8)], "unexpected month headers"),
    ]


def test_fused_heading(spark):
    fused = ["Seniūnijos pavadinimas (gyvenvietės pavadinimas) Gojaus sen. Rasos k.", "Atliekos Stiklas", "2026 m. Sausio 9 d.", "Vasario", "Kovo"]
    parts = [r["cells"] for r in sections.parted(rows_of(spark, [[fused]])).orderBy("half").collect()]
    assert parts[0][0] == sections.FIRST_HEADING and parts[0][1:] == fused[1:] and parts[1] == ["Gojaus sen. Rasos k. Stiklas 9 d.", "", "", "", ""]


def test_answers(spark):
    good = '{"village": "V", "streets": [{"street": "A g.", "house_numbers": "7"}]}'
    texts = {"plain": good, "fenced": f"```json\n{good}\n```", "listed": f"[{good}]", "village": '{"village": " ", "streets": []}', "streets": '{"village": "V"}', "name": '{"village": "V", "streets": [{"street": ""}]}',
        "houses": '{"village": "V", "streets": [{"street": "A", "house_numbers": "m"}]}', "broken": "{", "none": None}
    cache = spark.createDataFrame(list(texts.items()), "key string, parsed_result string")
    assert {r["key"] for r in ingest.answers(cache).collect()} == {"plain", "fenced", "listed"}


def test_source_plan_can_be_forced(spark):
    log = spark.createDataFrame([(1, "xlsx", "u", "e", None, 5, "h", "success", 1)], "id int, kind string, source_url string, etag string, last_modified string, content_length int, content_hash string, status string, created_at int")
    heads = log.drop("id", "status", "created_at")
    assert [r["action"] for f in (False, True) for r in ingest.source_plan(heads, log, f).collect()] == ["unchanged", "fetch"]
    assert ingest.source_plan(heads.withColumn("etag", F.lit("other")), log).first()["action"] == "parsed"




def now():
    return F.lit("2026-01-01").cast("timestamp")


STREAMS = "id string, waste_type string, dates_hash string, dates array<date>, first_date date, last_date date, date_count long, calendar_id string, calendar_synced_at timestamp, pending_clean_started_at timestamp, pending_clean_until timestamp, pending_clean_notice_sent_at timestamp, created_at timestamp, updated_at timestamp"
GROUPS = "id string, kaimai_hash string, waste_type string, dates array<date>, dates_hash string, first_date date, last_date date, date_count long"
T = datetime.datetime(2025, 1, 1)


def stream(name, pattern, day, synced=T, calendar="cal"):
    return (name, "bendros", pattern, [day], day, day, 1, calendar, synced, None, None, None, T, T)


def group(name, pattern, day):
    return (name, f"k{name}", "bendros", [day], pattern, day, day, 1)


def test_reconcile(spark):
    """Taken over in place, split, left without groups, untouched; a second run changes nothing."""
    a, b = D(2026, 1, 5), D(2026, 2, 6)
    held = spark.createDataFrame([stream("moves", "p1", a), stream("splits", "p2", a), stream("empty", "p3", a), stream("same", "p4", b)], STREAMS)
    links = spark.createDataFrame([("g1", "moves"), ("g2", "splits"), ("g3", "splits"), ("g5", "same")], "schedule_group_id string, calendar_stream_id string")
    groups = spark.createDataFrame([group("g1", "new", b), group("g2", "p4", b), group("g3", "other", a), group("g5", "p4", b)], GROUPS)
    after, linked = streams.reconcile(held, links, groups, now())
    rows = {r["id"]: r for r in after.collect()}
    to = {r[0]: r[1] for r in linked.collect()}
    assert rows["moves"]["dates_hash"] == "new" and rows["moves"]["calendar_id"] == "cal" and rows["moves"]["calendar_synced_at"] is None and rows["moves"]["dates"] == [b]
    assert rows["same"]["calendar_synced_at"] == T and rows["same"]["updated_at"] == T
    for left in ("splits", "empty"):
        assert rows[left]["pending_clean_until"] - rows[left]["pending_clean_started_at"] == datetime.timedelta(days=4)
    made = set(rows) - {"moves", "splits", "empty", "same"}
    assert len(made) == 1 and rows[made.copy().pop()]["dates_hash"] == "other"
    assert to == {"g1": "moves", "g2": "same", "g3": made.pop(), "g5": "same"}
    again, linked_again = streams.reconcile(after, linked, groups, now() + F.expr("interval 1 day"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str) and sorted(map(tuple, linked_again.collect())) == sorted(map(tuple, linked.collect()))
    swapped = streams.replace_links(linked, spark.createDataFrame([("g1", None), ("g2", "moves")], "schedule_group_id string, calendar_stream_id string"))
    assert {r[0]: r[1] for r in swapped.collect()} == {k: v for k, v in to.items() if k != "g1"} | {"g2": "moves"}


def test_way_into_the_tables(spark, tmp_path):
    versions = store.Versions(spark, str(tmp_path / "model"))
    group_columns = GROUPS + ", calendar_synced_at timestamp, created_at timestamp, updated_at timestamp"
    versions.commit({"groups": spark.createDataFrame([], group_columns), "locations": spark.createDataFrame([], "seniunija string, village string, street string, house_numbers string, kaimai_hash string, updated_at timestamp"),
        "streams": spark.createDataFrame([], STREAMS), "links": spark.createDataFrame([], "schedule_group_id string, calendar_stream_id string"), "fetches": spark.createDataFrame([], "source string, status string, created_at timestamp")})
    kind = "seniunija string, village string, street string, house_numbers string, dates array<date>, kaimai_str string"
    first = [("S", "V", "", None, [D(2026, 1, 5)], "V"), ("S", "W", "A g.", None, [D(2026, 1, 5)], "W (A g.)"), ("S", "W", "B g.", "1-9", [D(2026, 1, 5)], "W (A g.)")]
    assert ingest.write_schedules(versions, spark.createDataFrame(first, kind), "bendros", now(), "one.xlsx")
    count = lambda t: versions.read(t).count()
    assert (count("groups"), count("locations"), count("streams"), count("links"), count("fetches")) == (2, 3, 1, 2, 1)
    assert ingest.write_schedules(versions, spark.createDataFrame(first, kind), "bendros", now(), "one.xlsx")
    assert (count("groups"), count("locations"), count("streams"), count("links"), count("fetches")) == (2, 3, 1, 2, 2)  # a null in the key adds no row
    moved = [first[0][:4] + ([D(2026, 3, 9)],) + first[0][5:]] + first[1:]
    assert ingest.write_schedules(versions, spark.createDataFrame(moved, kind), "bendros", now(), "two.xlsx")
    assert count("streams") == 3 and versions.read("streams").filter("pending_clean_started_at is not null").count() == 1 and count("links") == 2
    before = versions.read("groups").collect()
    bad = [("S", "", "", None, [D(2026, 1, 5)], "x")]
    assert not ingest.write_schedules(versions, spark.createDataFrame(bad, kind), "bendros", now(), "bad.xlsx")
    assert versions.read("groups").collect() == before and versions.read("fetches").filter("status = 'validation_error'").count() == 1

    def refuse(folder):
        raise ValueError(folder)

    at = versions.current()
    with pytest.raises(ValueError):
        versions.commit({"groups": versions.read("groups").limit(0)}, refuse)
    assert versions.current() == at and versions.read("groups").count() == 2


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r["k"], r["id"]) for r in store.surrogate_ids(rows, ["k"], 5).collect())
    assert got == [(k, k + 5) for k in range(1000)]


def test_better_parse(spark):
    kind = "seniunija string, village string, street string, dates array<date>, k int"
    bad, good = (spark.createDataFrame([("S", v, "", [D(2026, 1, 5)], 1)], kind) for v in ("A (B g.", "A"))
    assert ingest.better_parse(bad, good, "k") is good and ingest.better_parse(bad, bad, "k") is bad
