"""Workbooks: the order of their sheets, columns left out, broken files, and a sheet of a million rows in bounded memory."""

import io
import subprocess
import sys
import zipfile
from pathlib import Path

from calspar.sources import xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets, order=None, targets=None):
    """sheets: file number -> rows of cell texts; order: (name, file number) as the workbook lists them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in sheets.items():
            body = "".join(f"<row>{''.join(f'<c t=\"inlineStr\"><is><t>{c}</t></is></c>' if c is not None else '<c/>' for c in row)}</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        if order:
            z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}><sheets>{''.join(f'<sheet name=\"{n}\" sheetId=\"{k}\" r:id=\"r{k}\"/>' for n, k in order)}</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(f'<Relationship Id=\"r{k}\" Target=\"{(targets or {}).get(k, f'worksheets/sheet{k}.xml')}\"/>' for _, k in order)}</Relationships>")
    return out.getvalue()


def rows_of(data, **how):
    return list(xlsx.sheet_rows(io.BytesIO(data), **how))


def test_order_of_sheets():
    sheets = {1: [["one"]], 2: [["two"]], 10: [["ten"]]}
    assert rows_of(book(sheets)) == [(1, ["one"])]
    moved = book(sheets, [("B", 2), ("A", 1), ("C", 10)], {1: "/xl/worksheets/sheet1.xml"})
    assert rows_of(moved) == [(1, ["two"])]
    assert rows_of(moved, sheet="A") == [(1, ["one"])] and rows_of(moved, sheet="C") == [(1, ["ten"])]


def test_columns():
    data = book({1: [["a", "b", None, "d"], [], ["e"], [None, "f"]]})
    assert rows_of(data) == [(1, ["a", "b", None, "d"]), (2, []), (3, ["e"]), (4, [None, "f"])]
    assert rows_of(data, columns=[1]) == [(1, [None, "b"]), (2, []), (3, []), (4, [None, "f"])]


def test_source(spark, tmp_path):
    good = book({1: [["a", "1"], ["b", "2"]], 2: [["other"]]}, [("x", 1), ("y", 2)])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "g.xlsx").write_bytes(good)
    (tmp_path / "bad.xlsx").write_bytes(b"PK not a workbook")
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData><row><c><v>1</v></c></row><row>")
    (tmp_path / "cut.xlsx").write_bytes(broken.getvalue())
    (tmp_path / "note.txt").write_text("no workbook")
    xlsx.register(spark)
    got = sorted((r["file"], r["row"], r["cells"], (r["error"] or "").split(":")[0]) for r in spark.read.format("xlsx").option("path", str(tmp_path)).load().collect())
    assert got == [("bad.xlsx", 0, None, "BadZipFile"), ("cut.xlsx", 0, None, "ParseError"), ("cut.xlsx", 1, ["1"], ""), ("deep/g.xlsx", 1, ["a", "1"], ""), ("deep/g.xlsx", 2, ["b", "2"], "")]
    some = spark.read.format("xlsx").option("path", str(tmp_path / "deep")).option("columns", "1").option("sheet", "x").load()
    assert sorted(map(tuple, some.select("row", "cells").collect())) == [(1, [None, "1"]), (2, [None, "2"])]
    same = xlsx.read_xlsx(spark, str(tmp_path / "deep"), sheet="y")
    assert [tuple(r) for r in same.collect()] == [("g.xlsx", 1, ["other"], None)]


LONG = """
import io, resource, sys, zipfile
sys.path.insert(0, sys.argv[1])
from calspar.sources import xlsx
n, out = 1_000_000, io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
    f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
    for k in range(0, n, 1000):
        f.write(b"".join(b"<row><c><v>%d</v></c><c><v>7</v></c></row>" % i for i in range(k, k + 1000)))
    f.write(b"</sheetData></worksheet>")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = total = 0
for batch in xlsx.batches_of("f", out, None, [0]):
    rows += batch.num_rows
    total += sum(int(c[0]) for c in batch.column(2).to_pylist())
print(rows, total == n * (n - 1) // 2, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024 < 64)
"""


def test_a_million_rows():
    root = str(Path(__file__).resolve().parent.parent)
    said = subprocess.run([sys.executable, "-c", LONG, root], capture_output=True, text=True, timeout=300)
    assert said.stdout.split() == ["1000000", "True", "True"], said.stderr[-500:]
