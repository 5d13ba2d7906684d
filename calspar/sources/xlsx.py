"""Spreadsheets: a sheet of XLSX files as rows of text cells, pulled from the packed XML row by row.

A file is never unpacked or parsed as a whole: what is held at once is the table of shared strings, one row and one batch.
`format("xlsx")` opens files where they lie, in a store that pyarrow reads by its address; `read_xlsx` takes their bytes
from any store that Spark reads.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Collection, Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .changed import listing, opened

#: The table of shared strings is refused beyond so many bytes once unpacked, so that a packed bomb can't fill a worker; sheets are pulled and have no such limit.
MOST_BYTES = 512 << 20
#: Workbooks are read in groups of so many bytes at most, as a task for each small one costs more than reading it; a larger one stands alone.
GROUP_BYTES = 1 << 20
#: Rows of a batch at most.
ROWS = 4096
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "file string, row long, cells array<string>, error string"
ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
BROKEN = (zipfile.BadZipFile, KeyError, ValueError, IndexError, EOFError, ElementTree.ParseError)


def column_index(reference: str) -> int:
    """The column of a cell reference: "B7" is 1."""
    k = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        k = 26 * k + ord(letter) - 64
    return k - 1


def text_of(node: ElementTree.Element) -> str:
    """All text runs under a node; phonetic ones don't count."""
    return "".join(t.text or "" for r in node for t in ([r] if r.tag == f"{MAIN}t" else r.findall(f"{MAIN}t") if r.tag == f"{MAIN}r" else []))


def pulled(source: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, one at a time; each is dropped with all before it once the next is asked for."""
    events = ElementTree.iterparse(source, ("start", "end"))
    open_: list[ElementTree.Element] = []
    for event, node in events:
        if event == "start":
            open_.append(node)
            continue
        open_.pop()
        if node.tag == tag:
            yield node
            if open_:
                open_[-1].clear()


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """The parts of the workbook's sheets by name, in the workbook's order; without a list of them, by their numbers."""
    parts = set(book.namelist())
    if "xl/workbook.xml" not in parts or "xl/_rels/workbook.xml.rels" not in parts:
        found = sorted((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        return {posixpath.basename(n): n for n in found}
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    named = {s.get("name", ""): posixpath.normpath(posixpath.join("/xl", targets[s.get(RELATION)])).lstrip("/") for s in sheets}
    return {name: part for name, part in named.items() if part in parts}


def sheet_rows(source: BinaryIO, sheet: str | None = None, columns: Collection[int] | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet, the workbook's first by default.

    A cell without a value is None; numbers are as they are written, and booleans TRUE or FALSE. columns: only these, from
    0, are read; the others are None, and a row ends with the last of them that it has.
    """
    with zipfile.ZipFile(source) as book:
        names = sheet_names(book)
        if not names:
            raise KeyError("no sheet")
        part = names[sheet] if sheet is not None else next(iter(names.values()))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            if book.getinfo("xl/sharedStrings.xml").file_size > MOST_BYTES:
                raise ValueError(f"xl/sharedStrings.xml unpacks to more than {MOST_BYTES} bytes")
            with book.open("xl/sharedStrings.xml") as f:
                shared = [text_of(item) for item in pulled(f, f"{MAIN}si")]
        at = 0
        with book.open(part) as f:
            for row in pulled(f, f"{MAIN}row"):
                at = int(row.get("r", at + 1))
                cells: list[str | None] = []
                place = -1
                for cell in row.iter(f"{MAIN}c"):
                    place = column_index(cell.get("r", "")) if cell.get("r") else place + 1
                    if columns is not None and place not in columns:
                        continue
                    cells += [None] * (place + 1 - len(cells))
                    value, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
                    if inline is not None:
                        cells[place] = text_of(inline)
                    elif value is not None and value.text is not None:
                        kind = cell.get("t")
                        cells[place] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text
                yield at, cells


def batches_of(file: str, source: BinaryIO, sheet: str | None, columns: Collection[int] | None) -> Iterator[pa.RecordBatch]:
    """The rows of a file in batches. Where it can't be read on there is a last row with the error and no cells."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)

    try:
        for at, cells in sheet_rows(source, sheet, columns):
            held.append((file, at, cells, None))
            if len(held) == ROWS:
                yield batch()
                held = []
    except BROKEN as e:
        held.append((file, 0, None, f"{type(e).__name__}: {e}"[:200]))
    if held:
        yield batch()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, columns: Collection[int] | None = None) -> DataFrame:
    """(file, row, cells, error) of a sheet of every workbook under a path of any store that Spark reads, a file a task at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches_of(file, io.BytesIO(content.as_py()), sheet, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(work, SCHEMA)


class Workbooks(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.sheet = options["path"], options.get("sheet")
        self.columns = {int(k) for k in options["columns"].split(",")} if options.get("columns") else None

    def partitions(self) -> list[Workbooks]:
        groups: list[Workbooks] = []
        held = 0
        for name, (_, size) in sorted(listing(self.folder, "*.xlsx").items()):
            if not groups or held + size > GROUP_BYTES:
                groups.append(Workbooks([]))
                held = 0
            groups[-1].names.append(name)
            held += size
        return groups

    def read(self, partition: Workbooks) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.folder)
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as f:
                # a file too short for an archive can't be sought in as zipfile does
                source = f if f.size() > zipfile.sizeEndCentDir else io.BytesIO(f.read())
                yield from batches_of(name, source, self.sheet, self.columns)


class Xlsx(DataSource):
    """format("xlsx") with the options path (a folder), sheet (a name; the first by default) and columns (numbers from 0, parted by commas; all by default): rows of SCHEMA, workbooks of GROUP_BYTES in all a task, or one larger one."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(dict(self.options))


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet, its cells as inline texts."""

    def cell(value: str | None) -> str:
        return "<c/>" if value is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    out = io.BytesIO()
    space = MAIN.strip("{}")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{"".join(f"<row>{"".join(map(cell, r))}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)


def with_headings(rows: DataFrame, names: list[str], heading_row: int = 2) -> DataFrame:
    """(file, row, names...): the cells below each file's heading row, under the columns whose heading is a name; a column that a file lacks is null."""
    # one reading of the files: a file's heading row is found among its rows
    heads = F.max(F.when(F.col("row") == heading_row, F.transform("cells", lambda c: F.trim(c)))).over(Window.partitionBy("file"))
    placed = rows.filter(F.col("row") >= heading_row).withColumn("heads", heads).filter((F.col("row") > heading_row) & F.col("heads").isNotNull())

    def under(name: str) -> Column:
        at = F.array_position("heads", name)
        return F.when(at > 0, F.get("cells", at.cast("int") - 1)).alias(name)

    return placed.select("file", "row", *[under(n) for n in names])


def structure_errors(rows: DataFrame, required: list[str], months: list[str], least: int = 6, heading_row: int = 2) -> DataFrame:
    """(file, error) of workbooks that can't be read, lack a required heading or have fewer than `least` month headings."""
    heads = rows.groupBy("file").agg(F.max("error").alias("error"), F.max(F.when(F.col("row") == heading_row, F.transform("cells", lambda c: F.trim(c)))).alias("heads"))
    none = F.array().cast("array<string>")
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce("heads", none))
    found = F.size(F.array_intersect(F.coalesce("heads", none), F.array(*map(F.lit, months))))
    error = F.coalesce("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))).when(found < least, F.concat(F.lit("too few month columns: "), found.cast("string"))))
    return heads.select("file", error.alias("error")).filter("error is not null")
