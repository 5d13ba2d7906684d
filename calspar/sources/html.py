"""HTML tables as rows of cells, with row and column spans filled."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: The widest span that browsers follow, across and down.
MOST_ACROSS, MOST_DOWN = 1000, 65_534


def span(value: str | None, most: int) -> int:
    return min(int(value), most) if value and value.strip().isdigit() and int(value) > 0 else 1


class Tables(HTMLParser):
    """tables: of each table, its rows; of each row, its cells as (text, rows spanned, columns spanned). A table within a cell is a table of its own."""

    def __init__(self, across: int = MOST_ACROSS, down: int = MOST_DOWN) -> None:
        super().__init__(convert_charrefs=True)
        self.across, self.down = across, down
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[list] = []  # of each open table: its open cell's texts and spans, or nothing

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
            self.cell.append([])
        elif not self.open:
            return
        elif tag == "tr":
            self.close_cell()
            self.open[-1].append([])
        elif tag in ("td", "th"):
            self.close_cell()
            if not self.open[-1]:
                self.open[-1].append([])
            given = dict(attrs)
            self.cell[-1] = [[], span(given.get("rowspan"), self.down), span(given.get("colspan"), self.across)]
        elif tag == "br" and self.cell[-1]:
            self.cell[-1][0].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table":
            self.open.pop()
            self.cell.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.cell[-1]:
            self.cell[-1][0].append(data)

    def close_cell(self) -> None:
        if self.cell[-1]:
            texts, down, across = self.cell[-1]
            self.open[-1][-1].append(("".join(texts).strip(), down, across))
            self.cell[-1] = []


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The rows as wide as the widest, spanned places filled with their cell's text, rows of blank cells dropped."""
    held: dict[int, tuple[str, int]] = {}  # column -> text, and for how many further rows
    out = []
    for row in rows:
        line: dict[int, str] = {k: text for k, (text, _) in held.items()}
        held = {k: (text, n - 1) for k, (text, n) in held.items() if n > 1}
        at = 0
        for text, down, across in row:
            for _ in range(across):
                while at in line:
                    at += 1
                line[at] = text
                if down > 1:
                    held[at] = (text, down - 1)
        out.append([line.get(k, "") for k in range(max(line, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [line + [""] * (width - len(line)) for line in out if any(line)]


def html_tables(pages: DataFrame, key: str, html: str, across: int = MOST_ACROSS, down: int = MOST_DOWN) -> DataFrame:
    """(key, t, r, cells) of every table of every page; a null page has none. Pages are parsed where they lie, without a shuffle. Wider spans than `across` and `down` count as so wide."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = Tables(across, down)
                reader.feed(page.as_py() or "")
                reader.close()
                rows = [(name, t, r, cells) for t, table in enumerate(reader.tables) for r, cells in enumerate(grid(table))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string())))], [key, "t", "r", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(work, f"{key} {kind}, t int, r int, cells array<string>")
