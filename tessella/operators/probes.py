"""Bounded looks at a sheet or a band of a table, for helpers outside: each is a filtered scan whose size the caller names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions.cells import cell_text
from tessella.plans.ports import Tool

NUMBER = {"type": "integer"}


def _rows(frame: DataFrame) -> list[dict]:
    """Rows with their cells as text; the caller has bounded the frame."""
    return [{"row": r.row, "cells": list(r.c)} for r in frame.select("row", F.transform("cells", cell_text).alias("c")).orderBy("row").collect()]


def tail(rows: DataFrame, count: int, row: str = "row") -> DataFrame:
    """The last rows of a numbered table, as a top-k."""
    return rows.orderBy(F.desc(row)).limit(count)


def peek(rows: DataFrame, first: int, count: int, row: str = "row") -> DataFrame:
    """Rows by number, from first on."""
    return rows.where(F.col(row).between(first, first + count - 1))


@dataclass(frozen=True)
class SheetProbe:
    """A whole sheet; rows and columns are absolute and count from 1."""

    grid: DataFrame
    sheet: str

    @property
    def lines(self) -> DataFrame:
        return self.grid.where(F.col("sheet") == self.sheet)

    def dimensions(self) -> dict:
        rows, cols = self.lines.agg(F.max("row"), F.max(F.size("cells"))).first()
        return {"sheet": self.sheet, "n_rows": rows or 0, "n_cols": cols or 0}

    def peek_rows(self, start_row: int = 1, count: int = 20) -> list[dict]:
        return _rows(peek(self.lines, start_row, count))

    def peek_region(self, ref: str) -> list[dict]:
        r0, c0, r1, c1 = a1.parse_range(ref)
        return _rows(self.lines.where(F.col("row").between(r0, r1)).select("row", F.slice("cells", c0, c1 - c0 + 1).alias("cells")))

    def tools(self) -> list[Tool]:
        return [
            Tool("dimensions", "Number of rows and columns in use.", {"type": "object", "properties": {}}, lambda a: self.dimensions()),
            Tool("peek_rows", "Rows from start_row on, which counts from 1.", {"type": "object", "properties": {"start_row": NUMBER, "count": NUMBER}}, lambda a: {"rows": self.peek_rows(int(a.get("start_row", 1)), int(a.get("count", 20)))}),
            Tool("peek_region", "Cells of an A1 range.", {"type": "object", "properties": {"a1": {"type": "string"}}, "required": ["a1"]}, lambda a: {"rows": self.peek_region(str(a["a1"]))}),
        ]


@dataclass(frozen=True)
class BandProbe:
    """A band of a table: its header and the rows and columns it covers; looks outside are cut off at its edges, two rows above the header excepted."""

    grid: DataFrame
    sheet: str
    header_row: int
    row_start: int
    row_end: int
    col_start: int
    col_end: int
    above: int = 2

    def _cut(self, first: int, last: int, left: int | None = None, right: int | None = None) -> list[dict]:
        first, last = max(first, self.header_row - self.above, 1), min(last, self.row_end)
        left, right = max(left or self.col_start, self.col_start), min(right or self.col_end, self.col_end)
        if first > last or left > right:
            return []
        rows = self.grid.where((F.col("sheet") == self.sheet) & F.col("row").between(first, last))
        return _rows(rows.select("row", F.slice("cells", left, right - left + 1).alias("cells")))

    def geometry(self) -> dict:
        region = a1.range_text(self.header_row, self.col_start, self.row_end, self.col_end)
        return {"sheet": self.sheet, "region": region, "header_row": self.header_row, "data_row_start": self.row_start, "data_row_end": self.row_end, "n_data_rows": self.row_end - self.row_start + 1, "n_cols": self.col_end - self.col_start + 1, "col_start": self.col_start}

    def header_candidates(self, rows_above: int = 2) -> list[dict]:
        return self._cut(self.header_row - rows_above, self.header_row)

    def peek_rows(self, start: int = 0, count: int = 10) -> list[dict]:
        return self._cut(self.row_start + start, min(self.row_start + start + count - 1, self.row_end))

    def tail_rows(self, count: int = 5) -> list[dict]:
        return self._cut(max(self.row_start, self.row_end - count + 1), self.row_end)

    def column_values(self, col: int, count: int = 50) -> dict:
        """Header and first values of a column, which counts from 0 within the band; a column outside has neither."""
        if not 0 <= col <= self.col_end - self.col_start:
            return {"col_index": col, "header": None, "values": []}
        at = self.col_start + col
        head = self._cut(self.header_row, self.header_row, at, at)
        got = {r["row"]: (r["cells"] or [None])[0] for r in self._cut(self.row_start, self.row_start + count - 1, at, at)}
        values = [got.get(r) for r in range(self.row_start, min(self.row_end, self.row_start + count - 1) + 1)]
        return {"col_index": col, "header": (head[0]["cells"] or [None])[0] if head else None, "values": values}

    def peek_region(self, ref: str) -> list[dict]:
        r0, c0, r1, c1 = a1.parse_range(ref)
        return self._cut(r0, r1, c0, c1)

    def tools(self) -> list[Tool]:
        return [
            Tool("geometry", "Sheet, region, header row and rows of the band.", {"type": "object", "properties": {}}, lambda a: self.geometry()),
            Tool("header_candidates", "Rows from a few above the header to the header.", {"type": "object", "properties": {"rows_above": NUMBER}}, lambda a: {"rows": self.header_candidates(int(a.get("rows_above", 2)))}),
            Tool("peek_rows", "Data rows; start 0 is the first.", {"type": "object", "properties": {"start": NUMBER, "count": NUMBER}}, lambda a: {"rows": self.peek_rows(int(a.get("start", 0)), int(a.get("count", 10)))}),
            Tool("tail_rows", "The last data rows.", {"type": "object", "properties": {"count": NUMBER}}, lambda a: {"rows": self.tail_rows(int(a.get("count", 5)))}),
            Tool("column_values", "Header and first values of a column of the band.", {"type": "object", "properties": {"col": NUMBER, "count": NUMBER}, "required": ["col"]}, lambda a: self.column_values(int(a["col"]), int(a.get("count", 50)))),
            Tool("peek_region", "Cells of an A1 range, as far as it lies in the band.", {"type": "object", "properties": {"a1": {"type": "string"}}, "required": ["a1"]}, lambda a: {"rows": self.peek_region(str(a["a1"]))}),
        ]
