"""Sheets as DataFrames: row numbers without a single-task sort, cells in long and wide form, region scans, transposed views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions.cells import cell, empty, kind_of
from tessella.operators.durable import durable


def with_row_number(frame: DataFrame, order_by: Sequence[str | Column], name: str = "row", first: int = 1) -> DataFrame:
    """Number rows in a total order, first, first + 1, ...

    Rows are dealt to ranges of the order and sorted inside each; a row's number is its place there plus the rows of the ranges
    before, so no task sees the whole table. The ranges, which are found by sampling, are written to the shared folder for the second pass, so that
    a lost executor changes no number. Rows that tie in the order keep the numbers that the first pass gave them.
    """
    ranged = durable(frame.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(F.col("_at"), 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = [], first
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    if not starts:
        return frame.withColumn(name, F.lit(None).cast("bigint"))
    # One row per partition.
    offsets = F.broadcast(frame.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    numbered = ranged.withColumn("_part", part).join(offsets, "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def numbered(frame: DataFrame, order_by: str) -> DataFrame:
    """Data rows of a sheet whose header is row 1: the first data row is 2."""
    return with_row_number(frame, [order_by], first=2)


def grid_of(frame: DataFrame, order_by: str, sheet: str) -> DataFrame:
    """The whole sheet: a header row of column names, then a row of tagged cells for each record."""
    rows = numbered(frame, order_by)
    cells = F.array(*(cell(F.col(f.name), kind_of(f.dataType)) for f in frame.schema.fields))
    data = rows.select(F.lit(sheet).alias("sheet"), F.col("row").cast("int").alias("row"), cells.alias("cells"))
    header = frame.sparkSession.range(1).select(F.lit(sheet).alias("sheet"), F.lit(1).alias("row"), F.array(*(cell(F.lit(c), "str") for c in frame.columns)).alias("cells"))
    return header.unionByName(data)


def grid_from_lists(spark, sheets: dict[str, list[list]], formulas: dict[tuple[str, int, int], str] | None = None) -> DataFrame:
    """A grid from Python rows, for small sheets: None is empty, rows may be ragged."""
    rows = []
    kinds = {bool: "bool", int: "int", float: "num", str: "str"}
    for sheet, lines in sheets.items():
        for r, line in enumerate(lines, 1):
            cells = []
            for c, v in enumerate(line, 1):
                kind = kinds.get(type(v), "ts" if v is not None else None)
                cells.append(tuple([kind, *(v if kind == k else None for k in ("num", "int", "str", "bool", "ts")), (formulas or {}).get((sheet, r, c))]))
            rows.append((sheet, r, cells))
    from tessella.functions.cells import GRID

    return spark.createDataFrame(rows, GRID)


def long_cells(grid: DataFrame) -> DataFrame:
    """sheet, row, col, cell of every cell that is not empty."""
    return grid.select("sheet", "row", F.posexplode("cells").alias("col", "cell")).withColumn("col", F.col("col") + 1).where(~empty(F.col("cell")))


def region(grid: DataFrame, sheet: str, ref: str) -> DataFrame:
    """The rows and cells inside an A1 range."""
    r0, c0, r1, c1 = a1.parse_range(ref)
    return grid.where((F.col("sheet") == sheet) & F.col("row").between(r0, r1)).select("sheet", "row", F.slice("cells", c0, c1 - c0 + 1).alias("cells"))


def transposed(grid: DataFrame) -> DataFrame:
    """The sheet with rows and columns swapped; ragged rows are padded with empty cells."""
    width = grid.groupBy("sheet").agg(F.max("row").alias("_rows"))
    turned = grid.select("sheet", F.posexplode("cells").alias("col", "cell"), "row").groupBy("sheet", F.expr("col + 1").cast("int").alias("row"))
    gathered = turned.agg(F.map_from_entries(F.collect_list(F.struct(F.col("row").cast("int").alias("k"), "cell"))).alias("at")).join(width, "sheet")
    return gathered.select("sheet", "row", F.transform(F.sequence(F.lit(1), F.col("_rows")), lambda i: F.try_element_at("at", i)).alias("cells"))


def unpivoted(frame: DataFrame, key: str, values: Sequence[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """One row for each record and value column, in one narrow pass."""
    return frame.unpivot([key], list(values), name, value)


def dimensions(grid: DataFrame) -> DataFrame:
    return grid.groupBy("sheet").agg(F.max("row").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"))


def plan_bands(tables: DataFrame, rows_per_band: int = 5000, cols_per_band: int = 40, most: int = 4) -> DataFrame:
    """table_id, axis, k, band, low, high (1-based, inclusive) from table_id, n_rows, n_cols.

    The axis with the larger pressure is cut into at most so many bands of equal step.
    """
    by_rows, by_cols = F.col("n_rows") / rows_per_band, F.col("n_cols") / cols_per_band
    axis = F.when(by_rows >= by_cols, "row").otherwise("col")
    n = F.when(axis == "row", F.col("n_rows")).otherwise(F.col("n_cols"))
    k = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.greatest(by_rows, by_cols)).cast("int")))
    step = F.ceil(n / k)
    planned = tables.select("table_id", axis.alias("axis"), n.cast("bigint").alias("n"), k.alias("k"), step.cast("bigint").alias("step"))
    return planned.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("band")).where(F.col("band") * F.col("step") < F.col("n")).select(
        "table_id", "axis", "k", "band", (F.col("band") * F.col("step") + 1).alias("low"), F.least((F.col("band") + 1) * F.col("step"), F.col("n")).alias("high")
    )


def stride_hit(place: Column, n: Column, size: int, full: int | None = None) -> Column:
    """Whether a place (from 0) among n belongs to a sample of about size at even strides, first and last included; all do if n is full or less.

    Half places round to even. A sample of one is the first and the last.
    """
    every = n <= F.lit(max(size, full or 0))
    if size <= 1:
        return every | place.isin(0) | (place == n - 1)
    step = (n - 1) / F.lit(float(size - 1))
    # A place is taken if it is the rounding of one of its neighbouring strides.
    near = F.floor(F.try_divide(place, step))
    hits = [(F.bround((near + d) * (n - 1).cast("double") / F.lit(float(size - 1)), 0) == place) & (near + d <= size - 1) for d in (0, 1)]
    return every | F.coalesce(hits[0] | hits[1], F.lit(False))


def stride_sample(frame: DataFrame, size: int, place: str = "i", total: int | None = None) -> DataFrame:
    """Rows at evenly spaced places, the first and last among them; place counts from 0."""
    n = frame.count() if total is None else total
    return frame.where(stride_hit(F.col(place), F.lit(n), size))


def sheets(grid: DataFrame) -> DataFrame:
    """sheet and sheet_idx (from 0) in the order of the workbook; grids that do not know it are ordered by name."""
    if "sheet_idx" in grid.columns:
        return grid.where("sheet is not null").groupBy("sheet").agg(F.min("sheet_idx").cast("int").alias("sheet_idx"))
    names = grid.where("sheet is not null").select("sheet").distinct()
    return with_row_number(names, ["sheet"], "sheet_idx", 0).select("sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"))


def point(grid: DataFrame, sheet: str, row: int, col: int) -> DataFrame:
    """One cell; no row where the sheet has none. Cells beyond a ragged row's end are empty."""
    return grid.where((F.col("sheet") == sheet) & (F.col("row") == row)).select("sheet", "row", F.lit(col).alias("col"), F.try_element_at("cells", F.lit(col)).alias("cell"))


def formulas(grid: DataFrame, sheet: str | None = None, ref: str | None = None) -> DataFrame:
    """sheet, row, col and formula of the cells that hold one, within a sheet and an A1 range if given."""
    rows = grid if sheet is None else grid.where(F.col("sheet") == sheet)
    out = rows.select("sheet", "row", F.posexplode("cells").alias("col", "cell")).select("sheet", "row", (F.col("col") + 1).alias("col"), F.col("cell.formula").alias("formula")).where("formula is not null")
    if ref:
        r0, c0, r1, c1 = a1.parse_range(ref)
        out = out.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def snapshot(grid: DataFrame) -> DataFrame:
    """The grid as it is now, in the shared folder: what is read from it does not change while it is checked."""
    return durable(grid, "snapshot")


def as_grid(spark: SparkSession, source: object, order_by: str | None = None, sheet: str = "sheet") -> DataFrame:
    """A grid from a grid, from a table (with the column that orders its rows), from a path of workbooks, or from {"main": path}; else TypeError."""
    from tessella.sources.workbook import read_workbooks

    if isinstance(source, DataFrame):
        if {"sheet", "row", "cells"} <= set(source.columns):
            return source
        if order_by is None:
            raise TypeError("a table needs order_by, the column that orders its rows")
        return grid_of(source, order_by, sheet)
    if isinstance(source, dict) and set(source) == {"main"}:
        source = source["main"]
    if isinstance(source, str):
        return read_workbooks(spark, source)
    raise TypeError(f"neither a grid nor a path: {type(source).__name__}")


def islands(frame: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """Gaps and islands: rows with consecutive numbers share `_island`."""
    return frame.withColumn("_island", F.col(order) - F.row_number().over(Window.partitionBy(*partition).orderBy(order)))
