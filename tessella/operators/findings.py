"""Findings: one row for each problem of the data, and the checks that look at a sheet beside its tables.

A table is free of errors if it has no finding of severity error; sheet findings belong to no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.a1 import cell_text, letters_column
from tessella.functions.cells import empty
from tessella.operators import coverage as C
from tessella.operators import detect as D
from tessella.operators.durable import durable

FINDING = "table_id string, sheet string, category string, severity string, scope string, message string, source string, ref string, agent_action string, resolution string"
NAMES = [part.split()[0] for part in FINDING.split(", ")]
#: Text of a heading that reads as a value: currency, parentheses, percent, digits with marks. Fixed value.
VALUE_TEXT = r"^\s*[\$€£]?\(?-?[\d.,]+\)?\s*%?\s*$"


def finding(frame: DataFrame, category: Column | str, severity: str, scope: str, message: Column | str, ref: Column | None = None, source: str = "static", table: bool = True) -> DataFrame:
    """Findings of a frame that has sheet and, for findings of tables, table_id."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return frame.select(
        (F.col("table_id") if table else none).alias("table_id"), "sheet", lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), lit(message).alias("message"),
        F.lit(source).alias("source"), (none if ref is None else ref).alias("ref"), none.alias("agent_action"), F.lit("open").alias("resolution"),
    )


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def region_of(*prefix: str) -> Column:
    p = prefix[0] if prefix else ""
    return F.concat(cell_text(F.col(f"{p}min_row"), F.col(f"{p}min_col")), F.lit(":"), cell_text(F.col(f"{p}max_row"), F.col(f"{p}max_col")))


def at(place: Column) -> Column:
    return F.concat(F.col("sheet"), F.lit("!"), place)


def loose_blocks(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """sheet and bounds of the pieces outside all tables of their sheet of which the first row can be a header (over the whole box)."""
    apart = C.pieces(_outside(grid, handles))
    boxes = durable(apart.select("sheet", "min_row", "min_col", "max_row", "max_col", F.concat_ws(":", F.lit("box"), "sheet", "min_row", "min_col").alias("box")), "boxes")
    rows = grid.select("sheet", F.col("row"), "cells").join(boxes, "sheet").where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    part = rows.select(F.col("box").alias("sheet"), (F.col("row") - F.col("min_row") + 1).cast("int").alias("row"), F.expr("slice(cells, min_col, max_col - min_col + 1)").alias("cells"))
    heads = D.row_profile(part).where("row = 1 and candidate").select(F.col("sheet").alias("box"))
    return boxes.join(heads, "box", "left_semi").drop("box")


def _outside(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """sheet, row, col of the cells outside all tables of their sheet, picked in each row before it is spread; a sheet has few tables."""
    regions = handles.groupBy("sheet").agg(F.collect_list(F.struct("min_row", "min_col", "max_row", "max_col")).alias("_regions"))
    inside = lambda col: F.coalesce(F.exists("_regions", lambda r: F.col("row").between(r["min_row"], r["max_row"]) & col.between(r["min_col"], r["max_col"])), F.lit(False))
    # Most rows lie within a table from end to end, which their length alone tells.
    wide = durable(handles.where("min_col <= 1").select(F.col("sheet").alias("_s"), "min_row", "max_row", "max_col"), "wide")
    rows = grid.join(wide, (grid["sheet"] == F.col("_s")) & grid["row"].between(F.col("min_row"), F.col("max_row")) & (F.size(grid["cells"]) <= F.col("max_col")), "left_anti")
    rows = D.row_counts(rows).select("sheet", "row", "cols").join(durable(regions, "regions"), "sheet", "left")
    return rows.select("sheet", "row", F.explode(F.filter("cols", lambda c: ~inside(c))).alias("col"))


def sheet_findings(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """uncovered-data: blocks outside the tables that look like a table that was dropped."""
    loose = loose_blocks(grid, handles)
    return finding(loose, "uncovered-data", "error", "sheet", F.concat(F.lit("a block that looks like a table lies outside the tables, at "), at(region_of())), at(region_of()), table=False)


def table_findings(cells: DataFrame, handles: DataFrame) -> DataFrame:
    """empty-header-corner, false-header-span and transpose-suspected.

    cells: table_id, row, col, cell (not empty) of each handle's region, of which the first header row, the row below and the first column count; handles: table_id, sheet, header_row, span, bounds.
    """
    h = handles.select("table_id", "sheet", "header_row", "span", "min_row", "min_col", "max_row", "max_col")
    placed = h.select("table_id", "header_row", "min_col").join(cells.select("table_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "cell"), "table_id")
    text = F.col("cell.kind") == "str"
    value_like = F.col("cell.kind").isin("num", "int", "bool") | (text & F.col("cell.str").rlike(VALUE_TEXT))
    head, leaf, first = F.col("_r") == F.col("header_row"), F.col("_r") == F.col("header_row") + 1, F.col("_c") == F.col("min_col")
    below = first & (F.col("_r") > F.col("header_row"))
    # Cells are counted before they meet the handles, so that a large table's cells stay where they are.
    some = F.count_if
    counts = placed.groupBy("table_id").agg(
        some(head & first).alias("corner"), some(head & ~first).alias("top"), some(head & ~first & ~text).alias("top_other"), some(below).alias("left_"), some(below & ~text).alias("left_other"),
        some(leaf).alias("leafs"), some(leaf & value_like).alias("values"),
    )
    seen = durable(h.join(counts, "table_id", "left").fillna(0, [c for c in counts.columns if c != "table_id"]), "corners")
    cornerless = seen.where("corner = 0")
    out = finding(cornerless, "empty-header-corner", "error", "table", F.concat(F.lit("the first header cell is empty at "), at(cell_text(F.col("header_row"), F.col("min_col")))), at(cell_text(F.col("header_row"), F.col("min_col"))))
    swallowed = seen.where((F.col("span") >= 2) & (F.col("leafs") > 0) & (F.col("values") >= F.greatest(F.lit(1), F.floor(F.col("leafs") / 2))))
    out = out.union(finding(swallowed, "false-header-span", "error", "table", F.concat(F.lit("row "), (F.col("header_row") + 1).cast("string"), F.lit(" of the header holds values; a row of data was taken for a header")), at(region_of())))
    turned = cornerless.where("left_ > 0 and left_other = 0 and top > 0 and top_other = 0")
    message = F.concat(F.lit("may be transposed: labels run down column "), letters_column(F.col("min_col")), F.lit(" and across row "), F.col("header_row").cast("string"))
    return out.union(finding(turned, "transpose-suspected", "warning", "table", message, at(region_of())))


def filled(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """table_id, row, col, cell of the cells, not empty ones, inside each handle's region."""
    bounds = handles.select("table_id", "sheet", "min_row", "min_col", "max_row", "max_col")
    rows = grid.join(bounds, "sheet").where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    cells = rows.select("table_id", "row", "min_col", "max_col", F.posexplode("cells").alias("_i", "cell")).withColumn("col", F.col("_i") + 1)
    return cells.where(F.col("col").between(F.col("min_col"), F.col("max_col")) & ~empty(F.col("cell"))).select("table_id", "row", "col", "cell")


def merged_notes(findings: DataFrame) -> DataFrame:
    """Findings with the same reference, category and message once: the first in severity's order."""
    return findings.dropDuplicates(["table_id", "sheet", "category", "message", "ref"])
