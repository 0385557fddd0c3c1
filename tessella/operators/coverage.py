"""Coverage of a sheet by table regions: covered and uncovered cells, connected pieces, interior gaps, detection findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.durable import durable


def coverage(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """sheet, total, covered, share. cells: sheet, row, col (not empty); regions: sheet, min_row, min_col, max_row, max_col.

    A sheet has few regions, so containment is an equi-join on the sheet with a range condition.
    """
    r = regions.select(F.col("sheet").alias("_s"), "min_row", "min_col", "max_row", "max_col")
    inside = (cells["sheet"] == F.col("_s")) & cells["row"].between(F.col("min_row"), F.col("max_row")) & cells["col"].between(F.col("min_col"), F.col("max_col"))
    hit = cells.join(r, inside, "left_semi").groupBy("sheet").agg(F.count("*").alias("covered"))
    total = cells.groupBy("sheet").agg(F.count("*").alias("total"))
    return total.join(hit, "sheet", "left").select("sheet", "total", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(F.try_divide(F.col("covered"), F.col("total")), F.lit(0.0)).alias("share"))


def uncovered(cells: DataFrame, regions: DataFrame) -> DataFrame:
    r = regions.select(F.col("sheet").alias("_s"), "min_row", "min_col", "max_row", "max_col")
    inside = (cells["sheet"] == F.col("_s")) & cells["row"].between(F.col("min_row"), F.col("max_row")) & cells["col"].between(F.col("min_col"), F.col("max_col"))
    return cells.join(r, inside, "left_anti")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of edges (u, v), by alternating large-star and small-star steps.

    Rounds go on until nothing changes; their number grows with the logarithm of a piece's length.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "touching")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = durable(small.select("e.u", "e.v").where("u <> v").distinct(), "touching")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def pieces(cells: DataFrame) -> DataFrame:
    """sheet, piece, min_row, min_col, max_row, max_col, n: eight-connected pieces of cells, of any size.

    Cells become runs (consecutive columns of a row); runs of neighbouring rows that touch, also by a corner, are edges, which are
    contracted to stars around the smallest run of each piece.
    """
    w = Window.partitionBy("sheet", "row").orderBy("col")
    runs = cells.select("sheet", "row", "col").distinct().withColumn("_g", F.col("col") - F.row_number().over(w)).groupBy("sheet", "row", "_g").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    runs = durable(runs.select("sheet", "row", "a", "b"), "runs")
    node = F.struct("sheet", "row", "a")
    up = runs.select("sheet", (F.col("row") + 1).alias("row"), F.col("a").alias("ua"), F.col("b").alias("ub"), node.alias("v"))
    touch = runs.join(up, ["sheet", "row"]).where((F.col("a") <= F.col("ub") + 1) & (F.col("ua") <= F.col("b") + 1)).select(node.alias("u"), "v")
    found = _smallest(touch).select("node.sheet", "node.row", "node.a", F.struct("label.row", "label.a").alias("_label"))
    labels = runs.join(found, ["sheet", "row", "a"], "left").withColumn("label", F.coalesce("_label", F.struct("row", "a")))
    return labels.groupBy("sheet", "label").agg(
        F.min("row").alias("min_row"), F.min("a").alias("min_col"), F.max("row").alias("max_row"), F.max("b").alias("max_col"), F.sum(F.col("b") - F.col("a") + 1).alias("n")
    )


def interior_gaps(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, blank_rows, blank_cols strictly inside each region. regions: region_id, sheet and bounds."""
    r = regions.withColumnRenamed("sheet", "_s")
    inside = cells.join(r, (cells["sheet"] == F.col("_s")) & cells["row"].between(F.col("min_row"), F.col("max_row")) & cells["col"].between(F.col("min_col"), F.col("max_col")))
    span = lambda low, high: F.greatest(F.col(high) - F.col(low) - 1, F.lit(0))
    seen = inside.groupBy("region_id").agg(
        F.countDistinct(F.when((F.col("row") > F.col("min_row")) & (F.col("row") < F.col("max_row")), F.col("row"))).alias("_r"),
        F.countDistinct(F.when((F.col("col") > F.col("min_col")) & (F.col("col") < F.col("max_col")), F.col("col"))).alias("_c"),
    )
    joined = regions.join(seen, "region_id", "left").fillna(0, ["_r", "_c"])
    return joined.select("region_id", (span("min_row", "max_row") - F.col("_r")).alias("blank_rows"), (span("min_col", "max_col") - F.col("_c")).alias("blank_cols"))


def rectangle_iou(a: str, b: str):
    """Intersection over union of two rectangles whose bounds are columns with the given prefixes; 0 if they are apart."""
    side = lambda lo, hi: F.greatest(F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)) + 1, F.lit(0))
    area = lambda p: (F.col(p + "max_row") - F.col(p + "min_row") + 1) * (F.col(p + "max_col") - F.col(p + "min_col") + 1)
    both = side("min_row", "max_row") * side("min_col", "max_col")
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0)).cast("double")
