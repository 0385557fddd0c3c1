"""Finding the table on a sheet: header candidates, banners, two-row headers, edges; and the types of its columns.

All steps are window functions and conditional aggregates by sheet; sheets are independent, so any number of them is one job.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.a1 import cell_text, letters_column
from tessella.functions.cells import empty, number_text, numeric
from tessella.operators.durable import durable


#: Rows that one number marks, a bit each.
MARKED = 62


def first_unmarked(marks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys and gap: for each of spans (keys, length), the first place (from 0) below its length that is not among marks (keys, place); none if all are.

    Places meet as bits of a number for MARKED of them, which combine before the shuffle, so that no task spreads or sorts a long table's rows.
    """
    lost = unmarked(marks, spans, keys)
    return lost.groupBy(*keys).agg(F.min(F.col("_b") * MARKED + F.array_min("_free")).alias("gap"))


def unmarked(marks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _b and _free (places from 0 within the part _b of MARKED places) of the parts of spans that marks do not fill."""
    place = F.col("place").cast("bigint")
    bits = marks.groupBy(*keys, F.floor(place / MARKED).alias("_b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % MARKED).cast("int"))).alias("_bits"))
    parts = spans.where("length > 0").select(*keys, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / MARKED).cast("bigint"))).alias("_b"))
    both = parts.join(bits, [*keys, "_b"], "left").withColumn("_size", F.least(F.lit(MARKED), F.col("length") - F.col("_b") * MARKED).cast("int"))
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_size")) - 1
    open_ = both.where(F.col("_bits").isNull() | (F.col("_bits").bitwiseAND(full) != full))
    free = F.filter(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.call_function("shiftright", F.coalesce("_bits", F.lit(0).cast("bigint")), i).bitwiseAND(F.lit(1).cast("bigint")) == 0)
    return open_.select(*keys, "_b", free.alias("_free"))


def row_counts(grid: DataFrame) -> DataFrame:
    """sheet, row, n (values), s (texts), num (numbers and number texts), cols (of the values, ascending) of the rows that the grid has."""
    # Only two fields of the cells are read, and turned to a digit for each cell: 0 empty, 1 other, 2 text, 3 number, 4 number text.
    text = lambda s: F.when(s == "", 0).when(number_text(s), 4).otherwise(2)
    digit = lambda k, s: F.when(k.isNull(), 0).when(k == "str", text(s)).when(k.isin("num", "int"), 3).otherwise(1)
    kinds = grid.select("sheet", "row", F.col("cells.kind").alias("_kinds"), F.col("cells.str").alias("_texts"))
    rows = kinds.select("sheet", "row", F.zip_with("_kinds", "_texts", digit).alias("_d"))
    count = lambda *digits: F.size("_d") - F.size(functools.reduce(F.array_remove, digits, F.col("_d")))
    return rows.select("sheet", "row", count(1, 2, 3, 4).alias("n"), count(2, 4).alias("s"), count(3, 4).alias("num"), F.array_compact(F.transform("_d", lambda d, i: F.when(d > 0, (i + 1).cast("int")))).alias("cols"))


def _verdicts(counts: DataFrame, ends: DataFrame) -> DataFrame:
    """The profile of rows 1 to _shown of each sheet. ends: sheet, _shown, _filled (the sheet's last row with values)."""
    every = ends.select("sheet", F.explode(F.sequence(F.lit(1), "_shown")).alias("row"))
    dense = every.join(counts.select("sheet", "row", "n", "s", "num"), ["sheet", "row"], "left").fillna(0, ["n", "s", "num"])
    # Neighbours meet by a join on the row number, so that no task holds a whole sheet.
    dense = durable(dense, "rows")
    after = dense.select("sheet", (F.col("row") - 1).alias("row"), F.col("n").alias("next_n"), F.col("num").alias("next_num"))
    looked = dense.join(after, ["sheet", "row"], "left").join(ends.select("sheet", "_filled"), "sheet", "left")
    banner = (F.col("n") == 1) & F.col("next_n").isNotNull() & ((F.col("next_n") == 0) | (F.col("next_n") > 1))
    candidate = ~banner & _heading() & F.coalesce(F.col("_filled") > F.col("row"), F.lit(False))
    leaf = (F.col("n") >= 2) & (F.col("s") == F.col("n")) & (F.coalesce("next_num", F.lit(0)) > 0)
    return looked.select("sheet", "row", "n", "s", "num", banner.alias("banner"), F.coalesce(candidate, F.lit(False)).alias("candidate"), leaf.alias("leaf"))


def _heading() -> Column:
    return (F.col("n") > 0) & (F.col("s") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))


def _ends(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sheet").agg(F.max("row").alias("_last"), F.max(F.when(F.col("n") > 0, F.col("row"))).alias("_filled"))


def row_profile(grid: DataFrame) -> DataFrame:
    """For each row of a sheet, blank ones too: n (values), s (texts), num (numbers and number texts), what the next row has, and the verdicts.

    banner: one value, and the next row is blank or has several. candidate: not a banner, texts are half of the values or
    more, and some later row has values. leaf: only texts, two or more, and the next row has a number.
    """
    counts = row_counts(grid)
    return _verdicts(counts, _ends(counts).withColumn("_shown", F.col("_last")))


def detect_tables(grid: DataFrame) -> DataFrame:
    """One handle per sheet: header_row, span, min_row, min_col, max_row, max_col, ambiguous, reason. A sheet without a header is A1:A1 and ambiguous."""
    counts = durable(row_counts(grid).withColumn("low", F.try_element_at("cols", F.lit(1))).withColumn("high", F.try_element_at("cols", F.lit(-1))), "counts")
    # A row of several values, half of them texts, above the last values is a candidate whatever the next row holds: the header is not below the first such row.
    ends = durable(_ends(counts), "ends")
    sure = counts.where((F.col("n") > 1) & _heading()).join(ends, "sheet").where("row < _filled").groupBy("sheet").agg(F.min("row").alias("_sure"))
    shown = durable(ends.join(sure, "sheet", "left").withColumn("_shown", F.coalesce(F.least("_last", F.col("_sure") + 2), F.col("_last"))), "ends")
    top = counts.join(shown.select("sheet", "_shown"), "sheet").where("row <= _shown")
    rows = durable(_verdicts(top, shown), "rows")
    head = rows.groupBy("sheet").agg(F.min(F.when(F.col("candidate"), F.col("row"))).alias("header_row")).join(ends.select("sheet", "_last"), "sheet")
    second = rows.where("leaf").select(F.col("sheet").alias("_sheet"), F.col("row").alias("_leaf"))
    head = head.join(second, (F.col("sheet") == F.col("_sheet")) & (F.col("_leaf") == F.col("header_row") + 1), "left")
    head = durable(head.select("sheet", "header_row", "_last", F.when(F.col("_leaf").isNull(), 1).otherwise(2).alias("span")), "heads")
    data_start = F.col("header_row") + F.col("span")
    placed = counts.join(head.select("sheet", "header_row", data_start.alias("_start")), "sheet").where("row >= header_row")
    named = durable(placed.where("row < _start").groupBy("sheet").agg(F.max("high").alias("_named")), "named")

    def end_of(limit: DataFrame, name: str) -> DataFrame:
        """The row before the first row of data that is blank in columns 1 to limit."""
        used = placed.where("row >= _start").join(limit, "sheet").where(F.col("low") <= F.col(name)).select("sheet", (F.col("row") - F.col("_start")).alias("place"))
        spans = head.select("sheet", (F.greatest(data_start, F.col("_last") + 1) - data_start + 1).alias("length"))
        gaps = first_unmarked(used, spans, ["sheet"])
        return durable(head.join(gaps, "sheet").select("sheet", (data_start + F.col("gap") - 1).cast("int").alias("_end")), "end")

    first_end = end_of(named, "_named")
    body = placed.join(first_end, "sheet").where(F.col("row") <= F.col("_end")).select("sheet", "cols").distinct().select("sheet", F.explode("cols").alias("col")).distinct().join(named, "sheet")
    body = durable(body, "body")
    start = body.groupBy("sheet").agg(F.coalesce(F.min(F.when(F.col("col") <= F.col("_named"), F.col("col"))), F.lit(1)).alias("min_col"))
    # The right edge: columns used without a gap from the first one.
    run = body.join(start, "sheet").where("col >= min_col").select("sheet", "min_col", "col", (F.col("col") - F.row_number().over(Window.partitionBy("sheet").orderBy("col"))).alias("_g"))
    edge = durable(run.where(F.col("_g") == F.col("min_col") - 1).groupBy("sheet").agg(F.min("min_col").alias("min_col"), F.max("col").alias("max_col")), "edge")
    last_end = end_of(edge.select("sheet", "max_col"), "max_col")
    # Banners right above the header belong to the table.
    above = rows.where("banner").join(head.select("sheet", "header_row"), "sheet").where("row < header_row").select("sheet", "row", "header_row")
    group = above.withColumn("_g", F.col("row") + F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("row"))))
    top = group.where(F.col("_g") == F.col("header_row")).groupBy("sheet").agg(F.min("row").alias("_top"))
    other = rows.where("n > 0 and not banner").join(head.select("sheet", "header_row"), "sheet").where("row < header_row").groupBy("sheet").agg(F.lit(True).alias("_other"))
    out = head.join(edge, "sheet", "left").join(last_end, "sheet", "left").join(top, "sheet", "left").join(other, "sheet", "left")
    none = F.col("header_row").isNull()
    return out.select(
        "sheet", F.coalesce("header_row", F.lit(1)).alias("header_row"), F.when(none, 1).otherwise(F.col("span")).alias("span"), F.when(none, 1).otherwise(F.coalesce("_top", "header_row")).alias("min_row"),
        F.when(none, 1).otherwise(F.col("min_col")).alias("min_col"), F.when(none, 1).otherwise(F.greatest("_end", F.col("header_row") + F.col("span") - 1)).alias("max_row"),
        F.when(none, 1).otherwise(F.col("max_col")).alias("max_col"), F.coalesce("_other", none).alias("ambiguous"),
        F.when(none, "no row can be a header").when(F.col("_other"), "content above the header is no title").alias("reason"),
    )


def region_text(handles: DataFrame) -> DataFrame:
    return handles.withColumn("region", F.concat(cell_text(F.col("min_row"), F.col("min_col")), F.lit(":"), cell_text(F.col("max_row"), F.col("max_col"))))


def column_names(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """sheet, col, name of each column of a handle: the lowest header row that has text there, else the column's letter."""
    spread = handles.select("sheet", "header_row", "span", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    cells = grid.select("sheet", "row", F.posexplode("cells").alias("c", "cell")).where(~empty(F.col("cell")))
    texts = cells.select("sheet", "row", (F.col("c") + 1).alias("col"), F.coalesce(F.col("cell.str"), F.col("cell.int").cast("string"), F.col("cell.num").cast("string")).alias("text"))
    heads = spread.join(texts, ["sheet", "col"], "left").where(F.col("row").isNull() | F.col("row").between(F.col("header_row"), F.col("header_row") + F.col("span") - 1))
    named = heads.groupBy("sheet", "col").agg(F.max_by("text", "row").alias("name"))
    return spread.select("sheet", "col").join(named, ["sheet", "col"], "left").select("sheet", "col", F.coalesce("name", letters_column(F.col("col"))).alias("name"))


def infer_dtypes(grid: DataFrame, handles: DataFrame, sample: int = 20) -> DataFrame:
    """sheet, col, dtype from the first rows of data: boolean, date or number if all values are, else string; string if there are none."""
    spread = handles.select("sheet", (F.col("header_row") + F.col("span")).alias("_from"), "max_row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    cells = grid.select("sheet", "row", F.posexplode("cells").alias("c", "cell")).where(~empty(F.col("cell"))).select("sheet", "row", (F.col("c") + 1).alias("col"), "cell")
    within = (F.col("row") >= F.col("_from")) & (F.col("row") < F.col("_from") + sample) & (F.col("row") <= F.col("max_row"))
    data = spread.join(cells, ["sheet", "col"]).where(within)
    found = data.groupBy("sheet", "col").agg(F.bool_and(F.col("cell.kind") == "bool").alias("b"), F.bool_and(F.col("cell.kind") == "ts").alias("d"), F.bool_and(numeric(F.col("cell"))).alias("n"))
    dtype = F.when(F.col("b"), "boolean").when(F.col("d"), "date").when(F.col("n"), "number").otherwise("string")
    return spread.select("sheet", "col").join(found, ["sheet", "col"], "left").select("sheet", "col", dtype.alias("dtype"))
