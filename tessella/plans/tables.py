"""Tables of any number of sheets in one set of jobs: handles in; columns, places, key index, values, formulas and findings out.

A handle says where a table lies: table_id, sheet, orientation, header_row, span, min_row, min_col, max_row, max_col, ambiguous, reason.
Transposed tables are read, and addressed, in the coordinates of the turned sheet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import cells as K
from tessella.functions.formula import expression_json, gloss, translate
from tessella.operators import detect as D
from tessella.operators import findings as Q
from tessella.operators.durable import durable
from tessella.operators.gate import first_kept
from tessella.operators.grid import plan_bands, transposed

HANDLE = "table_id string, sheet string, orientation string, header_row int, span int, min_row int, min_col int, max_row int, max_col int, ambiguous boolean, reason string"
HANDLE_NAMES = [part.split()[0] for part in HANDLE.split(", ")]
#: Rows of data from which types and formulas are read.
SAMPLE_ROWS = 20


@dataclass(frozen=True)
class Tables:
    """handles: HANDLE. columns: table_id, pos, name, dtype, unit, role (as declared). places: table_id, name, col, ord (live header, last column wins).
    rows: table_id, sheet, row, key, row_key, blank. index: table_id, key, row_key, row (last wins), first, n. cells: table_id, row, col, cell (not empty).
    formulas: table_id, target, expression, formula, operands, ast, context, reason, row. bands: table_id, axis, k, band, low, high. notes: findings that the reading itself gave."""

    handles: DataFrame
    columns: DataFrame
    places: DataFrame
    rows: DataFrame
    index: DataFrame
    cells: DataFrame
    formulas: DataFrame
    bands: DataFrame
    notes: DataFrame


def region_handles(regions: DataFrame) -> DataFrame:
    """Handles from explicit regions (table_id, sheet, header_row, span, bounds): vertical and unambiguous unless the frame says otherwise.

    A region is malformed, and its handle ambiguous, if its bounds cross, if the header lies outside, or if no row is left for data.
    """
    fits = (F.col("min_row") <= F.col("header_row")) & (F.col("header_row") + F.col("span") <= F.col("max_row")) & (F.col("min_col") <= F.col("max_col")) & (F.col("min_row") >= 1) & (F.col("min_col") >= 1) & (F.col("span") >= 1)
    given = lambda name, default: F.col(name) if name in regions.columns else F.lit(default)
    malformed = ~F.coalesce(fits, F.lit(False))
    return regions.select(
        "table_id", "sheet", given("orientation", "vertical").alias("orientation"), "header_row", "span", "min_row", "min_col", "max_row", "max_col",
        (malformed | F.coalesce(given("ambiguous", False).cast("boolean"), F.lit(False))).alias("ambiguous"), F.when(malformed, "malformed region").otherwise(given("reason", None).cast("string")).alias("reason"),
    )


def view_of(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """The grid with the sheets that transposed handles need turned, under `sheet` and `orientation`."""
    upright = grid.select("sheet", F.lit("vertical").alias("orientation"), "row", "cells")
    turned = handles.where("orientation = 'transposed'").select("sheet").distinct()
    if turned.isEmpty():
        return upright
    side = transposed(grid.select("sheet", "row", "cells").join(turned, "sheet", "left_semi"))
    return upright.union(side.select("sheet", F.lit("transposed").alias("orientation"), F.col("row").cast("int").alias("row"), "cells"))


def table_cells(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """table_id, row, col, cell of the cells, not empty ones, of each table, in its own coordinates."""
    views = view_of(grid, handles)
    # One sheet name for each pair of sheet and orientation, so that both kinds go one way.
    tag = F.concat_ws("|", "orientation", "sheet")
    return Q.filled(views.select(tag.alias("sheet"), "row", "cells"), handles.withColumn("sheet", tag))


def table_rows(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """table_id, row, cells (of the whole row) of the rows of each handle's region that the grid has, with the handle's header_row, min_col and max_col, in its own coordinates."""
    tag = F.concat_ws("|", "orientation", "sheet")
    bounds = handles.select("table_id", tag.alias("_tag"), "header_row", "min_row", "max_row", "min_col", "max_col")
    rows = view_of(grid, handles).select(tag.alias("_tag"), "row", "cells").join(bounds, "_tag").where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    return rows.select("table_id", "row", "cells", "header_row", "min_col", "max_col")


def edge_cells(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """table_id, row, col, cell of the cells, not empty ones, of each table's first header row, the row below it and its first column."""
    rows = table_rows(grid, handles).where("min_col between 1 and max_col")
    cols = F.when(F.col("row").between(F.col("header_row"), F.col("header_row") + 1), F.sequence("min_col", "max_col")).otherwise(F.array("min_col"))
    cells = rows.select("table_id", "row", "cells", F.explode(cols).alias("col")).select("table_id", "row", "col", F.try_element_at("cells", "col").alias("cell"))
    return cells.where(~K.empty(F.col("cell")))


def _dtype(found: DataFrame, by: list[str]) -> DataFrame:
    sums = found.groupBy(*by).agg(F.bool_and(F.col("cell.kind") == "bool").alias("b"), F.bool_and(F.col("cell.kind") == "ts").alias("d"), F.bool_and(K.numeric(F.col("cell"))).alias("n"))
    return sums.select(*by, F.when(F.col("b"), "boolean").when(F.col("d"), "date").when(F.col("n"), "number").otherwise("string").alias("dtype"))


def read_tables(grid: DataFrame, handles: DataFrame, declared: DataFrame | None = None, sample: int = SAMPLE_ROWS) -> Tables:
    """Read the unambiguous handles' tables. declared: table_id, pos, name, dtype, unit, role replaces, for the tables it names, what the header and the first rows say.

    Types are read from the first rows of each band; bands that disagree with the first one are a merge-conflict. The key is the first column, or the first
    declared as key; a key column without a name is an orchestration-error, and no key role at all makes keys positional.
    """
    good = durable(handles.where("not ambiguous").select(*HANDLE_NAMES), "handles")
    cells = durable(table_cells(grid, good), "cells")
    notes = Q.finding(handles.where("ambiguous"), "messy-tab", "error", "table", F.concat(F.lit("messy tab: "), F.coalesce("reason", F.lit("ambiguous header"))), Q.at(Q.region_of()))
    body = good.select("table_id", "sheet", "header_row", (F.col("header_row") + F.col("span")).alias("_from"), "max_row", "min_col", "max_col")
    sizes = body.select("table_id", (F.col("max_row") - F.col("_from") + 1).cast("bigint").alias("n_rows"), (F.col("max_col") - F.col("min_col") + 1).cast("bigint").alias("n_cols"))
    bands = durable(plan_bands(sizes), "bands")
    # Headings, types and formulas need the header and the first rows of the table and of its bands: one look at the cells for all of them.
    firsts = body.select("table_id", F.col("_from").cast("bigint").alias("at")).union(body.join(bands.where("axis = 'row'"), "table_id").select("table_id", F.col("_from") + F.col("low") - 1))
    wanted = firsts.select("table_id", F.explode(F.sequence(F.col("at"), F.col("at") + max(sample, 1) - 1)).alias("row")).union(body.where("header_row < _from").select("table_id", F.explode(F.sequence(F.col("header_row").cast("bigint"), F.col("_from").cast("bigint") - 1))))
    wanted = durable(wanted.select("table_id", F.col("row").cast("int").alias("row")).distinct(), "wanted")
    placed = durable(cells.join(wanted, ["table_id", "row"], "left_semi"), "near").join(body, "table_id")
    text = F.coalesce(F.col("cell.str"), K.cell_text(F.col("cell")))
    heads = placed.where((F.col("row") >= F.col("header_row")) & (F.col("row") < F.col("_from"))).groupBy("table_id", "col").agg(F.max_by(text, "row").alias("name"))
    heads = durable(heads, "heads")
    places = durable(heads.groupBy("table_id", "name").agg(F.max("col").alias("col"), F.min("col").alias("ord")), "places")
    data = placed.where((F.col("row") >= F.col("_from")) & (F.col("row") <= F.col("max_row")))
    told = None if declared is None else durable(declared.join(good.select("table_id"), "table_id", "left_semi").select("table_id", "pos", "name", "dtype", F.col("unit").cast("string").alias("unit"), "role"), "declared")
    untold = body if told is None else body.join(told.select("table_id"), "table_id", "left_anti")
    columns, conflicts = _inferred(untold, heads, data, bands, sample)
    notes = notes.union(conflicts)
    if told is not None:
        columns = columns.unionByName(told)
    columns = durable(columns, "columns")
    keyed = columns.where("role = 'key'").groupBy("table_id").agg(F.min_by("name", "pos").alias("name")).join(places.select("table_id", "name", "col"), ["table_id", "name"], "left")
    nameless = keyed.where("col is null").join(body, "table_id")
    notes = notes.union(Q.finding(nameless, "orchestration-error", "error", "table", F.concat(F.lit("orchestration error: key column "), F.col("name"), F.lit(" has no header cell"))))
    reach = body.join(keyed.select("table_id", F.lit(True).alias("_keyed"), F.col("col").alias("_key_col")), "table_id", "left").where("_keyed is null or _key_col is not null")
    reach = durable(reach.where("_from <= max_row").select("table_id", "sheet", "_from", "max_row", "_keyed", "_key_col"), "reach")
    # The key cell is read in its row; rows that the grid does not have are found by the gaps that they leave.
    there = table_rows(grid, good).select("table_id", "row", "cells").join(reach, "table_id").where(F.col("row").between(F.col("_from"), F.col("max_row")))
    key_cell = F.try_element_at("cells", "_key_col")
    with_key = there.select("table_id", "sheet", "row", "_from", "_keyed", F.when(~K.empty(key_cell), key_cell).alias("cell"))
    gaps = D.unmarked(there.select("table_id", (F.col("row") - F.col("_from")).alias("place")), reach.select("table_id", (F.col("max_row") - F.col("_from") + 1).alias("length")), ["table_id"])
    lost = gaps.select("table_id", "_b", F.explode("_free").alias("_i")).join(reach, "table_id").select("table_id", "sheet", (F.col("_from") + F.col("_b") * D.MARKED + F.col("_i")).cast("int").alias("row"), "_from", "_keyed", F.lit(None).cast(K.CELL).alias("cell"))
    with_key = with_key.union(lost)
    position = (F.col("row") - F.col("_from") + 1).cast("string")
    rows = durable(
        with_key.select(
            "table_id", "sheet", "row", F.when(F.col("_keyed"), K.canonical_key(F.col("cell"))).otherwise(F.concat(F.lit("n"), F.concat(position, F.lit(".0")))).alias("key"),
            F.when(F.col("_keyed"), K.cell_text(F.col("cell"))).otherwise(position).alias("row_key"), F.coalesce(F.col("_keyed") & K.empty(F.col("cell")), F.lit(False)).alias("blank"),
        ), "rows"
    )
    index = durable(rows.groupBy("table_id", "sheet", "key").agg(F.max_by("row_key", "row").alias("row_key"), F.max("row").alias("row"), F.min("row").alias("first"), F.count("*").alias("n")), "index")
    early = index.join(body.select("table_id", "_from"), "table_id").where(F.col("row") < F.col("_from") + sample)
    formulas = durable(_formulas(data, places, early, sample), "formulas")
    computed = formulas.where("expression is not null").select("table_id", F.col("target").alias("name"), F.lit("computed").alias("_role")).distinct()
    columns = columns.join(computed, ["table_id", "name"], "left").select("table_id", "pos", "name", "dtype", "unit", F.coalesce("_role", "role").alias("role"))
    dark = formulas.where("expression is null").join(good.select("table_id", "sheet"), "table_id")
    notes = notes.union(Q.finding(dark, "anomaly", "info", "table", F.concat(F.lit("untranslated formula in "), F.col("target"), F.lit(": "), F.col("reason"))).distinct())
    return Tables(handles.select(*HANDLE_NAMES), durable(columns, "columns"), places, rows, index, cells, formulas, bands, durable(notes, "notes"))


def _inferred(body: DataFrame, heads: DataFrame, data: DataFrame, bands: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """Columns by header and first rows, and the conflicts of later bands with the first."""
    from tessella.functions.a1 import letters_column

    spread = body.select("table_id", "sheet", "_from", F.explode(F.sequence("min_col", "max_col")).alias("col"), "min_col")
    by_rows = bands.where("axis = 'row'").select("table_id", "band", "low", "high")
    place = F.col("row") - F.col("_from") + 1
    banded = data.join(by_rows, "table_id", "left").where(F.col("band").isNull() | ((place >= F.col("low")) & (place < F.col("low") + sample) & (place <= F.col("high"))))
    banded = banded.where(F.col("band").isNotNull() | (place <= sample)).withColumn("band", F.coalesce("band", F.lit(0)))
    found = _dtype(banded, ["table_id", "band", "col"])
    every = spread.join(by_rows.select("table_id", "band"), "table_id", "left").withColumn("band", F.coalesce("band", F.lit(0)))
    typed = durable(every.join(found, ["table_id", "band", "col"], "left").withColumn("dtype", F.coalesce("dtype", F.lit("string"))), "typed")
    named = typed.where("band = 0").join(heads, ["table_id", "col"], "left").withColumn("name", F.coalesce("name", letters_column(F.col("col"))))
    columns = named.select(
        "table_id", (F.col("col") - F.col("min_col")).alias("pos"), "name", "dtype", F.lit(None).cast("string").alias("unit"), F.when(F.col("col") == F.col("min_col"), "key").otherwise("value").alias("role")
    )
    later = typed.where("band > 0").join(named.select("table_id", "col", "name", F.col("dtype").alias("_first")), ["table_id", "col"]).where("dtype <> _first")
    message = F.concat(F.lit("merge conflict: dtype mismatch on "), F.col("name"), F.lit(": "), F.col("_first"), F.lit(" vs "), F.col("dtype"), F.lit(" (band "), F.col("band").cast("string"), F.lit(")"))
    return columns, Q.finding(later, "merge-conflict", "error", "table", message)


def _formulas(data: DataFrame, places: DataFrame, index: DataFrame, sample: int) -> DataFrame:
    """Formulas of the first rows that an index reaches, each translated once: the first for every target and expression."""
    near = data.where(F.col("cell.formula").isNotNull() & (F.col("row") < F.col("_from") + sample))
    reached = near.join(index.select("table_id", "row"), ["table_id", "row"], "left_semi")
    named = places.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("names"))
    texts = reached.select("table_id", "row", "col", F.col("cell.formula").alias("formula")).join(named, "table_id")
    kind = pa.schema([("table_id", pa.string()), ("target", pa.string()), ("expression", pa.string()), ("formula", pa.string()), ("operands", pa.list_(pa.string())), ("ast", pa.string()), ("context", pa.string()), ("reason", pa.string()), ("row", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for table_id, row, col, formula, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_col = dict(names)
                if col not in by_col:
                    continue
                expression, operands, reason = translate(formula, row, by_col)
                tree = expression_json(expression) if expression else None
                out.append((table_id, by_col[col], expression, formula, operands, tree, gloss(by_col[col], expression, operands, formula, reason), reason, row))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(kind.names)}, schema=kind)

    made = texts.mapInArrow(run, "table_id string, target string, expression string, formula string, operands array<string>, ast string, context string, reason string, row int")
    told = first_kept(made.where("expression is not null"), ["table_id", "target", "expression"], "row")
    return told.unionByName(first_kept(made.where("expression is null"), ["table_id", "target", "formula"], "row"))


def descriptions(tables: Tables) -> DataFrame:
    """table_id and description: one sentence for each band, in the order of bands."""
    names = tables.columns.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_c"))
    joined = tables.bands.join(names, "table_id")
    part = F.when(F.col("axis") == "col", F.slice("_c", F.col("low").cast("int"), (F.col("high") - F.col("low") + 1).cast("int"))).otherwise(F.col("_c"))
    said = F.concat(F.lit("Band "), F.col("band").cast("string"), F.lit(" with columns: "), F.array_join(F.transform(part, lambda c: c["name"]), ", "), F.lit("."))
    return joined.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", said.alias("d")))), lambda x: x["d"]), " ").alias("description"))


def band_columns(tables: Tables) -> DataFrame:
    """table_id, band, pos, name, dtype, unit, role: the columns that each band covers; bands of rows cover all."""
    joined = tables.bands.join(tables.columns, "table_id")
    return joined.where((F.col("axis") == "row") | (F.col("pos") + 1).between(F.col("low"), F.col("high"))).select("table_id", "band", "pos", "name", "dtype", "unit", "role")


def ranked(frame: DataFrame, by: str, order: str, name: str = "ord") -> DataFrame:
    """Rows of each group numbered from 1; the groups must be small (columns of a table, tables of a sheet)."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)))
