"""Extraction of whole workbooks: grid -> layouts -> tables -> findings, all sheets in one set of jobs. Problems of the data become findings; only a wrong configuration raises."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions import cells as K
from tessella.functions.a1 import cell_text
from tessella.operators import findings as Q
from tessella.operators import gate as G
from tessella.operators import grid as S
from tessella.operators import index as I
from tessella.operators.durable import durable
from tessella.plans import ensemble as N
from tessella.plans import ports as P
from tessella.plans import proposals as R
from tessella.plans import tables as T


@dataclass(frozen=True)
class Config:
    """validate: show error-free tables to the repairer as well. passes: repairs of a table. recuts: take re-cuts. lenses: in order. arbitrate: let a runner choose among contested layouts."""

    validate: bool = False
    passes: int = R.MOST_PASSES
    recuts: bool = True
    lenses: tuple[str, ...] = (N.BASELINE,)
    arbitrate: bool = True
    sample: int = T.SAMPLE_ROWS
    gate_keys: int = G.SAMPLE_KEYS


@dataclass(frozen=True)
class Extraction:
    """grid; sheets: sheet, sheet_idx; tables: what was read (see plans.tables.Tables); findings: see operators.findings; repairs: log of repair passes."""

    grid: DataFrame
    sheets: DataFrame
    tables: T.Tables
    findings: DataFrame
    repairs: DataFrame

    @property
    def handles(self) -> DataFrame:
        return self.tables.handles

    @property
    def columns(self) -> DataFrame:
        """table_id, sheet, pos, name, dtype, unit, role."""
        return self.tables.columns.join(self.tables.handles.select("table_id", "sheet"), "table_id")

    @property
    def formulas(self) -> DataFrame:
        return self.tables.formulas

    @property
    def values(self) -> DataFrame:
        """table_id, sheet, row, row_key, col, column_name, cell, cell_ref of every filled cell of data."""
        named = self.tables.cells.join(self.tables.rows.select("table_id", "sheet", "row", "row_key"), ["table_id", "row"]).join(self.tables.places.select("table_id", "col", F.col("name").alias("column_name")), ["table_id", "col"])
        return named.select("table_id", "sheet", "row", "row_key", "col", "column_name", "cell", cell_text(F.col("row"), F.col("col")).alias("cell_ref"))

    def report(self) -> DataFrame:
        """table_id, sheet, region, orientation, header_row, span, ambiguous, description, passed, failures: one row for each table, failed ones included."""
        said = G.gate_report(self.findings, self.tables.handles)
        shown = self.tables.handles.withColumn("region", Q.region_of()).join(said, "table_id").join(T.descriptions(self.tables), "table_id", "left")
        return shown.select("table_id", "sheet", "region", "orientation", "header_row", "span", "ambiguous", F.coalesce("description", F.lit("")).alias("description"), "passed", "failures")

    def indices(self) -> Extraction:
        """The tables without errors, which alone can be queried with confidence."""
        good = self.report().where("passed").select("table_id")
        keep = lambda f: f.join(good, "table_id", "left_semi")
        t = self.tables
        return replace(self, tables=T.Tables(*(keep(f) for f in (t.handles, t.columns, t.places, t.rows, t.index, t.cells, t.formulas, t.bands, t.notes))))

    def row_keys(self) -> DataFrame:
        """table_id, ord, row_key: keys in the order of first sight."""
        return self.tables.index.select("table_id", F.col("first").alias("ord"), "row_key")

    def column_names(self) -> DataFrame:
        """table_id, ord, name: headings in the order of first sight."""
        return self.tables.places.select("table_id", "ord", "name")

    def physical_columns(self) -> DataFrame:
        """table_id, name, col: of equal headings the last."""
        return self.tables.places.select("table_id", "name", "col")

    def data_rows(self) -> DataFrame:
        """table_id, row: the rows that a key leads to."""
        return self.tables.index.select("table_id", "row").distinct()

    def _asked(self, requests: DataFrame) -> DataFrame:
        """The requests with table_id: given, or that of the sheet's only, or first, table."""
        if "table_id" in requests.columns:
            return requests.select("table_id", "row_key", "column_name")
        first = self.tables.handles.groupBy("sheet").agg(F.min("table_id").alias("table_id"))
        return requests.join(first, "sheet", "left").select("table_id", "sheet", "row_key", "column_name")

    def query(self, requests: DataFrame) -> DataFrame:
        """Answers to requests (table_id or sheet, row_key, column_name), keys as text: cell, cell_ref, dtype, unit, is_computed, status.

        status: ok, unknown-column, unknown-row, in this order of checks. cell_ref is in the table's coordinates, sheet_cell_ref in the sheet's.
        """
        t = self.tables
        asked = self._asked(requests)
        specs = t.columns.groupBy("table_id", F.col("name").alias("column_name")).agg(F.max_by("dtype", "pos").alias("dtype"), F.max_by("unit", "pos").alias("unit"), F.max_by("role", "pos").alias("role"))
        places = t.places.select("table_id", F.col("name").alias("column_name"), "col")
        # Requests first: they are the small side, so only the rows that they name are looked up.
        found = asked.join(places, ["table_id", "column_name"], "left").join(specs, ["table_id", "column_name"], "left")
        # Of the cells only the columns that are asked for move; they are as few as the headings.
        names = places.join(asked.select("table_id", "column_name").distinct(), ["table_id", "column_name"], "left_semi").select("table_id", "col").distinct()
        cells = t.cells.join(names, ["table_id", "col"], "left_semi")
        found = found.join(t.index.groupBy("table_id", "row_key").agg(F.max("row").alias("row")), ["table_id", "row_key"], "left").join(cells, ["table_id", "row", "col"], "left")
        found = found.join(t.handles.select("table_id", "orientation"), "table_id", "left")
        status = F.when(F.col("col").isNull(), "unknown-column").when(F.col("row").isNull(), "unknown-row").otherwise("ok")
        ok = status == "ok"
        turned = F.col("orientation") == "transposed"
        ref, back = cell_text(F.col("row"), F.col("col")), cell_text(F.col("col"), F.col("row"))
        return found.select(
            *asked.columns, "cell", F.when(ok, ref).alias("cell_ref"), F.when(ok, F.when(turned, back).otherwise(ref)).alias("sheet_cell_ref"), F.when(ok, F.coalesce("dtype", F.lit("string"))).alias("dtype"),
            F.when(ok, F.col("unit")).alias("unit"), F.when(ok, F.coalesce(F.col("role") == "computed", F.lit(False))).alias("is_computed"), status.alias("status"),
        )

    def query_cell(self, sheet: str, ref: str) -> DataFrame:
        """One cell by its A1 address: sheet, cell_ref, cell, dtype (number, whatever the cell holds)."""
        row, col = a1.parse_cell(ref)
        return S.point(self.grid, sheet, row, col).select("sheet", F.lit(ref.upper().replace("$", "")).alias("cell_ref"), "cell", F.lit("number").alias("dtype"))

    def query_range(self, sheet: str, ref: str) -> DataFrame:
        """Every cell of an A1 range, empty ones too, with its place (from 0, row by row): sheet, place, cell_ref, cell, dtype. Order by place."""
        r0, c0, r1, c1 = a1.parse_range(ref)
        width = c1 - c0 + 1
        spread = self.grid.sparkSession.range((r1 - r0 + 1) * width).select((F.floor(F.col("id") / width) + r0).cast("int").alias("row"), (F.col("id") % width + c0).cast("int").alias("col"), F.col("id").alias("place"))
        rows = self.grid.where((F.col("sheet") == sheet) & F.col("row").between(r0, r1)).select("row", "cells")
        return spread.join(rows, "row", "left").select(F.lit(sheet).alias("sheet"), "place", cell_text(F.col("row"), F.col("col")).alias("cell_ref"), F.try_element_at("cells", F.col("col")).alias("cell"), F.lit("number").alias("dtype"))

    def read_all(self, max_keys: int | None = None) -> DataFrame:
        """table_id, row_key, column_name, cell, cell_ref for every key and heading, empty cells too; max_keys counts each table's keys in order of first sight."""
        t = self.tables
        keys = t.index.select("table_id", "key", "row_key", "row", "first")
        if max_keys is not None:
            numbered = S.with_row_number(keys, ["table_id", "first"], "_i", 0)
            low = numbered.groupBy("table_id").agg(F.min("_i").alias("_low"))
            keys = numbered.join(low, "table_id").where(F.col("_i") - F.col("_low") < max_keys)
        every = keys.select("table_id", "row_key", "row").join(t.places.select("table_id", F.col("name").alias("column_name"), "col"), "table_id")
        return every.join(t.cells, ["table_id", "row", "col"], "left").select("table_id", "row_key", "column_name", "cell", cell_text(F.col("row"), F.col("col")).alias("cell_ref"))

    def relation(self, table_id: str) -> DataFrame:
        """One table as a wide frame: a typed column for each heading, a row for each row of data, for plain SQL. Its headings are collected: a table's columns are structure."""
        t = self.tables
        specs = t.columns.where(F.col("table_id") == table_id).join(t.places.where(F.col("table_id") == table_id).select("name", "col"), "name").orderBy("col").collect()
        types = {"number": K.cell_number, "boolean": lambda c: c["bool"], "date": lambda c: c["ts"]}
        mine = t.cells.where(F.col("table_id") == table_id).join(t.rows.where(F.col("table_id") == table_id).select("row"), "row")
        wide = mine.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("_of"))
        every = t.rows.where(F.col("table_id") == table_id).select("row").join(wide, "row", "left")
        at = lambda s: F.try_element_at("_of", F.lit(s.col))
        return every.select("row", *(types.get(s.dtype, K.cell_text)(at(s)).alias(s["name"]) for s in specs))

    def register(self, table_id: str, name: str) -> None:
        """A table as a temporary view, so that SQL can use it."""
        I.register(self.relation(table_id), name)


def extract(grid: DataFrame, config: Config = Config(), runner: P.Runner | None = None, client: P.Client | None = None, propose: R.Proposer | None = None, repairer: R.Repairer | None = None, chooser: N.Chooser | None = None) -> Extraction:
    """Tables of every sheet of a grid (sheet, row, cells; sheet_idx if the order is known; rows without a sheet are files that could not be read).

    Without helpers all is deterministic. A runner stands in for proposer, repairer and chooser where these are not given; a client resolves messy tabs.
    Table ids are sheet__i, or sheet__i_j where a sheet has several tables, i and j counting from 0. A lens that nobody registered raises KeyError; nothing in the data raises.
    """
    N.build_lenses(config.lenses)
    spark = grid.sparkSession
    broken = grid.where("sheet is null")
    names = ["sheet", "row", "cells"] + (["sheet_idx"] if "sheet_idx" in grid.columns else [])
    grid = durable(grid.where("sheet is not null").select(*names), "grid")
    order = durable(S.sheets(grid), "sheets")
    propose = propose or (R.proposing_runner(grid, runner) if runner else None)
    repairer = repairer or (R.repairing_runner(grid, runner) if runner else None)
    chooser = chooser or (N.choosing_runner(grid, runner) if runner and config.arbitrate else None)
    layout = N.analyse(grid, config.lenses, runner, chooser)
    handles, found = layout.handles, layout.findings
    # Loose blocks are looked for, and re-cuts taken, where a sheet has one upright table.
    single = handles.groupBy("sheet").agg(F.count("*").alias("n"), F.min("orientation").alias("o")).join(layout.sheets.select("sheet", "contested", "winner", "baseline"), "sheet")
    single = single.where("n = 1 and o = 'vertical' and not (contested and winner <> coalesce(baseline, winner))").select("sheet")
    alone = handles.join(single, "sheet", "left_semi")
    part = grid.join(single, "sheet", "left_semi")
    if propose is not None and config.recuts:
        cut, loose = R.recut(part, alone, propose)
        cut = cut.withColumn("orientation", F.lit("vertical"))
        handles = handles.join(single, "sheet", "left_anti").select(*cut.columns).unionByName(cut)
    else:
        loose = Q.sheet_findings(part, alone)
    found = durable(found.union(loose), "found")
    handles = numbered_handles(handles, order)
    tables, findings, repairs = _read(grid, handles, config, client, repairer)
    if not layout.baselines.isEmpty():
        tables, findings, repairs, fights = _contest(grid, layout, order, tables, findings, repairs, config, client, repairer)
        found = found.union(fights)
    if "workbook" in broken.columns:
        lost = broken.select("workbook").distinct().withColumn("sheet", F.lit(None).cast("string"))
        found = found.union(Q.finding(lost, "unreadable-workbook", "error", "workbook", F.concat(F.lit("unreadable workbook: "), F.col("workbook")), table=False))
    return Extraction(grid, order, tables, durable(found.union(findings), "findings"), repairs)


def numbered_handles(handles: DataFrame, order: DataFrame, suffix: str = "") -> DataFrame:
    """Handles with table ids, sheet by sheet in the order of the workbook, tables from the top."""
    placed = T.ranked(handles.withColumn("_p", F.struct("min_row", "min_col")), "sheet", "_p", "_j").drop("_p").join(order, "sheet")
    many = placed.groupBy("sheet").agg(F.count("*").alias("_n"))
    base = F.concat(F.col("sheet"), F.lit("__"), F.col("sheet_idx").cast("string"))
    named = placed.join(many, "sheet").withColumn("table_id", F.concat(F.when(F.col("_n") > 1, F.concat(base, F.lit("_"), (F.col("_j") - 1).cast("string"))).otherwise(base), F.lit(suffix)))
    return durable(named.select(*T.HANDLE_NAMES), "handles")


def _read(grid: DataFrame, handles: DataFrame, config: Config, client: P.Client | None, repairer: R.Repairer | None) -> tuple[T.Tables, DataFrame, DataFrame]:
    """Tables of handles, their findings, and the log of repairs."""
    spark = grid.sparkSession
    declared = spark.createDataFrame([], R.DECLARED)
    if client is not None:
        handles, declared = R.resolve_messy(grid, handles, client)
    tables = T.read_tables(grid, handles, declared, config.sample)
    gate = durable(G.run_gate(tables, size=config.gate_keys, full=config.gate_keys), "gate")
    log = spark.createDataFrame([], R.LOG)
    if repairer is not None:
        seen = Q.table_findings(T.table_cells(grid, tables.handles), tables.handles)
        errors = G.gate_report(tables.notes.union(gate).union(seen), tables.handles)
        fixed, named, log = R.repair(grid, tables, errors, repairer, config.passes, config.validate)
        if not named.isEmpty():
            declared = declared.join(named.select("table_id"), "table_id", "left_anti").unionByName(named)
            tables = T.read_tables(grid, fixed, declared, config.sample)
            gate = durable(G.run_gate(tables, size=config.gate_keys, full=config.gate_keys), "gate")
    return tables, durable(Q.table_findings(T.edge_cells(grid, tables.handles), tables.handles).union(tables.notes).union(gate), "findings"), log


def _contest(grid: DataFrame, layout: N.Analysis, order: DataFrame, tables: T.Tables, findings: DataFrame, repairs: DataFrame, config: Config, client, repairer) -> tuple[T.Tables, DataFrame, DataFrame, DataFrame]:
    """Winners of contested sheets against the vertical layout, both read, gated and repaired: the winner stays if it has no more errors."""
    other = numbered_handles(layout.baselines, order, "~base")
    base, base_found, base_log = _read(grid, other, config, client, repairer)
    count = lambda f, name: f.where("severity = 'error' and table_id is not null").groupBy("sheet").agg(F.count("*").alias(name))
    both = layout.baselines.select("sheet").distinct().join(count(findings, "mine"), "sheet", "left").join(count(base_found, "theirs"), "sheet", "left").fillna(0, ["mine", "theirs"]).join(layout.sheets.select("sheet", "method"), "sheet")
    both = durable(both, "contest")
    lost = both.where("mine > theirs").select("sheet")
    gone = tables.handles.join(lost, "sheet", "left_semi").select("table_id")
    back = base.handles.join(lost, "sheet", "left_semi").select("table_id")
    plain = lambda f: f.withColumn("table_id", F.regexp_replace("table_id", "~base$", ""))
    swap = lambda mine, theirs: durable(mine.join(gone, "table_id", "left_anti").unionByName(plain(theirs.join(back, "table_id", "left_semi")).select(*mine.columns)), "swapped")
    pairs = zip(*((t.handles, t.columns, t.places, t.rows, t.index, t.cells, t.formulas, t.bands, t.notes) for t in (tables, base)), strict=True)
    made = T.Tables(*(swap(a, b) for a, b in pairs))
    kept = findings.join(gone, "table_id", "left_anti").union(plain(base_found.join(back, "table_id", "left_semi")).select(*findings.columns))
    message = F.concat(F.lit("lenses disagree: "), F.when(F.col("mine") <= F.col("theirs"), F.concat(F.lit("took "), F.col("method"))).otherwise(F.lit("kept the vertical layout")), F.lit(" (errors "), F.col("mine").cast("string"), F.lit(" and "), F.col("theirs").cast("string"), F.lit(")"))
    won = Q.finding(both.where("mine <= theirs"), "contested-layout", "info", "sheet", message, Q.at(F.lit("A1")), table=False)
    return made, durable(kept, "findings"), repairs.union(base_log), won.union(Q.finding(both.where("mine > theirs"), "contested-layout", "warning", "sheet", message, Q.at(F.lit("A1")), table=False))


def combine(parts: Sequence[Extraction]) -> DataFrame:
    """Findings of several extractions as one frame."""
    out = parts[0].findings
    for p in parts[1:]:
        out = out.union(p.findings)
    return out
