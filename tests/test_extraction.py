"""Whole extractions: findings, the gate, lookups, layouts, re-cuts and repairs on small sheets."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import detect as D
from tessella.operators import findings as Q
from tessella.operators import gate as G
from tessella.operators import grid as S
from tessella.operators.detect import detect_tables
from tessella.operators.probes import BandProbe, SheetProbe
from tessella.plans import ensemble as N
from tessella.plans import ports as P
from tessella.plans import proposals as R
from tessella.plans import tables as T
from tessella.plans.extract import Config, extract

SALES = [["Region", "Price", "Units", "Revenue"], *([f"r{i}", 1.5 + i, 4 + i, (1.5 + i) * (4 + i)] for i in range(8))]
SHEETS = {
    "clean": SALES,
    "dropped": [["Item", "Cost"], ["a", 1], ["b", 2], [None], ["Product", "Price"], ["Widget", 9.5], ["Gear", 3.5]],
    "note": [["Item", "Cost"], ["a", 1], ["b", 2], [None], ["see the appendix"]],
    "corner": [[None, "Q1", "Q2"], ["Revenue", 1, 2], ["Cost", 3, 4]],
    "turned": [[None, "Jan", "Feb"], ["Revenue", 1, 2], ["Cost", 3, 4]],
    "swallowed": [["Item", "Q1", "Q2"], ["Widget", "49", "1,200"], ["Gear", 3, 4], ["Bolt", 5, 6]],
    "twice": [["Key", "V"], ["a", 1], ["a", 2], [None, 3], ["b", 4], ["a", 5]],
    "offtype": [["Key", "V"], *([f"k{i}", i] for i in range(22)), *([f"t{i}", "n/a"] for i in range(9))],
    "messy": [[5, 1, 2], [None], ["Key", "V"], ["x", 1]],
    "wrong": [["Key", "A", "B", "Sum"], ["x", 1, 2, 3], ["y", 3, 4, 8], ["z", 5, "n/a", 5]],
    "same": [["Key", "V", "V"], ["x", 1, 2], ["y", 3, 4]],
}
FORMULAS = {("wrong", r, 4): f"=B{r}+C{r}" for r in (2, 3, 4)} | {("clean", r, 4): f"=B{r}*C{r}" for r in range(2, 10)} | {("clean", 2, 2): "=VLOOKUP(A2,X1,1)"}


@pytest.fixture(scope="module")
def grid(spark):
    return S.grid_from_lists(spark, SHEETS, FORMULAS)


@pytest.fixture(scope="module")
def found(grid):
    return extract(grid)


def test_every_finding(found):
    got = {}
    for r in found.findings.collect():
        got.setdefault(r.sheet, set()).add((r.category, r.severity, r.scope, r.ref))
    assert got["clean"] == {("anomaly", "info", "table", None)}
    assert got["dropped"] == {("uncovered-data", "error", "sheet", "dropped!A5:B7")}
    assert "note" not in got  # a line of text is no table
    assert ("empty-header-corner", "error", "table", "corner!A1") in got["corner"] and ("transpose-suspected", "warning", "table", "turned!A1:C3") in got["turned"]
    assert ("orchestration-error", "error", "table", None) in got["corner"]
    assert ("false-header-span", "error", "table", "swallowed!A1:C4") in got["swallowed"]
    assert {c for c, *_ in got["twice"]} == {"row-key-collision", "blank-row-key"}
    assert {c for c, *_ in got["offtype"]} == {"dtype-mismatch"}
    assert {c for c, *_ in got["messy"]} == {"messy-tab"}
    assert {c for c, *_ in got["wrong"]} == {"computed"}
    assert {c for c, *_ in got["same"]} == {"column-name"}
    messages = sorted(r.message for r in found.findings.where("sheet = 'twice'").collect())
    assert messages == ["blank row key: data row 4 has an empty key cell", "row-key collision: key a at row 2 is shadowed by row 3", "row-key collision: key a at row 3 is shadowed by row 6"]
    wrong = sorted(r.message for r in found.findings.where("sheet = 'wrong'").collect())
    assert wrong[0].startswith("computed eval failed Sum@z") and wrong[1] == "computed mismatch Sum@y: live=8.0 calc=7.0"


def test_report_and_indices(found):
    report = {r.sheet: r for r in found.report().collect()}
    assert set(report) == set(SHEETS) and {s for s, r in report.items() if r.passed} == {"clean", "dropped", "note"}
    # The table id counts sheets in their order; without a known order, by name.
    assert [report[s].table_id for s in sorted(SHEETS)] == [f"{s}__{i}" for i, s in enumerate(sorted(SHEETS))]
    assert report["clean"].description == "Band 0 with columns: Region, Price, Units, Revenue."
    assert {r.sheet for r in found.indices().handles.collect()} == {"clean", "dropped", "note"}


def test_lookups(spark, found):
    def of(frame):
        return [tuple(r) for r in frame.collect()]

    t = found.handles.where("sheet = 'twice'").first().table_id
    asked = spark.createDataFrame([(t, "a", "V"), (t, "b", "V"), (t, "zz", "V"), (t, "a", "W"), ("no table", "a", "V")], "table_id string, row_key string, column_name string")
    got = {(r.row_key, r.column_name, r.table_id): (r.status, r.cell_ref, r.cell and r.cell.int) for r in found.query(asked).collect()}
    assert got == {("a", "V", t): ("ok", "B6", 5), ("b", "V", t): ("ok", "B5", 4), ("zz", "V", t): ("unknown-row", None, None), ("a", "W", t): ("unknown-column", None, None), ("a", "V", "no table"): ("unknown-column", None, None)}
    assert [(r.ord, r.row_key) for r in found.row_keys().where(F.col("table_id") == t).orderBy("ord").collect()] == [(2, "a"), (4, None), (5, "b")]
    assert of(found.data_rows().where(F.col("table_id") == t).select("row").orderBy("row")) == [(4,), (5,), (6,)]
    same = found.handles.where("sheet = 'same'").first().table_id
    assert of(found.physical_columns().where(F.col("table_id") == same).select("name", "col").orderBy("col")) == [("Key", 1), ("V", 3)]
    assert of(found.column_names().where(F.col("table_id") == same).select("ord", "name").orderBy("ord")) == [(1, "Key"), (2, "V")]
    one = found.query_cell("clean", "$C$3").first()
    assert (one.cell_ref, one.cell.int, one.dtype) == ("C3", 5, "number")
    cells = found.query_range("clean", "A1:B2").orderBy("place").collect()
    assert [(r.cell_ref, r.cell.str or r.cell.num) for r in cells] == [("A1", "Region"), ("B1", "Price"), ("A2", "r0"), ("B2", 1.5)]
    assert [r.cell for r in found.query_range("clean", "Y90:Z90").collect()] == [None, None]
    first = found.read_all(max_keys=2).where("table_id like 'clean%'").collect()
    assert {r.row_key for r in first} == {"r0", "r1"} and len(first) == 8
    clean = found.handles.where("sheet = 'clean'").first().table_id
    found.register(clean, "clean_sales")
    assert spark.sql("SELECT sum(Revenue) - sum(Price * Units) AS d FROM clean_sales").first().d == 0


def test_gate_sees_what_changed(spark, grid, found):
    """The same tables against a sheet that has been edited since."""
    t = found.indices().tables
    edited = [list(r) for r in SALES]
    edited[0] = ["Region", "Units", "Price", "Extra"]  # columns swapped, one renamed
    edited[3][0], edited[2][1] = "rX", 99.0
    live = T.table_cells(S.grid_from_lists(spark, {"clean": edited}, {}), t.handles.where("sheet = 'clean'"))
    clean = t.handles.where("sheet = 'clean'").first().table_id
    only = T.Tables(*(f.where(F.col("table_id") == clean) for f in (t.handles, t.columns, t.places, t.rows, t.index, t.cells, t.formulas, t.bands, t.notes)))
    got = {(r.category, r.message) for r in G.run_gate(only, live).collect()}
    assert ("column-name", "column-name: Revenue is declared and not in the live header") in got and ("column-coverage", "column-coverage: live header Extra is not declared") in got
    assert ("column-integrity", "column-integrity: Price is indexed in column B but the live header has it in C") in got and ("column-integrity", "column-integrity: Revenue is indexed and not in the live header") in got
    assert ("row-integrity", "row-integrity: key r2 points to row 4 but the live cell has rX") in got
    assert any(c == "round-trip" and "Price of r1 is 99.0" in m for c, m in got)
    assert any(c == "computed" for c, _ in got)
    none = T.region_handles(spark.createDataFrame([("t", "clean", 9, 1, 9, 1, 9, 4), ("u", "clean", 1, 1, 1, 1, 9, 4)], "table_id string, sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int"))
    assert {r.table_id: r.reason for r in none.collect()} == {"t": "malformed region", "u": None}


def test_declared_columns_and_empty_index(spark, grid):
    handles = T.region_handles(spark.createDataFrame([("u", "clean", 1, 1, 1, 1, 9, 4)], "table_id string, sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int"))
    declared = spark.createDataFrame([("u", 0, "Region", "string", None, "key"), ("u", 1, "Ghost", "number", "USD", "value"), ("u", 2, "Units", "date", None, "value")], R.DECLARED)
    tables = T.read_tables(grid, handles, declared)
    got = {r.message for r in G.run_gate(tables).collect()}
    assert "coverage gap: column Ghost is declared and cannot be resolved" in got and "dtype-mismatch: column Units declared date but 8 of 8 sampled cells are not" in got
    assert "column-coverage: live header Price is not declared" in got
    bare = T.read_tables(grid, handles.withColumn("span", F.lit(9)).withColumn("ambiguous", F.lit(False)))
    assert {r.category for r in G.run_gate(bare).collect()} >= {"empty-index"}


def test_bands_that_disagree(spark):
    rows = [["Key", "V"], *([i, i] for i in range(6000)), *([i, "text"] for i in range(6000, 12000))]
    grid = S.grid_from_lists(spark, {"long": rows})
    got = extract(grid)
    assert [(r.axis, r.k) for r in got.tables.bands.select("axis", "k").distinct().collect()] == [("row", 3)]
    assert {(r.category, r.message) for r in got.findings.collect()} == {("merge-conflict", "merge conflict: dtype mismatch on V: number vs string (band 2)")}
    wide = S.grid_from_lists(spark, {"wide": [[f"c{i}" for i in range(100)], list(range(100)), list(range(100))]})
    read = T.read_tables(wide, T.region_handles(spark.createDataFrame([("w", "wide", 1, 1, 1, 1, 3, 100)], "table_id string, sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int")))
    sizes = {r.band: r["count"] for r in T.band_columns(read).groupBy("band").count().collect()}
    assert sum(sizes.values()) == 100 and len(sizes) == 3
    assert T.descriptions(read).first().description.startswith("Band 0 with columns: c0, c1") and T.descriptions(read).first().description.count("Band") == 3


def test_layouts(spark):
    sheets = {"two": SHEETS["dropped"], "turned": [["Month", "Jan", "Feb", "Mar"], ["Revenue", 1, 2, 3], ["Cost", 4, 5, 6]], "plain": SALES}
    grid = S.grid_from_lists(spark, sheets)
    more = extract(grid, Config(lenses=("vertical", "blocks")))
    assert sorted(r.table_id for r in more.handles.where("sheet = 'two'").collect()) == ["two__2_0", "two__2_1"]
    assert more.findings.where("sheet = 'two' and severity = 'error'").count() == 0
    with pytest.raises(KeyError):
        extract(grid, Config(lenses=("vertical", "nobody")))
    N.register("broken", lambda g: 1 / 0)
    hurt = N.analyse(grid, ("vertical", "broken"))
    assert {(r.sheet, r.category) for r in hurt.findings.collect()} == {(s, "analyzer-error") for s in sheets}
    asked = []

    def choose(sheet, proposals):
        asked.append((sheet, [p["method"] for p in proposals]))
        return 7

    # Two layouts, each better in one way: contested.
    N.register("greedy", lambda g: N._candidates(N.D.detect_tables(g).withColumn("max_row", F.when(F.col("sheet") == "two", 7).otherwise(F.col("max_row"))), confidence=0.9))
    got = extract(grid, Config(lenses=("vertical", "greedy")), chooser=choose)
    assert [s for s, _ in asked] == ["two"]
    assert {"arbiter-error"} <= {r.category for r in got.findings.where("sheet = 'two'").collect()}
    chosen = N.analyse(grid, ("vertical", "greedy"), chooser=lambda s, p: [q["method"] for q in p].index("vertical"))
    assert {r.sheet: r.method for r in chosen.sheets.collect()}["two"] == "vertical"
    side = extract(S.grid_from_lists(spark, {"t": sheets["turned"]}), Config(lenses=("transposed",)))
    t = side.handles.first()
    assert (t.orientation, t.max_row, t.max_col) == ("transposed", 4, 3)
    ask = spark.createDataFrame([(t.table_id, "Feb", "Cost")], "table_id string, row_key string, column_name string")
    r = side.query(ask).first()
    assert (r.cell.int, r.cell_ref, r.sheet_cell_ref) == (5, "C3", "C3") and side.query(ask.withColumn("row_key", F.lit("Mar"))).first().sheet_cell_ref == "D3"


def test_runner_proposes_layouts(spark):
    grid = S.grid_from_lists(spark, {"two": SHEETS["dropped"]})
    tables = [{"region": "A1:B3", "header_row": 1}, {"region": "A5:B7", "header_row": 5}, {"region": "??", "header_row": 1}]
    runner = P.ScriptedRunner([{"tables": tables}], [("dimensions", {}), ("peek_rows", {"count": 2}), ("try_layout", {"tables": tables}), ("try_layout", {"tables": []}), ("peek_region", {"a1": "A5:B5"})])
    found = N.proposed(grid, runner)
    assert [(r.min_row, r.max_row, r.confidence) for r in found.orderBy("j").collect()] == [(1, 3, 0.7), (5, 7, 0.7)]
    size, rows, tried, bad, part = runner.seen
    assert size == {"sheet": "two", "n_rows": 7, "n_cols": 2} and rows["rows"][0] == {"row": 1, "cells": ["Item", "Cost"]} and part["rows"] == [{"row": 5, "cells": ["Product", "Price"]}]
    assert tried == {"ok": True, "tables": 2, "coverage_cells": 12, "errors": 0, "gaps": 0} and not bad["ok"]
    budget = N.trial_tool(grid, "two", most=0)
    assert not budget.call({"tables": tables})["ok"]
    assert N.proposal_rows("s", [{"region": "A1:B3", "header_row": 1, "orientation": "transposed"}, {"region": "A1:B3", "header_row": 1}]) == [("s", "vertical", 1, 1, 1, 1, 3, 2)]
    assert len(N.proposal_rows("s", [{"region": "A1:B3", "header_row": 1}] * 20)) == N.MOST_TABLES


def test_repairs_are_verified(spark, grid):
    asked = []

    def repairer(table, columns, failures, tried):
        asked.append((table.sheet, len(tried)))
        if table.sheet == "swallowed":
            return {"header_row": 1, "header_span": 3, "columns": [{"name": "Item", "role": "key"}, {"name": "Q1", "dtype": "number"}, {"name": "Q2", "dtype": "number"}]}
        if table.sheet == "offtype":
            return {"column_patches": [{"name": "V", "dtype": "string"}, {"name": "Nobody", "dtype": "date"}, {"name": "Key", "dtype": "blob"}]}
        if table.sheet == "twice":
            return {"column_patches": [{"name": "V", "dtype": "boolean"}]}  # no better
        if table.sheet == "same":
            raise RuntimeError("helper is down")
        return {}

    before = extract(grid)
    after = extract(grid, repairer=repairer)
    errors = lambda e: {r.sheet: len([m for m in r.failures]) for r in e.report().collect()}
    old, new = errors(before), errors(after)
    assert all(new[s] <= old[s] for s in old) and new["offtype"] == 0 and new["twice"] == old["twice"] and new["same"] == old["same"]
    head = after.handles.where("sheet = 'swallowed'").first()
    assert (head.header_row, head.span) == (1, 1) and new["swallowed"] < old["swallowed"]
    log = {(r.table_id.split("__")[0], r["pass"]): (r.accepted, r.patch_summary) for r in after.repairs.collect()}
    assert log["offtype", 0] == (True, "columns:3") and log["twice", 0] == (False, "columns:1") and log["swallowed", 0][0]
    assert ("clean", 0) not in asked and ("note", 0) not in asked


def test_messy_tabs_and_header_checks(spark, grid):
    answer = {"confident": True, "header_row": 3, "region": "A3:B4", "columns": [{"name": "Key"}, {"name": "V", "dtype": "number"}]}
    part = grid.where("sheet = 'messy'")
    got = extract(part, client=P.ScriptedClient([answer]))
    assert got.findings.where("category = 'messy-tab'").count() == 0
    assert [(r.name, r.dtype, r.role) for r in got.columns.orderBy("pos").collect()] == [("Key", "string", "key"), ("V", "number", "value")]
    stub = T.region_handles(spark.createDataFrame([("m", "messy", 1, 1, 1, 1, 1, 1)], "table_id string, sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int"))
    for script in ([{"confident": False}], [{"confident": True}], []):
        left, declared = R.resolve_messy(part, stub, P.ScriptedClient(script))
        assert left.first().ambiguous and left.first().reason.startswith("the helper") and declared.isEmpty()
    columns = [{"name": "Key", "unit": None, "role": "key"}, {"name": "V", "unit": None, "role": "value"}]
    out, notes = R.verify_header(columns, P.ScriptedClient([{"columns": [{"name": "V", "unit": "USD", "role": "nonsense"}]}]))
    assert out[1] == {"name": "V", "unit": "USD", "role": "value"} and notes == []
    assert R.verify_header(columns, P.ScriptedClient([]))[0] == columns


def test_probes(grid):
    band = BandProbe(grid, "clean", 1, 2, 9, 2, 4)
    assert band.geometry()["region"] == "B1:D9" and band.geometry()["n_data_rows"] == 8
    assert band.header_candidates() == [{"row": 1, "cells": ["Price", "Units", "Revenue"]}]
    assert [r["row"] for r in band.peek_rows(6, 10)] == [8, 9] and [r["row"] for r in band.tail_rows(2)] == [8, 9]
    assert band.column_values(1, 3) == {"col_index": 1, "header": "Units", "values": ["4", "5", "6"]} and band.column_values(9)["values"] == []
    assert band.peek_region("A2:C3") == [{"row": 2, "cells": ["1.5", "4"]}, {"row": 3, "cells": ["2.5", "5"]}]
    assert {t.name for t in band.tools()} == {"geometry", "header_candidates", "peek_rows", "tail_rows", "column_values", "peek_region"}
    assert P.allowed_tools(SheetProbe(grid, "clean").tools(), "x:") == ["x:dimensions", "x:peek_rows", "x:peek_region"]
    by_name = {t.name: t for t in band.tools()}
    assert by_name["column_values"].call({"col": 0, "count": 1})["values"] == ["1.5"] and by_name["peek_rows"].call({})["rows"][0]["row"] == 2


def test_schemas():
    assert P.enforce({"choice": 1, "other": 2}, P.VERDICT) == {"choice": 1}
    for raw, schema in (({}, P.VERDICT), ({"choice": True}, P.VERDICT), ({"choice": "1"}, P.VERDICT), ([], P.VERDICT), ({"tables": [{"region": "A1"}]}, P.LAYOUT), ({"tables": [{"region": "A1", "header_row": 1, "orientation": "up"}]}, P.LAYOUT)):
        with pytest.raises(P.SchemaError):
            P.enforce(raw, schema)
    with pytest.raises(IndexError):
        P.ScriptedClient([]).complete("", "")


def test_sources(spark, grid, tmp_path):
    assert [r.sheet for r in S.sheets(grid).orderBy("sheet_idx").collect()] == sorted(SHEETS)
    assert S.point(grid, "clean", 2, 3).first().cell.int == 4 and S.point(grid, "clean", 2, 30).first().cell is None and S.point(grid, "clean", 99, 1).count() == 0
    assert {(r.row, r.formula) for r in S.formulas(grid, "wrong", "D2:D3").collect()} == {(2, "=B2+C2"), (3, "=B3+C3")}
    kept = S.snapshot(grid.where("sheet = 'clean'"))
    assert kept.count() == 9
    assert S.as_grid(spark, grid) is grid
    table = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert [r.row for r in S.as_grid(spark, table, "k", "t").orderBy("row").collect()] == [1, 2, 3]
    for bad in (table, 5, {"other": "x"}):
        with pytest.raises(TypeError):
            S.as_grid(spark, bad)


def test_covered_blocks(spark, grid):
    blocks = spark.createDataFrame([("x", "dropped", 5, 1, 7, 2), ("y", "dropped", 1, 1, 7, 2), ("z", "dropped", 4, 1, 4, 2)], "block string, sheet string, min_row int, min_col int, max_row int, max_col int")
    regions = spark.createDataFrame([("dropped", 5, 1, 7, 2)], "sheet string, min_row int, min_col int, max_row int, max_col int")
    assert [r.block for r in R.covered_blocks(grid, blocks, regions).collect()] == ["x"]


def test_escalation(spark, grid, found):
    small = R.escalated(found.tables, found.findings)
    assert {r.table_id.split("__")[0] for r in small.collect()} == {"clean"}  # the anomaly of an untranslated formula
    assert R.escalated(found.tables, found.findings, most_rows=4).count() == 0
    assert R.escalated(found.tables, found.findings, validate=True).count() > 5
    clean = found.handles.where("sheet = 'clean'").first().table_id
    assert "untranslated formula in Price" in R.band_digest(found.tables, clean, found.findings)


def test_loose_blocks_are_tables(spark, grid):
    assert {r.sheet for r in Q.loose_blocks(grid, detect_tables(grid)).collect()} == {"dropped"}


def test_workbook_source(spark, tmp_path):
    from tessella.plans import fixtures as X
    from tessella.sources import workbook as W

    (tmp_path / "one.xlsx").write_bytes(W.workbook_bytes({"zeta": SALES, "alpha": SHEETS["dropped"]}, {("zeta", 2, 4): "=B2*C2"}, {"zeta": ["A1:B1"]}))
    with open(tmp_path / "two.xlsx", "wb") as out:
        rows = X.ledger(spark, 500).orderBy("n")
        W.stream_workbook(out, {"Ledger": ([*x] for part in ([rows.columns], rows.toLocalIterator()) for x in part)})
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    W.register(spark)
    grid = spark.read.format("workbookgrid").load(str(tmp_path))
    plain = W.read_workbooks(spark, str(tmp_path))
    assert grid.count() == plain.count() == 9 + 7 + 501 + 1
    assert [(r.sheet, r.sheet_idx) for r in S.sheets(grid.where("workbook like '%one.xlsx'")).orderBy("sheet_idx").collect()] == [("zeta", 0), ("alpha", 1)]
    assert grid.where("sheet = 'alpha'").count() == 7 == spark.read.format("workbookgrid").option("sheet", "alpha").load(str(tmp_path / "one.xlsx")).count()
    done = extract(S.as_grid(spark, {"main": str(tmp_path)}))
    assert {r.table_id: r.passed for r in done.report().collect()} == {"Ledger__0": True, "alpha__1": True, "zeta__0": True}
    assert [r.message.rsplit("/", 1)[-1] for r in done.findings.where("scope = 'workbook'").collect()] == ["bad.xlsx"]


class Shuffled:
    """Rows that the stages run inside it write to shuffles; sides of more than a few KB are not broadcast meanwhile."""

    def __init__(self, spark):
        self.spark, self.name, self.rows = spark, "spark.sql.autoBroadcastJoinThreshold", 0

    def _stages(self):
        context = self.spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    def __enter__(self):
        self.before, self.kept = self._stages(), self.spark.conf.get(self.name)
        self.spark.conf.set(self.name, "16k")
        return self

    def __exit__(self, *_):
        self.spark.conf.set(self.name, self.kept)
        self.rows = sum(n for k, n in self._stages().items() if k not in self.before)


LONG = 6000


@pytest.fixture(scope="module")
def long_sheet(spark):
    k = F.col("id")
    wide = spark.range(LONG).select(F.xxhash64(k).cast("string").alias("key"), *((F.xxhash64(k, F.lit(i)) % 1000000).alias(f"c{i}") for i in range(6)), "id")
    return S.snapshot(S.grid_of(wide, "id", "long"))


def test_extraction_keeps_a_long_table_in_place(spark, long_sheet):
    """Detection, reading and the gate send fewer rows through shuffles than the sheet has cells."""
    with Shuffled(spark) as seen:
        report = extract(long_sheet).report().collect()
    assert [(r.table_id, r.region, r.passed) for r in report] == [("long__0", f"A1:H{LONG + 1}", True)]
    assert seen.rows < 8 * LONG


def test_query_moves_the_asked_column_only(spark, long_sheet):
    """Requests for one of eight columns of every row: the other columns' cells stay where they are."""
    done = extract(long_sheet)
    asked = S.snapshot(done.row_keys().select(F.lit("long").alias("sheet"), "row_key", F.lit("c3").alias("column_name")))
    with Shuffled(spark) as seen:
        got = done.query(asked).agg(F.count_if(F.col("status") == "ok").alias("n"), F.sum("cell.int").alias("sum")).first()
    k = F.col("id")
    assert got.n == LONG and got["sum"] == spark.range(LONG).agg(F.sum(F.xxhash64(k, F.lit(3)) % 1000000)).first()[0]
    assert seen.rows < 6 * LONG


def test_unmarked_places(spark):
    """Gaps at the ends of the parts, in parts without any mark, and repeated marks."""
    n = D.MARKED
    sets = {"all": (3 * n, set(range(3 * n))), "last": (2 * n + 1, set(range(2 * n))), "edge": (3 * n, set(range(3 * n)) - {n - 1, n}), "hole": (5 * n + 7, {*range(10), 5 * n}), "none": (2, set()), "zero": (0, set())}
    marks = spark.createDataFrame([(k, p) for k, (_, have) in sets.items() for p in [*have, *have]], "k string, place int")
    spans = spark.createDataFrame([(k, length) for k, (length, _) in sets.items()], "k string, length int")
    lost = {(r.k, r._b * n + i) for r in D.unmarked(marks, spans, ["k"]).collect() for i in r._free}
    assert lost == {(k, p) for k, (length, have) in sets.items() for p in range(length) if p not in have}
    assert {r.k: r.gap for r in D.first_unmarked(marks, spans, ["k"]).collect()} == {"last": 2 * n, "edge": n - 1, "hole": 10, "none": 0}


def test_rows_that_the_grid_lacks(spark, long_sheet):
    """A row without any cell ends the table for detection; a given region over it has a blank key there."""
    gone = long_sheet.where("row <> 200")
    assert [r.max_row for r in D.detect_tables(gone).collect()] == [199]
    region = spark.createDataFrame([("t", "long", 1, 1, 1, 1, 300, 8)], "table_id string, sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int")
    tables = T.read_tables(gone, T.region_handles(region))
    assert tables.rows.count() == 299 and [r.row for r in tables.rows.where("blank").collect()] == [200]


def test_sampled_keys_of_a_long_table(spark):
    """The stride's places among keys in the order of first sight, with gaps between their rows."""
    index = spark.range(9001).select(F.lit("t").alias("table_id"), F.lit("s").alias("sheet"), F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("row_key"), F.lit(1).alias("row"), (F.col("id") * F.col("id") % 7 + F.col("id") * 7).alias("first"))
    for size in (1, 2, 7, 300):
        got = {(r.key, r.place) for r in G.sampled_keys(index, size, size).collect()}
        assert got == {(str(p), p) for p in ({0, 9000} if size == 1 else {round(i * 9000 / (size - 1)) for i in range(size)})}
    assert G.sampled_keys(index, 300, 9001).count() == 9001
