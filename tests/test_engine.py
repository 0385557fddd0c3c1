"""Functions and operators of the engine on small sheets; the query catalogue against DuckDB."""

import datetime as dt
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions import text as X
from tessella.functions.cells import number_text, text_number
from tessella.functions.formula import bind_operands, compile_expression, expression_json, plain_function, translate
from tessella.operators import grid as S
from tessella.plans.catalogue import ORACLES, QUERIES
from tessella.plans.extract import extract
from tessella.sources.workbook import read_workbooks, workbook_bytes


@given(st.integers(1, 18278))
def test_letters_round_trip(n):
    assert a1.column_index(a1.column_letters(n)) == n


def test_a1_columns(spark):
    ns = [1, 26, 27, 52, 53, 702, 703, 704, 1378, 1379, 18278]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", a1.letters_column(F.col("n")).alias("l"))
    assert [(r.n, r.l) for r in rows.collect()] == [(n, a1.column_letters(n)) for n in ns]
    assert [r.i for r in rows.select(a1.index_column(F.col("l")).alias("i")).collect()] == ns
    assert a1.parse_range("F14:B3") == (3, 2, 14, 6)


def test_number_text_is_what_float_takes(spark):
    texts = ["1", " 2 ", "1_000", "1__0", "_1", ".5", "5.", ".", "1e3", "1e", "inf", "-Infinity", "nan", "1d", "2f", "1,200", "", "0x1", "+3", "--3", "1e+5", "٣"[:0]]

    def brute(t):
        try:
            return float(t)
        except ValueError:
            return None

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", number_text(F.col("t")).alias("ok"), text_number(F.col("t")).alias("v")).collect()
    for r in rows:
        want = brute(texts[r.i])
        assert r.ok == (want is not None) and (want is None or want != want or r.v == want)


def test_formulas(spark):
    one = spark.range(1).select(F.lit(7.0).alias("a"), F.lit(2.0).alias("b"), F.array(F.lit(1.0), F.lit(2.5)).alias("r"))
    names = {c: F.col(c) for c in "abr"}
    for text, want in (("a + b * 3", 13), ("-a // b", -4), ("a / (b - 2)", None), ("ROUND(b + 0.5)", 2), ("IF(a > b, a, 1 / 0)", 7), ("SUM(r) + COUNT(r)", 5.5), ("MAX(a, b) ** 2", 49), ("AVG(r)", 1.75)):
        assert one.select(compile_expression(text, names).alias("v")).first().v == want, text
    for bad in ("c + 1", "a if b else 1", "__import__('os')", "a +", "a < b < 3", "'x'"):
        with pytest.raises(ValueError):
            compile_expression(bad, names)
    assert expression_json("a * (1 - b)") == '{"op": "*", "args": [{"var": "a"}, {"op": "-", "args": [{"const": 1}, {"var": "b"}]}]}'
    cols = {1: "Units", 2: "Price", 3: "Tax", 4: "Total"}
    assert translate("=A2*B2", 2, cols) == ("Units*Price", ["Units", "Price"], "")
    assert translate("=SUM(A5:C5)^2", 5, cols)[0] == "(Units+Price+Tax)**2"
    assert translate("=Other!A2", 2, cols)[2] == "cross-sheet reference" and translate("=VLOOKUP(A2,B2)", 2, cols)[2].startswith("unsupported function: VLOOKUP")
    assert translate("=A1+1", 2, cols)[0] is None and translate("=1+1", 2, cols)[0] is None and translate("=Z2", 2, cols)[0] is None
    assert translate("= $A$2 * (1 - C2) ", 2, cols) == ("Units * (1 - Tax)", ["Units", "Tax"], "") and translate("=sum( A2 : B2 )/B2", 2, cols)[0] == "(Units+Price)/Price"
    for bad, reason in (('=A2&"x"', "unparseable expression"), ("=A2:B2", "unparseable expression"), ("=SUM(A2,B2)", "unsupported function: SUM (Phase 1)"), ("=SUM(A1:A9)", "reference to another row"), ("=rate*A2", "unknown name rate"), ("=A2>1", "unparseable expression")):
        assert translate(bad, 2, cols) == (None, [], reason), bad
    assert translate("=A2+B2", 2, {1: "Net value", 2: "Tax"})[2] == "unparseable expression"
    env = {"a": 7.0, "b": 2.0, "r": [1.0, 2.5]}
    for text, want in (("a + b * 3", 13), ("-a // b", -4), ("ROUND(b + 0.5)", 2), ("IF(a > b, a, 1 / 0)", 7), ("SUM(r) + COUNT(r)", 5.5), ("MAX(a, b) ** 2", 49), ("AVG(r)", 1.75)):
        assert plain_function(text)(env) == want
    with pytest.raises(ValueError):
        plain_function("a if b else 1")
    bound = bind_operands([("x", "column", "a"), ("y", "cell", "B2"), ("z", "range", "A1:A2"), ("rate", "param", "")], lambda ref: 5.0, lambda ref: [1.0, 2.0], {"rate": 0.5})
    assert one.select(compile_expression("x + y + SUM(z) * rate", bound).alias("v")).first().v == 13.5
    with pytest.raises(ValueError):
        bind_operands([("rate", "param", "")])


def test_names_and_raw_text(spark):
    row = spark.range(1)
    get = lambda c: row.select(c.alias("v")).first().v
    assert get(X.tokens(F.lit("netValue of SKU-100"))) == ["net", "value", "of", "sku", "100"]
    assert [get(X.tokens(F.lit(t))) for t in ("GDPGrowth", "totalGDP", "HTTPServer2Go", "ABC")] == [["gdp", "growth"], ["total", "gdp"], ["http", "server2", "go"], ["abc"]]
    for text, want in (("124,500 (a)", 124500), ("(3000)", -3000), ("12.5", 12.5), (" 1e3 ", 1000), ("(1,200.5) (b)", -1200.5)):
        assert tuple(get(X.parse_raw(F.lit(text)))) == (want, None)
    for text in ("n/a", "", "(a)", "12 apples"):
        assert tuple(get(X.parse_raw(F.lit(text)))) == (None, text)
    for v in (0.0, 1.0, -2.5, 1234.0, 0.5, 123456.0, 1234567.0, 1e-5, 0.0001, 1e20, 3.14159265, 100.0, 99999.96, 0.1 + 0.2):
        assert get(X.general(F.lit(v))) == f"{v:g}", v
    assert [get(X.format_raw(F.lit(v), thousands=True, parens=True, footnote="a")) for v in (1234.5, -1234567.0)] == ["1,234.5 (a)", "(1,234,567)"]
    said = {
        'so ```json\n{"a": {"b": 1}}\n``` ok': '{"a": {"b": 1}}', '```\n{"x": 1}\n```': '{"x": 1}', ' {"ok": true} ': '{"ok": true}', "{broken": None, "no json": None, "": None,
        'Sure! {"a": {"b": [1, "}"]}} and {"c": 2} follow.': '{"a": {"b": [1, "}"]}}', 'use {b} or {"a": 1}': '{"a": 1}', '{"a":1} and {b}': '{"a":1}', '{"q": "say \\"{\\" now"} x': '{"q": "say \\"{\\" now"}',
    }
    rows = spark.createDataFrame(list(said.items()), "t string, want string").select("t", "want", X.extract_json(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    prefixes = ["coverage gap: x", "column-name: x", "column-integrity: x", "column-coverage: x", "row-integrity: x", "row-key collision: x", "blank row key: x", "empty index: x", "round-trip: x", "dtype-mismatch: x", "computed mismatch x", "dtype mismatch", ""]
    assert [get(X.category(F.lit(m))) for m in prefixes] == ["coverage-gap", "column-name", "column-integrity", "column-coverage", "row-integrity", "row-key-collision", "blank-row-key", "empty-index", "round-trip", "dtype-mismatch", "computed", "other", "other"]


SHEETS = {
    "plain": [["Sales report"], [None], ["Region", "Price", "Units", "Revenue"], ["NA", 1.5, 4, 6.0], ["EU", 2.0, 5, 10.0], ["EU", 2.5, 2, 5.0]],
    "stacked": [["Region", "Revenue"], ["NA", 100], ["EU", 200], [None], ["Product", "Price"], ["Widget", 9.5], ["Gear", 3.5]],
    "grouped": [[None, "2024", None], ["Item", "Q1", "Q2"], ["a", 1, 2], ["b", 3, 4]],
}
FORMULAS = {("plain", r, 4): f"=B{r}*C{r}" for r in (4, 5, 6)}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "one.xlsx").write_bytes(workbook_bytes(SHEETS, FORMULAS))
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    return read_workbooks(spark, str(folder)), folder


def test_workbook_round_trip(spark, made):
    rows = made[0].collect()
    assert [r.sheet for r in rows if r.workbook.endswith("broken.xlsx")] == [None]
    got = {(r.sheet, r.row): r.cells for r in rows if r.sheet}
    assert got["plain", 4][0].str == "NA" and got["plain", 4][3].num == 6.0 and got["plain", 5][3].formula == "=B5*C5"
    when = dt.datetime(2024, 3, 7, 12)
    (made[1] / "types.xlsx.tmp").write_bytes(workbook_bytes({"t": [[True, when, 3, "x & <y>", None, 2.5]]}))
    cells = read_workbooks(spark, str(made[1]), "*.tmp").first().cells
    assert (cells[0].bool, cells[1].ts, cells[2].int, cells[3].str, cells[4], cells[5].num) == (True, when, 3, "x & <y>", None, 2.5)


def test_extraction(spark, made):
    e = extract(made[0].where("sheet is not null").drop("workbook"))
    handles = {r.sheet: (r.table_id, r.header_row, r.span, r.min_row, r.max_row, r.max_col) for r in e.handles.collect()}
    assert handles["plain"] == ("plain__0", 3, 1, 3, 6, 4) and handles["stacked"][:3] == ("stacked__1", 1, 1) and handles["stacked"][4] == 3 and handles["grouped"][4] == 4
    columns = {(r.sheet, r.name): (r.dtype, r.role) for r in e.columns.collect()}
    assert columns["plain", "Revenue"] == ("number", "computed") and columns["plain", "Region"] == ("string", "key")
    assert [(r.target, r.expression) for r in e.formulas.collect()] == [("Revenue", "Price*Units")]
    found = {(r.sheet, r.category) for r in e.findings.collect()}
    assert ("plain", "row-key-collision") in found and ("stacked", "uncovered-data") in found
    asked = spark.createDataFrame([("plain", "EU", "Units"), ("plain", "NA", "Price"), ("plain", "NA", "Nothing"), ("plain", "XX", "Units")], "sheet string, row_key string, column_name string")
    got = {(r.row_key, r.column_name): (r.status, r.cell_ref) for r in e.query(asked).collect()}
    assert got == {("EU", "Units"): ("ok", "C6"), ("NA", "Price"): ("ok", "B4"), ("NA", "Nothing"): ("unknown-column", None), ("XX", "Units"): ("unknown-row", None)}


def test_transposition_is_its_own_inverse(spark):
    grid = S.grid_from_lists(spark, {"s": [["a", "b", "c"], [1, None, 2.5], ["x", True, None]]})
    back = S.transposed(S.transposed(grid))
    assert {(r.row, r.col, r.cell) for r in S.long_cells(back).collect()} == {(r.row, r.col, r.cell) for r in S.long_cells(grid).collect()}


@settings(max_examples=8, deadline=None)
@given(n=st.integers(2, 400), size=st.integers(2, 60))
def test_stride_sample(spark, n, size):
    rows = spark.range(n).withColumnRenamed("id", "i")
    want = set(range(n)) if n <= size else {round(j * (n - 1) / (size - 1)) for j in range(size)}
    assert {r.i for r in S.stride_sample(rows, size, total=n).collect()} == want


#: One query of each family; the driver runs all of them.
SOME = ("q03_point_lookup_batch", "q08_header_candidates", "q13_plan_bands", "q15_key_collisions", "q19_dtype_conformance", "q23_coverage_score", "q31_computed_mismatch", "q35_match_tier", "q37_semantic_answer", "q44_scorecard_grouping_sets", "q53_candidate_rank")


@pytest.mark.parametrize("name", SOME)
def test_catalogue(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda d: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_tall_piece(spark):
    from tessella.operators.coverage import pieces

    tall = [("s", r, 3) for r in range(1, 1001)]
    apart = [("s", r, 9 + r % 2) for r in range(1, 150, 1) if r != 100] + [("s", 5, 20), ("other", 5, 3)]
    got = pieces(spark.createDataFrame(tall + apart, "sheet string, row int, col int")).collect()
    assert sorted((r.sheet, r.min_row, r.min_col, r.max_row, r.max_col, r.n) for r in got) == [
        ("other", 5, 3, 5, 3, 1), ("s", 1, 3, 1000, 3, 1000), ("s", 1, 9, 99, 10, 99), ("s", 5, 20, 5, 20, 1), ("s", 101, 9, 149, 10, 49),
    ]
