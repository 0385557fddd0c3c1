"""Fixtures, and the engine on them."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators.grid import grid_from_lists
from tessella.plans import evaluate as V
from tessella.plans import fixtures as X
from tessella.plans.extract import Config, extract
from tessella.sources import reports


def test_render():
    spec = X.examples()[1].tables[0]
    cells, label = X.render(spec)
    assert label["region"] == "B2:F6" and label["header_region"] == "B3:F3" and label["data_region"] == "B4:F6"
    assert cells[2, 2] == "Spending Plan" and cells[6, 2] == "Total" and cells[6, 3] == 170 and (6, 5) not in cells and cells[6, 6] == 300 and cells[4, 6] == 150
    grouped, label = X.render(X.examples()[3].tables[0])
    assert [grouped.get((2, c)) for c in range(1, 6)] == ["Line", "East", None, "West", None] and label["header_region"] == "A2:E3"
    text, _ = X.render(X.examples()[4].tables[0])
    assert text[2, 2] == "124,500 (a)" and text[2, 3] == "(3,000)" and text[3, 2] == "9,800"
    assert X.literal(-2.5, False, True, False) == "(2.5)" and X.literal(7, False, False, True) == "7 (a)" and X.literal("x", True, True, True) == "x"


def test_samples_agree_with_their_workbook(spark, tmp_path):
    grid, labels = X.grid(spark, X.examples())
    assert [len(x["samples"]) >= 10 for x in labels] == [True] * 5 and X.workbook(X.examples()[0])[1] == X.workbook(X.examples()[0])[1]
    assert X.build_summary(labels)["teams.xlsx"]["boundary"] == 1 and X.build_summary(labels)["teams.xlsx"]["formula_cells"] == 0
    for x in labels:
        (tmp_path / f"{x['workbook']}.json").write_text(json.dumps(x))
    read = reports.read_labels(spark, str(tmp_path))
    bad = V.verify_labels(read, grid).where("not ok").collect()
    assert bad == []
    done = extract(grid, Config(lenses=("vertical", "blocks")))
    scored, _ = V.run_benchmark(read, V.extraction_adapter(read, done))
    failed = {(r.workbook, r.type) for r in scored.where("not passed").collect()}
    # Numbers written as text stay text; a table's name in a phrase does not tell two tables apart.
    assert failed <= {("notes.xlsx", "extraction"), ("notes.xlsx", "semantic"), ("shops.xlsx", "semantic")}


def test_formula_book(spark):
    book = X.FormulaBook()
    for r, (n, a, b) in enumerate((("x", 2, 3.5), ("y", 4, 5.0), ("x", 6, 1.0)), 2):
        book.put("In", f"A{r}", n), book.put("In", f"B{r}", a), book.put("In", f"C{r}", b), book.put("In", f"D{r}", f"=B{r}*C{r}")
    rate = book.put("Set", "B1", 0.5)
    book.name("Rate", "Set", "B1")
    for ref, text, want in (("A1", "=SUM(In!D2:D4)", 33.0), ("A2", f"={rate}*'In'!D3", 10.0), ("A3", '=SUMIF(In!A2:A4,"x",In!B2:B4)', 8), ("A4", "=IF(A1>=30,Rate^2,0)", 0.25), ("A5", "=ROUND(AVERAGE(In!B2:B4)/3,1)", 1.3), ("A6", "=MAX(In!B2:B4)-MIN(A1,A2)+COUNT(In!A2:B4)", -1.0), ("A7", "=A9+1", 1), ("A8", '=IF(In!A2="x",1,2)', 1)):
        book.put("Out", ref, text)
        assert book.value("Out", ref) == want, text
    for ref, text in (("B1", "=B2"), ("B2", "=B1"), ("B3", "=VLOOKUP(A1,A2)"), ("B4", "=nowhere+1")):
        book.put("Bad", ref, text)
    for ref in ("B1", "B3", "B4"):
        with pytest.raises(ValueError):
            book.value("Bad", ref)
    del book.cells["Bad", 1, 2], book.cells["Bad", 2, 2], book.cells["Bad", 3, 2], book.cells["Bad", 4, 2]
    sheets, formulas = book.sheets()
    assert sheets["In"][1][3] == 7.0 and formulas["In", 2, 4] == "=B2*C2"
    grid = grid_from_lists(spark, {"In": [["Key", "B", "C", "D"], *sheets["In"][1:]]}, formulas)
    assert [(r.target, r.expression) for r in extract(grid).formulas.collect()] == [("D", "B*C")]


def test_ledger(spark):
    rows = X.ledger(spark, 3000).cache()
    assert rows.count() == 3000 and rows.select("TxnID").distinct().count() == 3000
    assert rows.where("abs(Gross - Discount - NetRevenue) > 0.001 or abs(NetRevenue - COGS - GrossProfit) > 0.001").count() == 0
    assert rows.where("n = 1777").first() == X.ledger(spark, 2000).where("n = 1777").first()
    months = X.ledger_totals(rows, "Month")
    assert months.count() == 12 and abs(months.agg(F.sum("NetRevenue")).first()[0] - rows.agg(F.sum("NetRevenue")).first()[0]) < 0.01
    declared = X.ledger_totals(rows, "Region").unpivot(["Region"], ["Units", "Tax"], "measure", "declared").withColumn("declared", F.col("declared").cast("double") + F.when((F.col("Region") == "East") & (F.col("measure") == "Tax"), 1).otherwise(0))
    off = V.reconcile(rows, ["Region"], {"Units": "Units", "Tax": "Tax"}, declared, 1e-6).collect()
    assert [(r.Region, r.measure) for r in off] == [("East", "Tax")]


def test_pruned(spark):
    cells = spark.range(2000).select(F.col("id"), (F.col("id") % 10 == 0).alias("used"), (F.col("id") % 2).alias("t"))
    got = X.pruned(cells, "used", F.col("id"), 500)
    assert got.count() == 500 and got.where("used").count() == 200
    each = X.pruned(cells, "used", F.col("id"), 250, "t").groupBy("t").count().collect()
    assert {r.t: r["count"] for r in each} == {0: 250, 1: 250}
