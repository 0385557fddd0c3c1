"""Streams, proposals and reports."""

import json

from pyspark.sql import functions as F

from tessella.operators.detect import detect_tables
from tessella.operators.grid import grid_from_lists
from tessella.plans.proposals import Scripted, recut, score_layout
from tessella.sources.reports import card_html, card_json, read_labels, write_log
from tessella.sources.workbook import workbook_bytes
from tessella.streaming.landing import watch_workbooks, windowed_totals

STACKED = [["Region", "Revenue"], ["NA", 100], ["EU", 200], [None], ["Product", "Price"], ["Widget", 9.5], ["Gear", 3.5]]


def test_proposals_never_make_a_sheet_worse(spark):
    grid = grid_from_lists(spark, {"s": STACKED, "t": STACKED, "u": STACKED, "v": STACKED, "ok": STACKED[:3]})
    handles = detect_tables(grid)
    before = {r.sheet: r for r in score_layout(grid, handles).collect()}
    assert (before["s"].coverage, before["s"].total, before["s"].errors) == (6, 12, 0)
    good, bad = [(1, 1, 1, 1, 3, 2), (5, 1, 5, 1, 7, 2)], [(1, 1, 1, 1, 3, 2)]
    greedy = [(1, 1, 1, 1, 7, 2)]  # one region over both: a blank row inside
    asked = Scripted({"s": [good], "t": [bad], "u": [greedy], "v": [[]]})
    after, notes = recut(grid, handles, asked)
    scores = {r.sheet: r for r in score_layout(grid, after).collect()}
    assert (scores["s"].coverage, scores["s"].errors) == (12, 0) and after.where("sheet = 's'").count() == 2
    assert all(scores[s].coverage >= before[s].coverage and scores[s].errors <= before[s].errors for s in before)
    assert sorted(asked.asked) == ["s", "t", "u", "v"]
    assert {(r.sheet, r.category, r.resolution, r.ref) for r in notes.collect()} == {("s", "uncovered-data", "fixed", "s!A5:B7"), ("t", "uncovered-data", "rejected", "t!A5:B7"), ("u", "uncovered-data", "rejected", "u!A5:B7"), ("v", "uncovered-data", "open", "v!A5:B7")}


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook_bytes({"x": STACKED}))
    seen = []
    query = watch_workbooks(spark, str(tmp_path / "in"), lambda grid, n: seen.append(grid.where("sheet is not null").count()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert seen == [len(STACKED)]


def test_windowed_totals(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = windowed_totals(events, "ts", ["event_type"], "value", "1 hour")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    query = windowed_totals(stream, "ts", ["event_type"], "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == events.count()


def test_reports(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"workbook": "w", "difficulty": "easy", "samples": [{"type": "extraction", "id": "a", "expected_value": 5}, {"type": "semantic", "id": "b", "expected_value": "x"}]}))
    labels = read_labels(spark, str(tmp_path))
    assert [(s.id, s.expected_value) for s in labels.first().samples] == [("a", "5"), ("b", "x")]
    card = spark.createDataFrame([("easy", 4, 0.75), (None, 8, 0.5)], "tier string, n int, rate double")
    assert json.loads(card_json(card))[0] == {"tier": "easy", "n": 4, "rate": 0.75}
    page = card_html(card, "a < b")
    assert "a &lt; b" in page and "75.0%" in page and "<td>all</td>" in page
    for _ in range(2):
        write_log(card, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
