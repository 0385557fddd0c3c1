"""Evaluation against labels: what the engine answers, what the labels say, and score cards. All workbooks and samples are one set of jobs.

Run as `python -m tessella.plans.evaluate LABELS [--json FILE] [--html FILE] [--adapter engine|oracle|noisy]`.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions import text as X
from tessella.functions.cells import cell, cell_text, text_number, values_match
from tessella.functions.formula import plain_function
from tessella.operators import catalog as K
from tessella.operators import evals as E
from tessella.operators import findings as Q
from tessella.operators.coverage import rectangle_iou
from tessella.operators.durable import durable
from tessella.plans.extract import Config, Extraction, extract
from tessella.sources import reports

#: Kind of sample -> capability it counts for.
CAPABILITY = {"boundary": "table_boundaries", "extraction": "value_extraction", "semantic": "semantic_extraction", "formula": "formula_compute"}
TIERS = ("easy", "medium", "hard")
SCORED = "workbook string, difficulty string, capability string, sample_id string, type string, passed boolean, expected string, got string, detail string"
ANSWERS = "workbook string, sample_id string, got string, detail string"


def place(workbook: Column, name: Column) -> Column:
    """A sheet's name among several workbooks."""
    return F.concat_ws("|", workbook, name)


def bounds(ref: Column, prefix: str = "") -> list[Column]:
    """The four bounds of an A1 range in a text column."""
    first, last = F.substring_index(ref, ":", 1), F.substring_index(ref, ":", -1)
    row = lambda c: F.regexp_extract(c, r"(\d{1,9})$", 1).try_cast("int")
    col = lambda c: a1.index_column(F.regexp_extract(c, r"^\$?([A-Za-z]{1,3})", 1)).cast("int")
    return [row(first).alias(f"{prefix}min_row"), col(first).alias(f"{prefix}min_col"), row(last).alias(f"{prefix}max_row"), col(last).alias(f"{prefix}max_col")]


def same(expected: Column, got: Column, tolerance: Column | float, dtype: Column) -> Column:
    """Numbers within a tolerance relative to the expected one; other values as trimmed texts. A missing answer never matches."""
    e, g = text_number(expected), text_number(got)
    near = F.abs(e - g) <= tolerance * F.greatest(F.abs(e), F.lit(1.0))
    return F.coalesce(F.when(dtype == "number", near).otherwise(F.trim(expected) == F.trim(got)), F.lit(False))


def label_tables(labels: DataFrame) -> DataFrame:
    """workbook, table_id, name, sheet, place, region, bounds, lpos of the labelled tables."""
    t = labels.select("workbook", F.posexplode("tables").alias("lpos", "t")).select("workbook", "lpos", "t.*")
    return t.withColumn("place", place(F.col("workbook"), F.col("sheet"))).select("*", *bounds(F.col("region")))


def label_samples(labels: DataFrame) -> DataFrame:
    return labels.select("workbook", "difficulty", F.explode("samples").alias("s")).select("workbook", "difficulty", F.col("s.id").alias("sample_id"), "s.*").drop("id")


def label_measures(labels: DataFrame) -> DataFrame:
    return labels.select("workbook", "difficulty", F.explode("measures").alias("m")).select("workbook", "difficulty", "m.*")


def label_cells(labels: DataFrame) -> DataFrame:
    c = label_tables(labels).select("workbook", "place", "table_id", "lpos", F.explode("cells").alias("c"))
    at = bounds(F.col("c.cell_ref"))
    return c.select("workbook", "place", "table_id", "lpos", "c.*", at[0].alias("row"), at[1].alias("col"))


def grid_from_labels(labels: DataFrame) -> DataFrame:
    """Sheets rebuilt from labels: cells, row keys, headings and titles where the labels place them. What they do not tell (the key's heading, group headings) is filled in.

    One sheet for each workbook and sheet, named by place(); sheet_idx in the order of the labels. Formula cells hold their values and their formulas.
    """
    t = label_tables(labels)
    number = text_number(F.col("text"))
    head = t.select("place", "lpos", "name", "columns", "row_keys", *bounds(F.col("header_region"), "h_"), F.col("min_row").alias("top"), "min_col", "max_col", "max_row")
    parts = [
        label_cells(labels).select("place", "row", "col", F.when(F.col("is_formula"), F.col("value")).otherwise(F.coalesce("raw", "value")).alias("text")),
        head.select("place", F.explode("row_keys").alias("k"), "min_col").select("place", F.col("k.row_index").alias("row"), F.col("min_col").alias("col"), F.col("k.label").alias("text")),
        head.select("place", "h_max_row", F.explode("columns").alias("c")).select("place", F.col("h_max_row").alias("row"), F.col("c.col_index").alias("col"), F.col("c.label").alias("text")),
        head.select("place", F.col("h_min_row").alias("row"), F.col("min_col").alias("col"), F.lit("Item").alias("text")),
        head.where("h_max_row > h_min_row").select("place", F.col("h_min_row").alias("row"), F.explode(F.sequence(F.col("min_col") + 1, F.col("max_col"))).alias("col"), F.lit("Group").alias("text")),
        head.where("top < h_min_row").select("place", F.col("top").alias("row"), F.col("min_col").alias("col"), F.col("name").alias("text")),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    one = every.where("text is not null").groupBy("place", "row", "col").agg(F.max("text").alias("text"))
    told = label_cells(labels).where("is_formula and raw like '=%'").groupBy("place", "row", "col").agg(F.max("raw").alias("formula"))
    one = durable(one.join(told, ["place", "row", "col"], "left"), "texts")
    f = F.col("formula")
    kind = F.when(number.isNotNull() & F.col("text").rlike(r"^-?\d{1,18}$"), cell(number.cast("bigint"), "int", f)).when(number.isNotNull(), cell(number, "num", f)).otherwise(cell(F.col("text"), "str", f))
    rows = one.select("place", "row", "col", kind.alias("cell")).groupBy("place", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("of"), F.max("col").alias("last"))
    order = t.groupBy("place").agg(F.min("lpos").alias("sheet_idx"))
    return rows.join(order, "place").select(F.col("place").alias("sheet"), "row", F.transform(F.sequence(F.lit(1), "last"), lambda i: F.try_element_at("of", i)).alias("cells"), "sheet_idx")


def map_tables(labelled: DataFrame, handles: DataFrame) -> DataFrame:
    """Labelled tables with the detected table of their sheet that overlaps them most (found, found_region, iou); of equals the first. Without any on the sheet there is none."""
    d = handles.select(F.col("sheet").alias("place"), F.col("table_id").alias("found"), Q.region_of().alias("found_region"), *(F.col(c).alias(f"d_{c}") for c in ("min_row", "min_col", "max_row", "max_col")))
    both = labelled.select("workbook", "table_id", "place", *(F.col(c).alias(f"l_{c}") for c in ("min_row", "min_col", "max_row", "max_col"))).join(d, "place").withColumn("iou", rectangle_iou("l_", "d_"))
    best = Window.partitionBy("workbook", "table_id").orderBy(F.desc("iou"), F.asc("found"))  # the few tables of one sheet
    top = both.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("workbook", "table_id", "found", "found_region", "iou")
    return labelled.join(top, ["workbook", "table_id"], "left")


@dataclass(frozen=True)
class Adapter:
    """What answers: each function takes labels and gives ANSWERS (or measures: workbook, table_id, row_label, col_label, value)."""

    name: str
    boundary: Callable[[DataFrame], DataFrame]
    extraction: Callable[[DataFrame], DataFrame]
    semantic: Callable[[DataFrame], DataFrame]
    formula: Callable[[DataFrame], DataFrame]
    measures: Callable[[DataFrame], DataFrame]


def engine_adapter(labels: DataFrame, grid: DataFrame | None = None, config: Config = Config()) -> Adapter:
    """The engine itself, on a grid whose sheets are named by place(); without one, on the grid rebuilt from the labels."""
    done = extract(grid_from_labels(labels) if grid is None else grid, config)
    return extraction_adapter(labels, done)


def extraction_adapter(labels: DataFrame, done: Extraction) -> Adapter:
    mapped = durable(map_tables(label_tables(labels), done.handles), "mapped")
    good = done.indices()
    values = durable(K.cell_values(good).select(F.col("table_id").alias("found"), F.col("row_key").alias("row_label"), F.col("column_name").alias("col_label"), cell_text(F.col("cell")).alias("got")), "cell-values")
    columns, rows = K.catalog_frames(done)
    # Each label's table under its own name, as phrases name tables of one workbook only.
    named = mapped.where("found is not null").select("workbook", F.col("table_id").alias("label_id"), "lpos", F.col("found").alias("table_id"))
    scope = lambda f: f.drop("tpos").join(named, "table_id").select(place(F.col("workbook"), F.col("label_id")).alias("table_id"), F.col("lpos").alias("tpos"), *[c for c in f.columns if c not in ("table_id", "tpos")], "workbook")
    cols, keys = durable(scope(columns), "columns"), durable(scope(rows), "rows")

    def resolved(phrases: DataFrame) -> DataFrame:
        """pid, workbook, label_id, row_label, col_label, got of phrases (pid, workbook, phrase): each within its workbook."""
        out = None
        for r in phrases.select("workbook").distinct().orderBy("workbook").collect():  # one catalog for each workbook of the labels
            mine = lambda f, w=r.workbook: f.where(F.col("workbook") == w).drop("workbook")
            one = K.R.resolve(mine(phrases), mine(cols), mine(keys)).withColumn("workbook", F.lit(r.workbook))
            out = one if out is None else out.union(one)
        at = named.select("workbook", "label_id", F.col("table_id").alias("found"), place(F.col("workbook"), F.col("label_id")).alias("table_id")).drop("workbook")
        return out.join(at, "table_id").select("pid", "workbook", "label_id", "found", F.col("row_key").alias("row_label"), F.col("column_name").alias("col_label")).join(values, ["found", "row_label", "col_label"], "left")

    def boundary(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'boundary'").join(mapped.select("workbook", "table_id", "found_region"), ["workbook", "table_id"], "left")
        return s.select("workbook", "sample_id", F.col("found_region").alias("got"), F.lit("").alias("detail"))

    def extraction(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'extraction'").join(mapped.select("workbook", "table_id", "found"), ["workbook", "table_id"], "left").join(values, ["found", "row_label", "col_label"], "left")
        return s.select("workbook", "sample_id", "got", F.concat_ws("/", "table", "row_label", "col_label").alias("detail"))

    def semantic(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'semantic'")
        found = resolved(s.select(F.col("sample_id").alias("pid"), "workbook", F.col("query").alias("phrase"))).withColumnRenamed("pid", "sample_id").drop("workbook")
        both = s.drop("row_label", "col_label").join(found, "sample_id", "left")
        right = (F.col("label_id") == F.col("expected_table_id")) & (F.col("row_label") == F.col("expected_row_label")) & (F.col("col_label") == F.col("expected_col_label"))
        return both.select("workbook", "sample_id", "got", F.concat(F.lit("place "), F.when(F.coalesce(right, F.lit(False)), "right").otherwise("wrong"), F.lit(": "), F.col("query")).alias("detail"))

    def formula(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'formula'")
        asked = s.select("workbook", "sample_id", F.explode("operands").alias("symbol", "phrase")).withColumn("pid", F.concat_ws("|", "sample_id", "symbol"))
        found = resolved(asked.select("pid", "workbook", "phrase")).select("pid", text_number(F.col("got")).alias("value"))
        bound = asked.join(found, "pid", "left").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "value"))).alias("of"))
        return _computed(s.join(bound, "sample_id", "left"))

    def measures(labels: DataFrame) -> DataFrame:
        m = K.measures(done).withColumnRenamed("table_id", "found")
        return mapped.select("workbook", "table_id", "found").join(m, "found").select("workbook", "table_id", F.col("row_key").alias("row_label"), F.col("column_name").alias("col_label"), F.col("value").cast("string").alias("value"))

    return Adapter("engine", boundary, extraction, semantic, formula, measures)


def _computed(rows: DataFrame) -> DataFrame:
    """Answers of formula samples from expression and `of`, the operands' numbers; an operand without one, or an expression that fails, gives none."""

    def value(expression: str, of: dict | None) -> str | None:
        if not of or any(v is None for v in of.values()):
            return None
        try:
            return repr(float(plain_function(expression)(of)))
        except (ValueError, ArithmeticError, KeyError, TypeError):
            return None

    made = F.udf(value, "string", useArrow=True)
    return rows.select("workbook", "sample_id", made("expression", "of").alias("got"), F.col("description").alias("detail"))


def oracle_adapter(labels: DataFrame) -> Adapter:
    """Answers from the labels themselves."""
    answer = lambda kind, got: lambda labels: label_samples(labels).where(F.col("type") == kind).select("workbook", "sample_id", got.alias("got"), F.lit("").alias("detail"))

    def boundary(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'boundary'").join(label_tables(labels).select("workbook", "table_id", "region"), ["workbook", "table_id"], "left")
        return s.select("workbook", "sample_id", F.col("region").alias("got"), F.lit("").alias("detail"))

    def extraction(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'extraction'").join(label_cells(labels).select("workbook", "table_id", "row_label", "col_label", F.col("value").alias("got")), ["workbook", "table_id", "row_label", "col_label"], "left")
        return s.select("workbook", "sample_id", "got", F.lit("").alias("detail"))

    def formula(labels: DataFrame) -> DataFrame:
        s = label_samples(labels).where("type = 'formula'")
        asked = s.select("workbook", "sample_id", F.explode("operands").alias("symbol", "semantic_name")).join(label_measures(labels).select("workbook", "semantic_name", text_number(F.col("value")).alias("value")), ["workbook", "semantic_name"], "left")
        return _computed(s.join(asked.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "value"))).alias("of")), "sample_id", "left"))

    measures = lambda labels: label_measures(labels).select("workbook", "table_id", "row_label", "col_label", "value")
    return Adapter("oracle", boundary, extraction, answer("semantic", F.col("expected_value")), formula, measures)


def noisy_adapter(labels: DataFrame, rate: float = 0.18, seed: int = 7) -> Adapter:
    """The oracle with errors at a rate, by a hash of sample and seed, so that reruns agree: it must score below the oracle."""
    truth = oracle_adapter(labels)
    hit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *(F.col(x) for x in c)), F.lit(10_000)) < int(rate * 10_000)
    number = text_number(F.col("got"))
    off = lambda kind, change: lambda labels: getattr(truth, kind)(labels).withColumn("got", F.when(hit("sample_id") & change.isNotNull(), change.cast("string")).otherwise(F.col("got")))
    r = bounds(F.col("got"))
    shorter = F.concat(a1.cell_text(r[0], r[1]), F.lit(":"), a1.cell_text(F.greatest(r[0], r[2] - 1), r[3]))

    def measures(labels: DataFrame) -> DataFrame:
        m = truth.measures(labels)
        changed = F.when(hit("table_id", "col_label", "row_label"), (text_number(F.col("value")) + 1).cast("string")).otherwise(F.col("value"))
        return m.where(~hit("row_label", "col_label", "table_id")).withColumn("value", F.coalesce(changed, "value"))

    return Adapter("noisy", off("boundary", shorter), off("extraction", number + 1), off("semantic", number * 1.1), off("formula", number * 1.25), measures)


def run_benchmark(labels: DataFrame, adapter: Adapter) -> tuple[DataFrame, DataFrame]:
    """SCORED rows of all samples, and tp, fp, fn of measures by workbook."""
    answers = None
    for kind in CAPABILITY:
        one = getattr(adapter, kind)(labels)
        answers = one if answers is None else answers.unionByName(one)
    s = label_samples(labels).join(answers, ["workbook", "sample_id"], "left")
    boxes = s.select("*", *bounds(F.col("expected_region"), "e_"), *bounds(F.col("got"), "g_"))
    iou = F.when((F.col("type") == "boundary") & F.col("got").rlike(r"^[A-Z]+\d+:[A-Z]+\d+$"), rectangle_iou("e_", "g_")).otherwise(0.0)
    tolerance = F.coalesce("tolerance", F.when(F.col("type") == "formula", 1e-6).otherwise(1e-9))
    dtype = F.when(F.col("type") == "formula", "number").otherwise(F.coalesce("dtype", F.lit("number")))
    passed = F.when(F.col("type") == "boundary", F.col("got").isNotNull() & (iou >= F.coalesce("min_iou", F.lit(0.999)))).otherwise(same(F.col("expected_value"), F.col("got"), tolerance, dtype))
    capability = F.create_map(*(F.lit(x) for pair in CAPABILITY.items() for x in pair))[F.col("type")]
    detail = F.when(F.col("type") == "boundary", F.format_string("IoU=%.3f", iou)).otherwise(F.col("detail"))
    scored = boxes.select("workbook", "difficulty", capability.alias("capability"), "sample_id", "type", F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce("expected_value", "expected_region").alias("expected"), "got", detail.alias("detail"))
    return durable(scored, "scored"), durable(score_workbook_measures(label_measures(labels), adapter.measures(labels)), "measures")


def score_workbook_measures(labelled: DataFrame, detected: DataFrame) -> DataFrame:
    """workbook, difficulty, tp, fp, fn: a labelled measure is found by one detection of its place and value; further ones, and other values, are false."""
    keys = ["workbook", "table_id", "row_label", "col_label"]
    want = labelled.groupBy(*keys).agg(F.max("value").alias("want"))
    both = detected.join(want, keys, "left")
    dtype = F.when(text_number(F.col("want")).isNotNull(), "number").otherwise("string")
    hits = both.withColumn("ok", F.col("want").isNotNull() & same(F.col("want"), F.col("value"), 1e-9, dtype))
    of = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))
    found = of.groupBy("workbook").agg(F.sum(F.least("right", F.lit(1))).alias("tp"), F.sum(F.col("n") - F.least("right", F.lit(1))).alias("fp"))
    total = labelled.select("workbook", "difficulty", *keys[1:]).distinct().groupBy("workbook", "difficulty").agg(F.count("*").alias("n"))
    return total.join(found, "workbook", "left").fillna(0, ["tp", "fp"]).select("workbook", "difficulty", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"))


def summary(scored: DataFrame, measures: DataFrame) -> dict:
    """Pass rates by capability, tier, workbook and over all, and precision, recall and F1 of measures. A group without samples passes."""
    cards = {r.grp: r for r in E.pass_rates(scored, {"capability": list(CAPABILITY.values()), "difficulty": list(TIERS), "workbook": []}).collect()}
    pick = lambda kind: {k.split(":", 1)[1]: {"passed": r.n_passed, "total": r.n, "rate": r.rate} for k, r in sorted(cards.items()) if k.startswith(f"{kind}:")}
    counts = measures.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    m = E.precision_recall(counts).first().asDict()
    total = cards["all:"]
    return {"overall": {"passed": total.n_passed, "total": total.n, "rate": total.rate}, "by_capability": pick("capability") | {"measure_detection": m}, "by_difficulty": pick("difficulty"), "by_workbook": pick("workbook")}


def payload(name: str, scored: DataFrame, measures: DataFrame) -> dict:
    """Everything of a run as one JSON value; its size is that of the labels."""
    return {"summary": {"adapter": name} | summary(scored, measures), "samples": [r.asDict() for r in scored.orderBy("sample_id").collect()], "measure_detail": [r.asDict() for r in E.precision_recall(measures).orderBy("workbook").collect()]}


def verify_labels(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """workbook, check, ok, message: whether labels agree with the sheets and with themselves.

    Regions lie inside their sheet; cells hold their literal, from which their value can be recovered; measures and samples point to cells with their values; formulas of samples give what they should.
    """
    long = grid.select(F.col("sheet").alias("place"), "row", F.posexplode("cells").alias("i", "cell")).select("place", "row", (F.col("i") + 1).alias("col"), cell_text(F.col("cell")).alias("text"))
    size = grid.groupBy(F.col("sheet").alias("place")).agg(F.max("row").alias("rows"), F.max(F.size("cells")).alias("cols"))
    t, c = label_tables(labels), label_cells(labels)
    kind = lambda v: F.when(text_number(v).isNotNull(), "number").otherwise("string")
    say = lambda *p: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    made = [t.join(size, "place", "left").select("workbook", F.lit("region").alias("check"), F.coalesce((F.col("max_row") <= F.col("rows")) & (F.col("max_col") <= F.col("cols")), F.lit(False)).alias("ok"), say(F.col("table_id"), F.col("region"), "exceeds the sheet").alias("message"))]
    seen = c.join(long, ["place", "row", "col"], "left")
    raw = X.parse_raw(F.col("text"))
    recovered = F.coalesce(raw["number"].cast("string"), raw["text"])
    literal = same(F.coalesce("raw", "value"), F.col("text"), 1e-9, kind(F.coalesce("raw", "value")))
    made.append(seen.select("workbook", F.lit("literal"), F.col("is_formula") | literal, say(F.col("cell_ref"), "holds", F.col("text"), "not", F.col("raw"))))
    made.append(seen.select("workbook", F.lit("value"), same(F.col("value"), recovered, F.when(F.col("is_formula"), 1e-6).otherwise(1e-9), kind(F.col("value"))), say(F.col("cell_ref"), "value", F.col("value"), "is not in", F.col("text"))))
    facts = c.groupBy("workbook", "table_id", "row_label", "col_label").agg(F.max("value").alias("fact"))
    m = label_measures(labels)
    made.append(m.join(facts, ["workbook", "table_id", "row_label", "col_label"], "left").select("workbook", F.lit("measure"), same(F.col("value"), F.col("fact"), 1e-9, kind(F.col("value"))), say("measure", F.col("semantic_name"), F.col("value"), "is not", F.col("fact"))))
    s = label_samples(labels)
    tolerance = F.coalesce("tolerance", F.lit(1e-9))
    ext = s.where("type = 'extraction'").join(facts, ["workbook", "table_id", "row_label", "col_label"], "left")
    made.append(ext.select("workbook", F.lit("extraction"), same(F.col("expected_value"), F.col("fact"), tolerance, F.col("dtype")), say(F.col("sample_id"), F.col("expected_value"), "is not", F.col("fact"))))
    sem = s.where("type = 'semantic'").drop("table_id", "row_label", "col_label").join(facts.toDF("workbook", "expected_table_id", "expected_row_label", "expected_col_label", "fact"), ["workbook", "expected_table_id", "expected_row_label", "expected_col_label"], "left")
    made.append(sem.select("workbook", F.lit("semantic"), same(F.col("expected_value"), F.col("fact"), tolerance, F.col("dtype")), say(F.col("sample_id"), F.col("expected_value"), "is not", F.col("fact"))))
    bnd = s.where("type = 'boundary'").join(t.select("workbook", "table_id", "region"), ["workbook", "table_id"], "left")
    made.append(bnd.select("workbook", F.lit("boundary"), F.coalesce(F.col("expected_region") == F.col("region"), F.lit(False)), say(F.col("sample_id"), F.col("expected_region"), "is not", F.col("region"))))
    fml = s.where("type = 'formula'").join(oracle_adapter(labels).formula(labels).select("sample_id", "got"), "sample_id", "left")
    made.append(fml.select("workbook", F.lit("formula"), same(F.col("expected_value"), F.col("got"), F.coalesce("tolerance", F.lit(1e-6)), F.lit("number")), say(F.col("sample_id"), F.col("expected_value"), "is not", F.col("got"))))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out.withColumn("ok", F.coalesce("ok", F.lit(False)))


def reconcile(ledger: DataFrame, keys: list[str], sums: dict[str, str], declared: DataFrame, tolerance: float = 1e-9, most: float | None = None) -> DataFrame:
    """Groups whose declared totals differ from the ledger's, or are missing: keys, measure, live, declared.

    sums: measure -> column of the ledger; declared: keys, measure, declared. The tolerance grows with the total; most is the largest difference
    that passes however large the total is (half a cent, for totals rounded to cents).
    """
    live = ledger.groupBy(*keys).agg(*(F.sum(c).cast("double").alias(m) for m, c in sums.items())).unpivot(keys, list(sums), "measure", "live")
    both = live.join(declared, [*keys, "measure"], "left")
    same = values_match(F.col("live"), F.col("declared"), tolerance)
    return both.where(~(same if most is None else same & (F.abs(F.col("live") - F.col("declared")) <= most)))


ADAPTERS: dict[str, Callable[[DataFrame], Adapter]] = {"engine": engine_adapter, "oracle": oracle_adapter, "noisy": noisy_adapter}


def main() -> None:
    ask = argparse.ArgumentParser(description="Score the engine, or an oracle, against label files.")
    ask.add_argument("labels")
    ask.add_argument("--adapter", choices=sorted(ADAPTERS), default="engine")
    ask.add_argument("--json")
    ask.add_argument("--html")
    given = ask.parse_args()
    spark = SparkSession.builder.getOrCreate()
    labels = reports.read_labels(spark, given.labels).cache()
    adapter = ADAPTERS[given.adapter](labels)
    scored, measures = run_benchmark(labels, adapter)
    card = E.score_card(scored, "capability", "difficulty", "workbook")
    print(reports.card_text(card, f"adapter {adapter.name}", failing=scored))
    if given.json:
        Path(given.json).write_text(json.dumps(payload(adapter.name, scored, measures), indent=1))
    if given.html:
        Path(given.html).write_text(reports.card_html(card, f"adapter {adapter.name}") + reports.failing_html(scored))


if __name__ == "__main__":
    main()
