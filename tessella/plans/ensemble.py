"""Layouts of sheets: lenses propose where the tables lie, the assessment picks one proposal for each sheet.

A lens is a function from a grid (and a runner, if it asks for one) to candidates: sheet, j (place of the table in its proposal), confidence and the handle's columns.
All candidates of all sheets are scored in one set of jobs. No lens can make a sheet worse than the vertical one leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.operators import coverage as C
from tessella.operators import detect as D
from tessella.operators import findings as Q
from tessella.operators import gate as G
from tessella.operators import layout as L
from tessella.operators.durable import durable
from tessella.operators.grid import long_cells, transposed
from tessella.operators.probes import SheetProbe
from tessella.plans import ports as P
from tessella.plans import tables as T

CANDIDATE = "sheet string, j int, confidence double, orientation string, header_row int, span int, min_row int, min_col int, max_row int, max_col int, ambiguous boolean, reason string"
CANDIDATE_NAMES = [part.split()[0] for part in CANDIDATE.split(", ")]
BASELINE = "vertical"
#: Proposals offered to a chooser; tables of a proposal; looks at trial layouts for a sheet.
MOST_CHOICES, MOST_TABLES, MOST_TRIALS = 3, 12, 20
Lens = Callable[..., DataFrame]
_LENSES: dict[str, Lens] = {}


def register(name: str, lens: Lens) -> None:
    """Make a lens known under a name; the last one of a name counts. A lens with a true attribute needs_runner is called with the runner as well."""
    _LENSES[name] = lens


def build_lenses(names: Sequence[str]) -> list[tuple[str, Lens]]:
    """The named lenses in order; KeyError for a name that nobody registered."""
    for name in names:
        if name not in _LENSES:
            raise KeyError(f"unknown lens {name!r} (known: {sorted(_LENSES)})")
    return [(name, _LENSES[name]) for name in names]


def _candidates(handles: DataFrame, orientation: str = "vertical", confidence: float = 1.0) -> DataFrame:
    j = F.row_number().over(Window.partitionBy("sheet").orderBy("min_row", "min_col")) - 1  # the few tables of one sheet
    return handles.select("sheet", j.alias("j"), F.lit(confidence).alias("confidence"), F.lit(orientation).alias("orientation"), *CANDIDATE_NAMES[4:])


def vertical(grid: DataFrame) -> DataFrame:
    """One upright table for each sheet."""
    return _candidates(D.detect_tables(grid))


def turned(grid: DataFrame) -> DataFrame:
    """One table for each sheet, headings down its first column."""
    found = D.detect_tables(transposed(grid.select("sheet", "row", "cells")).select("sheet", F.col("row").cast("int").alias("row"), "cells"))
    return _candidates(found.where("not ambiguous"), "transposed", 0.6)


def blocks(grid: DataFrame) -> DataFrame:
    """An upright table for each block of touching cells in which one can be found."""
    pieces = C.pieces(long_cells(grid).select("sheet", "row", "col"))
    boxes = durable(pieces.where("max_row > min_row").select("sheet", "min_row", "min_col", "max_row", "max_col", F.concat_ws("|", "sheet", "min_row", "min_col").alias("box")), "boxes")
    rows = grid.select("sheet", "row", "cells").join(boxes, "sheet").where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    part = rows.select(F.col("box").alias("sheet"), (F.col("row") - F.col("min_row") + 1).cast("int").alias("row"), F.expr("slice(cells, min_col, max_col - min_col + 1)").alias("cells"))
    found = D.detect_tables(part).where("not ambiguous").select(F.col("sheet").alias("box"), *(F.col(c).alias(f"_{c}") for c in ("header_row", "span", "min_row", "min_col", "max_row", "max_col")))
    moved = found.join(boxes, "box").select(
        "sheet", *((F.col(f"_{c}") + F.col(o) - 1).cast("int").alias(c) for c, o in (("header_row", "min_row"), ("min_row", "min_row"), ("min_col", "min_col"), ("max_row", "min_row"), ("max_col", "min_col"))),
        F.col("_span").alias("span"), F.lit(False).alias("ambiguous"), F.lit(None).cast("string").alias("reason"),
    )
    return _candidates(moved, "vertical", 0.8)


def proposed(grid: DataFrame, runner: P.Runner | None = None) -> DataFrame:
    """What a runner proposes for each sheet: at most MOST_TABLES tables of one orientation; malformed regions are left out, and a sheet of which the runner fails has none."""
    spark, rows = grid.sparkSession, []
    if runner is not None:
        for sheet in [r.sheet for r in grid.select("sheet").distinct().orderBy("sheet").collect()]:
            probe = SheetProbe(grid, sheet)
            try:
                answer = runner.run(layout_seed(probe.dimensions()), [*probe.tools(), trial_tool(grid, sheet)], schema=P.LAYOUT, system=LAYOUT_TASK)
            except Exception:  # whatever the helper does, the sheet keeps its other candidates
                continue
            rows += [(sheet, j, 0.7, *r[1:], False, None) for j, r in enumerate(proposal_rows(sheet, answer.get("tables", [])))]
    return spark.createDataFrame(rows, CANDIDATE)


proposed.needs_runner = True  # type: ignore[attr-defined]
for _name, _lens in (("vertical", vertical), ("transposed", turned), ("blocks", blocks), ("agentic", proposed)):
    register(_name, _lens)

LAYOUT_TASK = "Find every table of the sheet. Give each one's A1 region, header row, header span (1 unless the header has two rows) and orientation; all of one orientation. Titles, notes and charts belong to no table. Invent nothing."


def layout_seed(size: dict) -> str:
    return f"Sheet {size['sheet']!r} has about {size['n_rows']} rows and {size['n_cols']} columns. Look with dimensions, peek_rows and peek_region, try layouts with try_layout, and finalize the best one you tried."


def proposal_rows(sheet: str, tables: Sequence[dict]) -> list[tuple]:
    """(sheet, orientation, header_row, span, bounds) of the well-formed tables of a proposal, MOST_TABLES at most; of mixed ones the upright."""
    named = list(tables)[:MOST_TABLES]
    if len({t.get("orientation", "vertical") for t in named}) > 1:
        named = [t for t in named if t.get("orientation", "vertical") == "vertical"]
    out = []
    for t in named:
        try:
            r0, c0, r1, c1 = a1.parse_range(t["region"])
            head, span = int(t["header_row"]), int(t.get("header_span", 1))
        except (ValueError, KeyError, TypeError):
            continue
        if r0 <= head and span >= 1 and head + span <= r1:
            out.append((sheet, t.get("orientation", "vertical"), head, span, r0, c0, r1, c1))
    return out


def trial_tool(grid: DataFrame, sheet: str, most: int = MOST_TRIALS) -> P.Tool:
    """Score a layout without committing it; after so many looks it says that the budget is spent."""
    spent = {"n": 0}

    def call(arguments: dict) -> dict:
        spent["n"] += 1
        if spent["n"] > most:
            return {"ok": False, "error": "no trials left; finalize the best layout"}
        rows = proposal_rows(sheet, arguments.get("tables", []) or [])
        if not rows:
            return {"ok": False, "error": "no well-formed table"}
        tried = grid.sparkSession.createDataFrame([(*r[:1], j, 0.7, *r[1:], False, None) for j, r in enumerate(rows)], CANDIDATE)
        score = score_layouts(grid.where(F.col("sheet") == sheet), with_ids(tried.withColumn("method", F.lit("trial")))).first()
        return {"ok": True, "tables": len(rows), "coverage_cells": score.coverage, "errors": score.errors, "gaps": score.gaps}

    return P.Tool("try_layout", "Score a list of tables without committing it: cells covered, errors, gaps.", {"type": "object", "properties": {"tables": {"type": "array"}}, "required": ["tables"]}, call)


def with_ids(candidates: DataFrame) -> DataFrame:
    """Add cand (sheet and method) and table_id."""
    cand = F.concat_ws("|", "sheet", "method")
    return candidates.withColumn("cand", cand).withColumn("table_id", F.concat_ws("|", cand, "j"))


def score_layouts(grid: DataFrame, candidates: DataFrame) -> DataFrame:
    """sheet, cand, coverage (cells), total, errors, gaps of each proposal: its tables are read, looked at and passed through the gate like any others.

    candidates: with_ids. Transposed proposals are scored in the turned sheet.
    """
    chosen = durable(candidates, "scored")
    whole = T.view_of(grid.join(chosen.select("sheet").distinct(), "sheet", "left_semi"), chosen)
    # A copy of the sheet for each proposal, so that proposals do not see each other's regions.
    copies = durable(chosen.select("sheet", "orientation", "cand").distinct().join(whole, ["sheet", "orientation"]).select(F.col("cand").alias("sheet"), "row", "cells"), "copies")
    handles = chosen.withColumn("sheet", F.col("cand")).withColumn("orientation", F.lit("vertical")).select(*T.HANDLE_NAMES)
    cells = long_cells(copies).select("sheet", "row", "col")
    covered = C.coverage(cells, handles).select("sheet", "covered", "total")
    marked = handles.withColumnRenamed("table_id", "region_id")
    gaps = C.interior_gaps(cells, marked).join(marked.select("region_id", "sheet"), "region_id").groupBy("sheet").agg(F.sum(F.col("blank_rows") + F.col("blank_cols")).alias("gaps"))
    tables = T.read_tables(copies, handles)
    found = Q.table_findings(Q.filled(copies, handles), handles).union(tables.notes).union(G.run_gate(tables))
    errors = found.where("severity = 'error'").groupBy("sheet").agg(F.count("*").alias("errors"))
    scores = chosen.select("cand", F.col("sheet").alias("_sheet")).distinct().join(covered.withColumnRenamed("sheet", "cand"), "cand", "left").join(errors.withColumnRenamed("sheet", "cand"), "cand", "left").join(gaps.withColumnRenamed("sheet", "cand"), "cand", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return durable(scores.select(F.col("_sheet").alias("sheet"), "cand", zero("covered").alias("coverage"), zero("total"), zero("errors"), zero("gaps")), "scores")


def signatures(candidates: DataFrame) -> DataFrame:
    """cand, sheet, method, pos, confidence and signature (orientation, regions, headers) of each proposal."""
    place = F.concat_ws(":", "header_row", "span", "min_row", "min_col", "max_row", "max_col")
    return candidates.groupBy("cand", "sheet", "method", "pos", "confidence").agg(F.concat_ws(";", F.min("orientation"), F.array_join(F.sort_array(F.collect_list(place)), ",")).alias("signature"))


@dataclass(frozen=True)
class Analysis:
    """handles: the winners' tables (CANDIDATE and method); sheets: sheet, method, contested, baseline (cand, or null if the winner is it); baselines: tables of the baselines of contested sheets; findings."""

    handles: DataFrame
    sheets: DataFrame
    baselines: DataFrame
    findings: DataFrame


Chooser = Callable[[str, list[dict]], int]


def assess(grid: DataFrame, candidates: DataFrame, chooser: Chooser | None = None) -> Analysis:
    """Pick one proposal for each sheet.

    Equal proposals are one, the most confident. A sheet with one left takes it unscored. Else they are ranked by coverage, errors, gaps and confidence; if the first is
    not worse than the second in any of the three, it wins. Otherwise the sheet is contested: the chooser, if there is one, picks among the first MOST_CHOICES, and a winner that covers less or
    errs more than the vertical proposal gives way to it. A chooser that fails, or picks none of them, changes nothing and leaves a finding.
    candidates: CANDIDATE, method, pos (place of the lens).
    """
    spark = grid.sparkSession
    all_ = durable(with_ids(candidates), "candidates")
    signed = durable(signatures(all_), "signed")
    one = Window.partitionBy("sheet", "signature").orderBy(F.desc("confidence"), F.asc("pos"))  # the proposals of one sheet
    kept = durable(signed.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"), "kept")
    basis = signed.where(F.col("method") == BASELINE).select("sheet", "signature").join(kept, ["sheet", "signature"]).select("sheet", F.col("cand").alias("baseline"))
    many = kept.groupBy("sheet").agg(F.count("*").alias("n"), F.first("cand").alias("only"))
    alone = many.where("n = 1").select("sheet", F.col("only").alias("winner"))
    rival = many.where("n > 1").select("sheet")
    made, contested = [], {}
    if not rival.isEmpty():
        open_ = all_.join(kept.select("cand"), "cand", "left_semi").join(rival, "sheet", "left_semi")
        scored = kept.join(score_layouts(grid, open_).drop("sheet"), "cand")
        ranked = durable(L.rank_candidates(scored), "ranked")
        first = L.dominated(ranked)
        best = ranked.where("rank = 1").join(first.select("sheet", "dominant"), "sheet")
        alone = alone.union(best.where("dominant").select("sheet", F.col("cand").alias("winner")))
        # Contested sheets go to the driver, as a chooser is a call from there: MOST_CHOICES proposals of each, and the baseline.
        few = ranked.join(best.where("not dominant").select("sheet"), "sheet", "left_semi").join(basis, "sheet", "left").where((F.col("rank") <= MOST_CHOICES) | (F.col("cand") == F.col("baseline")))
        regions = all_.groupBy("cand").agg(F.min("orientation").alias("orientation"), F.sort_array(F.collect_list(F.concat(Q.region_of(), F.lit(" header "), F.col("header_row").cast("string")))).alias("tables"))
        for r in few.join(regions, "cand").orderBy("sheet", "rank").collect():
            contested.setdefault(r.sheet, []).append(r)
        picked = []
        for sheet, rows in contested.items():
            top = [r for r in rows if r["rank"] <= MOST_CHOICES]
            winner = top[0]
            if chooser is not None:
                try:
                    at = int(chooser(sheet, [{k: r[k] for k in ("method", "orientation", "tables", "coverage", "errors", "gaps", "confidence")} for r in top]))
                    if 0 <= at < len(top):
                        winner = top[at]
                        if at:
                            made.append((sheet, "arbiter-choice", "info", f"{winner.method} chosen over {top[0].method}"))
                    else:
                        made.append((sheet, "arbiter-error", "warning", f"choice {at} is out of range; kept {top[0].method}"))
                except Exception as e:  # a helper's trouble is no trouble of the sheet
                    made.append((sheet, "arbiter-error", "warning", f"the chooser failed ({e}); kept {top[0].method}"))
            base = next((r for r in rows if r.cand == r.baseline), None)
            if base is not None and winner.cand != base.cand and not (winner.coverage >= base.coverage and winner.errors <= base.errors):
                made.append((sheet, "assessor-floor", "info", f"{winner.method} is worse than {BASELINE} (coverage {winner.coverage} and {base.coverage}, errors {winner.errors} and {base.errors}); kept {BASELINE}"))
                winner = base
            picked.append((sheet, winner.cand))
        alone = alone.union(spark.createDataFrame(picked, "sheet string, winner string"))
    fights = spark.createDataFrame([(s,) for s in contested], "sheet string").withColumn("contested", F.lit(True))
    sheets = alone.join(fights, "sheet", "left").join(basis, "sheet", "left").join(kept.select(F.col("cand").alias("winner"), "method"), "winner")
    sheets = durable(sheets.select("sheet", "method", F.coalesce("contested", F.lit(False)).alias("contested"), "winner", "baseline"), "assessed")
    handles = all_.join(sheets.select(F.col("winner").alias("cand")), "cand", "left_semi").select(*CANDIDATE_NAMES, "method")
    other = sheets.where("contested and baseline <> winner").select(F.col("baseline").alias("cand"))
    rows = spark.createDataFrame([(s, c, v, m) for s, c, v, m in made], "sheet string, category string, severity string, message string")
    found = rows.select(
        F.lit(None).cast("string").alias("table_id"), "sheet", "category", "severity", F.lit("sheet").alias("scope"), "message",
        F.when(F.col("category").startswith("arbiter"), "agent").otherwise("static").alias("source"), Q.at(F.lit("A1")).alias("ref"), F.lit(None).cast("string").alias("agent_action"), F.lit("open").alias("resolution"),
    )
    return Analysis(durable(handles, "winners"), sheets, durable(all_.join(other, "cand", "left_semi").select(*CANDIDATE_NAMES, "method"), "baselines"), found)


def analyse(grid: DataFrame, lenses: Sequence[str] = (BASELINE,), runner: P.Runner | None = None, chooser: Chooser | None = None) -> Analysis:
    """Run the lenses on every sheet and assess their proposals. A lens that fails is a finding of every sheet; a sheet without any proposal gets an ambiguous stub."""
    spark, made, notes = grid.sparkSession, None, []
    for pos, (name, lens) in enumerate(build_lenses(lenses)):
        try:
            found = lens(grid, runner) if getattr(lens, "needs_runner", False) else lens(grid)
            found = durable(found.select(*CANDIDATE_NAMES).withColumn("method", F.lit(name)).withColumn("pos", F.lit(pos)), "lens")
        except Exception as e:
            notes.append((name, str(e).split("\n")[0]))
            continue
        made = found if made is None else made.unionByName(found)
    names = grid.select("sheet").distinct()
    stub = names.select("sheet", F.lit(0).alias("j"), F.lit(0.0).alias("confidence"), F.lit("vertical").alias("orientation"), *(F.lit(1).alias(c) for c in CANDIDATE_NAMES[4:10]), F.lit(True).alias("ambiguous"), F.lit("no lens gave a proposal").alias("reason"), F.lit("fallback").alias("method"), F.lit(len(lenses)).alias("pos"))
    candidates = stub if made is None else made.unionByName(stub.join(made.select("sheet").distinct(), "sheet", "left_anti"))
    out = assess(grid, candidates, chooser)
    extra = Q.none(spark)
    for name, error in notes:
        extra = extra.union(Q.finding(names, "analyzer-error", "warning", "sheet", F.lit(f"lens {name} failed: {error}"), Q.at(F.lit("A1")), table=False))
    return Analysis(out.handles, out.sheets, out.baselines, extra.union(out.findings))


def choosing_runner(grid: DataFrame, runner: P.Runner) -> Chooser:
    """A chooser that asks a runner, which may look at the sheet, for the number of one of the listed proposals."""

    def choose(sheet: str, proposals: list[dict]) -> int:
        seed = [f"Sheet {sheet!r}: which of these {len(proposals)} layouts fits the cells best? Regions of a transposed layout are in coordinates of the turned sheet."]
        seed += [f"[{i}] {P.as_json(p)}" for i, p in enumerate(proposals)]
        return runner.run("\n".join(seed), SheetProbe(grid, sheet).tools(), schema=P.VERDICT, system="Pick one of the listed layouts by its number; never a new one.")["choice"]

    return choose
