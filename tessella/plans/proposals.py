"""Outside proposals, always verified: a re-cut or repair is taken only if the gate says that it is better.

A proposer is any callable; none is bound to a provider. The runners of plans.ports are turned into proposers here; the scripted one serves tests.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions.cells import cell_text
from tessella.operators import coverage as C
from tessella.operators import findings as Q
from tessella.operators import gate as G
from tessella.operators import layout as L
from tessella.operators.durable import durable
from tessella.operators.grid import long_cells
from tessella.operators.probes import BandProbe, SheetProbe
from tessella.plans import ensemble as N
from tessella.plans import ports as P
from tessella.plans import tables as T

MOST_TABLES = 12
MOST_PASSES = 3
PREVIEW_ROWS = 30
#: Rows of a band up to which a helper is asked about it.
MOST_BAND_ROWS = 40
#: A table that a proposer names: header row, span, and the four bounds.
Table = tuple[int, int, int, int, int, int]
Proposer = Callable[[str, list[list[str | None]]], Sequence[Table]]
#: Given a table, its columns and its failures: a patch (see ports.TABLE_PATCH).
Repairer = Callable[[Row, list[Row], list[str], list[str]], dict]
DECLARED = "table_id string, pos int, name string, dtype string, unit string, role string"
LOG = "table_id string, pass int, errors_before array<string>, errors_after array<string>, accepted boolean, failure_categories map<string,int>, patch_summary string"


@dataclass
class Scripted:
    """Answers from a script, one after the other, and remembers what it was asked."""

    answers: dict[str, list[Sequence[Table]]]
    asked: list[str] = field(default_factory=list)

    def __call__(self, sheet: str, preview: list[list[str | None]]) -> Sequence[Table]:
        self.asked.append(sheet)
        left = self.answers.get(sheet, [])
        return left.pop(0) if left else []


def preview(grid: DataFrame, sheet: str, rows: int = PREVIEW_ROWS) -> list[list[str | None]]:
    """The first rows of a sheet as text; bounded by the number of rows."""
    lines = grid.where((F.col("sheet") == sheet) & (F.col("row") <= rows)).select("row", F.transform("cells", cell_text).alias("c")).orderBy("row").collect()
    return [list(r.c) for r in lines]


def proposing_runner(grid: DataFrame, runner: P.Runner) -> Proposer:
    """A proposer of re-cuts that asks a runner, which may look at the whole sheet."""

    def propose(sheet: str, _preview: list[list[str | None]]) -> Sequence[Table]:
        seed = f"Sheet {sheet!r} was cut into one table, but a block outside it looks like another. List every upright table of the sheet, or none if the cut is right."
        answer = runner.run(seed, SheetProbe(grid, sheet).tools(), schema=P.LAYOUT, system=N.LAYOUT_TASK)
        return [r[2:] for r in N.proposal_rows(sheet, answer.get("tables", [])) if r[1] == "vertical"]

    return propose


def score_layout(grid: DataFrame, handles: DataFrame) -> DataFrame:
    """sheet, coverage (cells), total, errors, gaps of one layout for each sheet, read and gated like any other."""
    numbered = T.ranked(handles.withColumn("_place", F.col("min_row") * 100_000 + F.col("min_col")), "sheet", "_place", "j").drop("_place")
    marked = numbered.withColumn("method", F.lit("now")).withColumn("orientation", F.lit("vertical")).withColumn("reason", F.col("reason") if "reason" in handles.columns else F.lit(None).cast("string"))
    return N.score_layouts(grid, N.with_ids(marked)).drop("cand")


def recut(grid: DataFrame, handles: DataFrame, propose: Proposer, most_tables: int = MOST_TABLES) -> tuple[DataFrame, DataFrame]:
    """Handles after proposals, and annotated sheet findings.

    Only sheets with loose blocks are shown to the proposer, once. More tables than most_tables, or none that is well-formed, is a rejection; no table at all declines. A
    proposal is accepted if it covers strictly more cells and has neither more errors nor more gaps. Findings are fixed where
    the accepted tables hold all cells of their block, open where they do not, rejected where the proposal was. A proposer that fails changes nothing.
    """
    spark = grid.sparkSession
    now = durable(handles, "handles")
    found = durable(Q.sheet_findings(grid, now), "loose")
    rows, said = [], {}
    for sheet in [r.sheet for r in found.select("sheet").distinct().orderBy("sheet").collect()]:
        try:
            tables = list(propose(sheet, preview(grid, sheet)))
        except Exception:  # whatever the helper does, the deterministic cut stands
            continue
        good = [(sheet, h, s, r0, c0, r1, c1, False, None) for h, s, r0, c0, r1, c1 in tables if 1 <= r0 <= h and h + s <= r1 and 1 <= c0 <= c1 and s >= 1]
        said[sheet] = "the helper looked at the sheet and proposed no re-cut" if not tables else "the re-cut is not strictly better; kept the boundaries"
        if 0 < len(good) <= most_tables:
            rows += good
    better: dict[str, str] = {}
    names = [c for c in ("sheet", "header_row", "span", "min_row", "min_col", "max_row", "max_col", "ambiguous", "reason")]
    proposed = spark.createDataFrame(rows, "sheet string, header_row int, span int, min_row int, min_col int, max_row int, max_col int, ambiguous boolean, reason string")
    if rows:
        tried = grid.join(proposed.select("sheet").distinct(), "sheet", "left_semi")
        old = score_layout(tried, now.join(proposed.select("sheet").distinct(), "sheet", "left_semi"))
        pair = old.select("sheet", *(F.col(c).alias(f"old_{c}") for c in ("coverage", "errors", "gaps"))).join(score_layout(tried, proposed).select("sheet", *(F.col(c).alias(f"new_{c}") for c in ("coverage", "errors", "gaps"))), "sheet")
        for r in pair.where(L.accept_recut()).collect():
            better[r.sheet] = f"re-cut: coverage {r.old_coverage} to {r.new_coverage}, errors {r.old_errors} to {r.new_errors}, gaps {r.old_gaps} to {r.new_gaps}"
    won = spark.createDataFrame(list(better.items()), "sheet string, action string")
    now = durable(now.select(*names).join(won.select("sheet"), "sheet", "left_anti").unionByName(proposed.join(won.select("sheet"), "sheet", "left_semi")), "handles")
    left = Q.sheet_findings(grid, now)
    asked = spark.createDataFrame([(s, a, "rejected" if a.startswith("the re-cut") else "open") for s, a in said.items() if s not in better], "sheet string, action string, state string")
    kept = found.join(won.select("sheet"), "sheet", "left_anti").join(asked, "sheet", "left").withColumn("agent_action", F.col("action")).withColumn("resolution", F.coalesce("state", "resolution")).select(*Q.NAMES)
    fixed = found.join(won, "sheet").join(left.select("sheet", "ref"), ["sheet", "ref"], "left_anti").withColumn("agent_action", F.col("action")).withColumn("resolution", F.lit("fixed")).select(*Q.NAMES)
    return now, durable(kept.union(fixed).union(left.join(won.select("sheet"), "sheet", "left_semi").select(*Q.NAMES)), "annotated")


def resolve_messy(grid: DataFrame, handles: DataFrame, client: P.Client) -> tuple[DataFrame, DataFrame]:
    """Ambiguous handles once more, by a client that sees the first rows: a confident answer with header row, region and columns makes a table of it. Also its declared columns."""
    spark, rows, columns, notes = grid.sparkSession, [], [], {}
    for r in handles.where("ambiguous").orderBy("table_id").collect():
        try:
            answer = client.complete("Find the one clean table of a messy tab: header row, A1 region, columns. Not confident if you cannot.", f"Sheet {r.sheet!r}, first rows: {P.as_json(preview(grid, r.sheet))}", schema=P.MESSY_TAB)
            if not answer["confident"]:
                notes[r.table_id] = "the helper is not confident"
                continue
            r0, c0, r1, c1 = a1.parse_range(answer["region"])
        except Exception as e:  # fails loud at the boundary, and the tab stays ambiguous
            notes[r.table_id] = f"the helper failed: {e}"
            continue
        rows.append((r.table_id, r.sheet, r.orientation, answer["header_row"], 1, r0, c0, r1, c1, False, "resolved by a helper"))
        columns += [(r.table_id, i, c["name"], c.get("dtype") if c.get("dtype") in L.DTYPES else "string", None, "key" if i == 0 else "value") for i, c in enumerate(answer["columns"])]
    done = spark.createDataFrame(rows, T.HANDLE)
    said = spark.createDataFrame(list(notes.items()), "table_id string, said string")
    rest = handles.join(done.select("table_id"), "table_id", "left_anti").join(said, "table_id", "left").withColumn("reason", F.coalesce("said", "reason")).select(*T.HANDLE_NAMES)
    return durable(rest.union(T.region_handles(done).select(*T.HANDLE_NAMES)), "handles"), spark.createDataFrame(columns, DECLARED)


def escalated(tables: T.Tables, findings: DataFrame, most_rows: int = MOST_BAND_ROWS, validate: bool = False) -> DataFrame:
    """table_id and band of the bands that a helper should look at: short ones, with an anomaly or with a role that reading and handle disagree on, or all short ones if validate."""
    sizes = tables.handles.select("table_id", (F.col("max_row") - F.col("header_row") - F.col("span") + 1).alias("n"))
    bands = tables.bands.join(sizes, "table_id").select("table_id", "band", F.when(F.col("axis") == "row", F.col("high") - F.col("low") + 1).otherwise(F.col("n")).alias("rows")).where(F.col("rows") <= most_rows)
    if validate:
        return bands.select("table_id", "band")
    trouble = findings.where("category in ('anomaly', 'messy-tab')").select("table_id").union(tables.handles.where("ambiguous").select("table_id")).distinct()
    return bands.join(trouble, "table_id", "left_semi").select("table_id", "band")


def band_digest(tables: T.Tables, table_id: str, findings: DataFrame) -> str:
    """What a helper is told about a table's bands: place, columns as read, notes. One table's columns, so the driver may hold it."""
    h = tables.handles.where(F.col("table_id") == table_id).first()
    columns = [r.asDict() for r in tables.columns.where(F.col("table_id") == table_id).orderBy("pos").select("name", "dtype", "role", "unit").collect()]
    notes = [r.message for r in findings.where((F.col("table_id") == table_id) & (F.col("category") == "anomaly")).collect()]
    place = {"sheet": h.sheet, "region": a1.range_text(h.min_row, h.min_col, h.max_row, h.max_col), "header_row": h.header_row, "header_span": h.span}
    return "\n".join(["Check these columns against the cells and give only corrections.", P.as_json(place), "Columns: " + P.as_json(columns), *(["Notes: " + P.as_json(notes)] if notes else [])])


def verify_header(columns: list[dict], client: P.Client) -> tuple[list[dict], list[str]]:
    """Units and roles that a client adds to columns, matched by name; a client that fails leaves them as they are, with a note."""
    try:
        answer = client.complete("Check the headings of a table; add missing units and roles. Invent no values.", P.as_json(columns), schema=P.HEADER_CHECK)
    except Exception as e:
        return columns, [f"header check skipped: {e}"]
    by_name = {c["name"]: c for c in answer.get("columns", [])}
    out = []
    for c in columns:
        p = by_name.get(c["name"], {})
        out.append(c | ({"unit": p["unit"]} if p.get("unit") is not None else {}) | ({"role": p["role"]} if p.get("role") in L.ROLES else {}))
    return out, []


def repair_seed(table: Row, columns: list[Row], failures: list[str], tried: list[str]) -> str:
    region = a1.range_text(table.min_row, table.min_col, table.max_row, table.max_col)
    lines = [
        f"Table {table.table_id} at {table.sheet}!{region}, header row {table.header_row}, span {table.span}.", "Columns: " + P.as_json([c.asDict() for c in columns]),
        "Correct wrong dtype, unit or role in column_patches; if the header itself is wrong, give header_row, header_span and all columns. Nothing, if all is well.",
    ]
    return "\n".join(lines + (["Failures: " + P.as_json(failures)] if failures else []) + (["Tried already: " + P.as_json(tried)] if tried else []))


def repairing_runner(grid: DataFrame, runner: P.Runner) -> Repairer:
    """A repairer that asks a runner, which may look at the table."""

    def repair(table: Row, columns: list[Row], failures: list[str], tried: list[str]) -> dict:
        probe = BandProbe(grid, table.sheet, table.header_row, table.header_row + table.span, table.max_row, table.min_col, table.max_col)
        return runner.run(repair_seed(table, columns, failures, tried), probe.tools(), schema=P.TABLE_PATCH)

    return repair


def patch_summary(patch: dict) -> str:
    parts = [f"columns:{len(patch['column_patches'])}"] if patch.get("column_patches") else []
    if patch.get("header_row") is not None or patch.get("header_span") is not None:
        parts.append(f"header(row={patch.get('header_row')},span={patch.get('header_span')},columns={len(patch.get('columns') or [])})")
    return ",".join(parts) or "empty"


def _repair_candidates(table: Row, columns: list[Row], patch: dict) -> list[tuple[int, int, list[tuple]]]:
    """(header row, span, columns) of the tables that a patch stands for: a new header in several spans, or the same one with corrected columns."""
    if patch.get("header_row") is not None or patch.get("header_span") is not None:
        named = patch.get("columns") or []
        new = [(c["name"], c.get("dtype") if c.get("dtype") in L.DTYPES else "string", c.get("unit"), c.get("role") if c.get("role") in L.ROLES else "value") for c in named]
        head = patch.get("header_row") or table.header_row
        spans = dict.fromkeys(s for s in (patch.get("header_span"), 1, table.span) if s and s >= 1 and head + s <= table.max_row)
        return [(head, s, new) for s in spans] if new and head >= table.min_row else []
    by_name = {c["name"]: c for c in patch.get("column_patches") or []}
    old = [(c.name, c.dtype, c.unit, c.role) for c in columns]
    new = []
    for name, dtype, unit, role in old:
        p = by_name.get(name, {})
        new.append((name, p["dtype"] if p.get("dtype") in L.DTYPES else dtype, p["unit"] if p.get("unit") is not None else unit, p["role"] if p.get("role") in L.ROLES else role))
    return [(table.header_row, table.span, new)] if new != old else []


def repair(grid: DataFrame, tables: T.Tables, errors: DataFrame, repairer: Repairer, passes: int = MOST_PASSES, validate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Handles and declared columns after repairs, and the log of passes.

    errors: table_id and failures (messages) of each table. Tables with errors, or all if validate, are shown to the repairer, at most `passes` times each, until they have none or no proposal helps.
    All proposals of a pass are read and gated together; a table takes the best one if it has fewer errors, or as many and more headings that read as such.
    The repairer is called from the driver, once for each table and pass; it sees columns and failures of that table only.
    """
    spark = grid.sparkSession
    handles = {r.table_id: r for r in tables.handles.where("not ambiguous").join(errors.where(F.lit(validate) | (F.size("failures") > 0)), "table_id", "left_semi").collect()}
    wanted = spark.createDataFrame([(t,) for t in handles], "table_id string")
    columns: dict[str, list[Row]] = {t: [] for t in handles}
    for r in tables.columns.join(wanted, "table_id", "left_semi").orderBy("table_id", "pos").select("table_id", "name", "dtype", "unit", "role").collect():
        columns[r.table_id].append(Row(name=r["name"], dtype=r.dtype, unit=r.unit, role=r.role))
    failures = {r.table_id: list(r.failures) for r in errors.join(wanted, "table_id", "left_semi").collect()}
    tried: dict[str, list[str]] = {t: [] for t in handles}
    open_, log, changed = set(handles), [], set()
    for turn in range(passes):
        trial, declared, of = [], [], {}
        patches: dict[str, dict] = {}
        for t in sorted(open_):
            try:
                patches[t] = P.enforce(repairer(handles[t], columns[t], failures[t], tried[t]), P.TABLE_PATCH)
            except Exception:  # whatever the helper does, the table stands
                open_.discard(t)
                continue
            for k, (head, span, cols) in enumerate(_repair_candidates(handles[t], columns[t], patches[t])):
                cand, h = f"{t}~{k}", handles[t]
                of[cand] = (t, k, h, head, span, cols)
                trial.append((cand, h.sheet, h.orientation, head, span, h.min_row, h.min_col, h.max_row, h.max_col, False, h.reason))
                declared += [(cand, i, *c) for i, c in enumerate(cols)]
        best: dict[str, tuple] = {}
        if trial:
            made = T.read_tables(grid, spark.createDataFrame(trial, T.HANDLE), spark.createDataFrame(declared, DECLARED))
            found = made.notes.union(G.run_gate(made))
            got = G.gate_report(found, made.handles)
            for r in got.collect():
                t, k, h, head, span, cols = of[r.table_id]
                score = sum(label(c[0]) for c in cols)
                before = (len(failures[t]), -sum(label(c.name) for c in columns[t]))
                if (len(r.failures), -score) < before and (t not in best or (len(r.failures), -score, k) < best[t][0]):
                    best[t] = ((len(r.failures), -score, k), head, span, cols, list(r.failures))
        for t in sorted(patches):
            accepted = t in best
            after = best[t][4] if accepted else failures[t]
            log.append((t, turn, failures[t], after, accepted, categories(failures[t]), patch_summary(patches[t])))
            if not accepted:
                open_.discard(t)
                continue
            _, head, span, cols, left = best[t]
            handles[t] = Row(**(handles[t].asDict() | {"header_row": head, "span": span}))
            columns[t] = [Row(name=n, dtype=d, unit=u, role=r) for n, d, u, r in cols]
            failures[t] = left
            tried[t].append(patch_summary(patches[t]))
            changed.add(t)
            if not left:
                open_.discard(t)
        if not open_:
            break
    new = spark.createDataFrame([tuple(handles[t][c] for c in T.HANDLE_NAMES) for t in sorted(changed)], T.HANDLE)
    kept = tables.handles.join(new.select("table_id"), "table_id", "left_anti").unionByName(new)
    named = spark.createDataFrame([(t, i, *(c[n] for n in ("name", "dtype", "unit", "role"))) for t in sorted(changed) for i, c in enumerate(columns[t])], DECLARED)
    return durable(kept, "handles"), named, spark.createDataFrame(log, LOG)


def label(name: str) -> bool:
    """A heading rather than a value: not a number, or a whole number that reads as a year."""
    try:
        number = float(str(name).replace(",", "").strip())
    except ValueError:
        return True
    return 1900 <= number <= 2100 and number.is_integer()


def categories(messages: Sequence[str]) -> dict[str, int]:
    """How many failures there are of each category."""
    from tessella.functions.text import CATEGORIES

    out: dict[str, int] = {}
    for m in messages:
        name = next((c for p, c in CATEGORIES if m.startswith(p)), "other")
        out[name] = out.get(name, 0) + 1
    return out


def covered_blocks(grid: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Of blocks (block, sheet, bounds) those of which all filled cells, one at least, lie in the regions of their sheet."""
    cells = long_cells(grid).select("sheet", "row", "col")
    b = blocks.select("block", F.col("sheet").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ("min_row", "min_col", "max_row", "max_col")))
    inside = (F.col("sheet") == F.col("_s")) & F.col("row").between(F.col("_min_row"), F.col("_max_row")) & F.col("col").between(F.col("_min_col"), F.col("_max_col"))
    own = cells.join(b, inside).select("block", "sheet", "row", "col")
    loose = C.uncovered(own, regions)
    return own.select("block").distinct().join(loose.select("block"), "block", "left_anti")
