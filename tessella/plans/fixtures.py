"""Fixtures: declared tables rendered to grids with their labels, samples for an evaluation, formula grids that are computed natively, and a ledger of any size.

Small things are Python data (a fixture is as large as its declaration); the ledger is a DataFrame from spark.range, and its summaries are aggregates of it.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions.formula import plain_function
from tessella.operators.grid import grid_from_lists

MOST_CELLS = 500


@dataclass(frozen=True)
class Col:
    label: str
    dtype: str = "number"
    unit: str | None = None
    group: str | None = None


@dataclass(frozen=True)
class TableSpec:
    """A table to be written at an anchor (row, column): title, grouped headings, a row of units, totals; numbers as text with thousands marks, footnotes, or negatives in parentheses."""

    table_id: str
    name: str
    sheet: str
    anchor: tuple[int, int]
    key: str
    columns: tuple[Col, ...]
    data: Mapping[str, Sequence]
    title: str | None = None
    units_in_header: bool = False
    units_row: bool = False
    totals_row: str | None = None
    totals_col: str | None = None
    footnotes: frozenset[tuple[str, str]] = frozenset()
    thousands: bool = False
    parens: bool = False


def literal(value, thousands: bool, parens: bool, footnote: bool):
    """What is written for a value: numbers as text where marks, parentheses or a footnote are asked for."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    if parens and value < 0:
        return f"({abs(value):,})" if thousands else f"({abs(value):g})"
    if thousands or footnote:
        return (f"{value:,}" if thousands else f"{value:g}") + (" (a)" if footnote else "")
    return value


def with_totals(spec: TableSpec) -> tuple[list[Col], dict[str, list]]:
    """Columns and rows with the totals that the table asks for; text columns have no total."""
    cols, rows = list(spec.columns), {k: list(v) for k, v in spec.data.items()}
    number = [i for i, c in enumerate(cols) if c.dtype == "number"]
    if spec.totals_col:
        cols.append(Col(spec.totals_col))
        rows = {k: [*v, sum(v[i] for i in number)] for k, v in rows.items()}
        number.append(len(cols) - 1)
    if spec.totals_row:
        rows[spec.totals_row] = [sum(v[i] for v in rows.values()) if i in number else None for i in range(len(cols))]
    return cols, rows


def render(spec: TableSpec) -> tuple[dict[tuple[int, int], object], dict]:
    """Cells by (row, column), and the table's label: regions, columns, row keys and facts."""
    r, c0 = spec.anchor
    cols, rows = with_totals(spec)
    cells: dict[tuple[int, int], object] = {}
    last = c0 + len(cols)
    if spec.title:
        cells[r, c0] = spec.title
        r += 1
    top, grouped = r, any(c.group for c in cols)
    cells[r, c0] = spec.key
    if grouped:
        for i, c in enumerate(cols, 1):
            if c.group and (i == 1 or cols[i - 2].group != c.group):
                cells[r, c0 + i] = c.group
        r += 1
    for i, c in enumerate(cols, 1):
        cells[r, c0 + i] = f"{c.label} ({c.unit})" if spec.units_in_header and c.unit else c.label
    bottom = r
    if spec.units_row:
        r += 1
        cells.update({(r, c0 + i): c.unit for i, c in enumerate(cols, 1) if c.unit})
    first, facts, keys = r + 1, [], []
    for key, values in rows.items():
        r += 1
        cells[r, c0] = key
        keys.append({"label": key, "row_index": r})
        for i, (c, v) in enumerate(zip(cols, values, strict=True), 1):
            if v is not None:
                raw = literal(v, spec.thousands, spec.parens, (key, c.label) in spec.footnotes)
                cells[r, c0 + i] = raw
                facts.append({"row_label": key, "col_label": c.label, "cell_ref": a1.column_letters(c0 + i) + str(r), "value": v, "raw": raw, "is_formula": False})
    columns = [{"label": c.label, "col_index": c0 + i, "col_letter": a1.column_letters(c0 + i), "dtype": c.dtype, "unit": c.unit} for i, c in enumerate(cols, 1)]
    region = a1.range_text(spec.anchor[0], c0, r, last)
    return cells, {
        "table_id": spec.table_id, "name": spec.name, "sheet": spec.sheet, "region": region, "header_region": a1.range_text(top, c0, bottom, last), "data_region": a1.range_text(first, c0, r, last),
        "orientation": "vertical", "columns": columns, "row_keys": keys, "cells": facts, "traps": [], "is_duplicate_of": None,
    }


@dataclass(frozen=True)
class Measure:
    name: str
    table_id: str
    row: str
    col: str


@dataclass(frozen=True)
class FormulaSample:
    description: str
    expression: str
    operands: Mapping[str, str]


@dataclass(frozen=True)
class WorkbookSpec:
    """A workbook: its tables, the measures that phrases and formulas name, and formulas over them."""

    name: str
    tables: tuple[TableSpec, ...]
    difficulty: str = "easy"
    measures: tuple[Measure, ...] = ()
    formulas: tuple[FormulaSample, ...] = ()
    stray: Mapping[tuple[str, int, int], object] = field(default_factory=dict)


def lines(cells: Mapping[tuple[int, int], object]) -> list[list]:
    """Cells as rows, empty ones as None."""
    if not cells:
        return []
    width = max(c for _, c in cells)
    return [[cells.get((r, c)) for c in range(1, width + 1)] for r in range(1, max(r for r, _ in cells) + 1)]


def workbook(spec: WorkbookSpec, seed: int = 0) -> tuple[dict[str, list[list]], dict]:
    """Sheets as rows, and the label with its samples."""
    sheets: dict[str, dict[tuple[int, int], object]] = {}
    tables = []
    for t in spec.tables:
        cells, label = render(t)
        sheets.setdefault(t.sheet, {}).update(cells)
        tables.append(label)
    for (sheet, r, c), v in spec.stray.items():
        sheets.setdefault(sheet, {})[r, c] = v
    label = {"workbook": f"{spec.name}.xlsx", "rel_path": f"workbooks/{spec.name}.xlsx", "difficulty": spec.difficulty, "domain": "synthetic", "traps": [], "sheets": list(sheets), "business_logic": "", "tables": tables}
    label["measures"] = [_measure(tables, m) for m in spec.measures]
    label["samples"] = samples(label, spec.formulas, seed)
    return {name: lines(cells) for name, cells in sheets.items()}, label


def grid(spark: SparkSession, specs: Sequence[WorkbookSpec], seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """One grid of all workbooks, sheets named workbook|sheet, and their labels."""
    sheets, labels = {}, []
    for spec in specs:
        made, label = workbook(spec, seed)
        sheets |= {f"{label['workbook']}|{name}": rows for name, rows in made.items()}
        labels.append(label)
    return grid_from_lists(spark, sheets), labels


def _measure(tables: list[dict], m: Measure) -> dict:
    table = next(t for t in tables if t["table_id"] == m.table_id)
    fact = next(c for c in table["cells"] if (c["row_label"], c["col_label"]) == (m.row, m.col))
    unit = next(c["unit"] for c in table["columns"] if c["label"] == m.col)
    return {"semantic_name": m.name, "aliases": [], "table_id": m.table_id, "row_label": m.row, "col_label": m.col, "unit": unit, "value": fact["value"]}


def _order(seed: int, *parts: object) -> str:
    """A fixed shuffle: sort by this. It does not depend on the process."""
    return hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()


def samples(label: dict, formulas: Sequence[FormulaSample] = (), seed: int = 0, values: int = 14, texts: int = 2, least: int = 26) -> list[dict]:
    """Boundary, formula, extraction and phrase samples of a label; at least `least` in all, eight of them phrases."""
    name, out = label["workbook"], []
    for t in label["tables"]:
        out.append({"id": f"{name}:bnd:{t['table_id']}", "type": "boundary", "sheet": t["sheet"], "table_id": t["table_id"], "table_name": t["name"], "expected_region": t["region"], "min_iou": 0.999})
    by_name = {m["semantic_name"]: m for m in label.get("measures", [])}
    for i, f in enumerate(formulas):
        inputs = {s: float(by_name[m]["value"]) for s, m in f.operands.items()}
        out.append({"id": f"{name}:fml:{i}", "type": "formula", "description": f.description, "expression": f.expression, "operands": dict(f.operands), "inputs": inputs, "expected_value": plain_function(f.expression)(inputs), "tolerance": 1e-6})
    facts = sorted(((t, c) for t in label["tables"] for c in t["cells"]), key=lambda tc: _order(seed, name, tc[0]["table_id"], tc[1]["cell_ref"]))
    number = [tc for tc in facts if isinstance(tc[1]["value"], (int, float)) and not isinstance(tc[1]["value"], bool)]
    text = [tc for tc in facts if isinstance(tc[1]["value"], str)]
    for j, (t, c) in enumerate(number[:values] + text[:texts]):
        out.append({"id": f"{name}:ext:{j}", "type": "extraction", "sheet": t["sheet"], "table_id": t["table_id"], "table": t["name"], "row_label": c["row_label"], "col_label": c["col_label"], "expected_value": c["value"], "expected_cell_ref": c["cell_ref"], "dtype": "string" if isinstance(c["value"], str) else "number", "tolerance": 1e-9})
    where: dict[tuple, set] = {}
    for t, c in facts:
        where.setdefault((c["row_label"], c["col_label"]), set()).add(t["table_id"])
    asked: dict[str, tuple] = {}
    for j in range(max(8, least - len(out)) if number else 0):
        t, c = number[(j * 3 + 1) % len(number)]
        row, col = c["row_label"], c["col_label"]
        options = [f"What is the {col} for {row} in {t['name']}?", f"Look up {col} of {row} in the {t['name']} table."]
        if len(where[row, col]) == 1:
            options += [f"What is the {col} of {row}?", f"{row} {col}", f"Show {row}'s {col}."]
        query = options[int(_order(seed, name, j), 16) % len(options)]
        if asked.setdefault(query, (t["table_id"], row, col)) != (t["table_id"], row, col):
            query = f"{query} [{t['sheet']}/{t['table_id']}]"
            asked[query] = (t["table_id"], row, col)
        out.append({"id": f"{name}:sem:{j}", "type": "semantic", "query": query, "expected_value": c["value"], "expected_table_id": t["table_id"], "expected_row_label": row, "expected_col_label": col, "dtype": "number", "tolerance": 1e-9})
    return out


def pruned(cells: DataFrame, used: str, order: Column, most: int = MOST_CELLS, by: str | None = None) -> DataFrame:
    """Cells that are used, and others in an order until there are `most` in all, for each value of `by`. A limit is the feature: others are taken as a top-k."""
    if by is None:
        left = max(0, most - cells.where(used).count())
        return cells.where(used).unionByName(cells.where(~F.col(used)).orderBy(order).limit(left))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(used), order))  # the cells of one labelled table
    return cells.withColumn("_n", rank).where(F.col(used) | (F.col("_n") <= most)).drop("_n")


REFERENCE = re.compile(r"(?:(?P<sheet>'[^']+'|[A-Za-z_]\w*)!)?(?P<first>\$?[A-Z]{1,3}\$?[0-9]+)(?::(?P<last>\$?[A-Z]{1,3}\$?[0-9]+))?(?![A-Za-z0-9_(])")


class FormulaBook:
    """Sheets whose cells are values or formulas; formulas are computed on demand, over other cells, ranges, other sheets and named cells.

    Formulas: arithmetic, comparisons, IF, and SUM, SUMIF, AVERAGE, MIN, MAX, COUNT, ABS, ROUND. A cycle, or a function not listed, raises ValueError.
    """

    def __init__(self) -> None:
        self.cells: dict[tuple[str, int, int], object] = {}
        self.names: dict[str, tuple[str, int, int]] = {}
        self._done: dict[tuple[str, int, int], object] = {}
        self._open: set[tuple[str, int, int]] = set()

    def put(self, sheet: str, ref: str, value: object) -> str:
        """Set a cell, return its address for use in formulas of other sheets."""
        row, col = a1.parse_cell(ref)
        self.cells[sheet, row, col] = value
        self._done.clear()
        return f"'{sheet}'!{ref}"

    def name(self, name: str, sheet: str, ref: str) -> None:
        self.names[name] = (sheet, *a1.parse_cell(ref))

    def value(self, sheet: str, ref: str) -> object:
        return self._value((sheet, *a1.parse_cell(ref)))

    def _value(self, at: tuple[str, int, int]) -> object:
        if at in self._done:
            return self._done[at]
        held = self.cells.get(at)
        if isinstance(held, str) and held.startswith("="):
            if at in self._open:
                raise ValueError(f"cycle at {at}")
            self._open.add(at)
            try:
                held = self._compute(at[0], held[1:])
            finally:
                self._open.discard(at)
        self._done[at] = held
        return held

    def _compute(self, sheet: str, text: str) -> object:
        env: dict[str, object] = {}

        def bind(m: re.Match) -> str:
            of = (m["sheet"] or sheet).strip("'")
            symbol = f"_{len(env)}"
            if m["last"]:
                r0, c0, r1, c1 = a1.parse_range(f"{m['first']}:{m['last']}")
                env[symbol] = [self._value((of, r, c)) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
            else:
                env[symbol] = self._value((of, *a1.parse_cell(m["first"])))
            return symbol

        # Texts stay as they are; references between them become symbols.
        parts = re.split(r'("[^"]*")', text)
        made = "".join(p if p.startswith('"') else REFERENCE.sub(bind, p) for p in parts).replace("^", "**").replace("<>", "!=")
        tree = ast.parse(re.sub(r"(?<![<>!=])=(?!=)", "==", made), mode="eval")
        return self._run(tree.body, env)

    FUNCTIONS: Mapping[str, Callable] = {
        "SUM": lambda *a: sum(_numbers(a)), "AVERAGE": lambda *a: (lambda n: sum(n) / len(n))(_numbers(a)), "MIN": lambda *a: min(_numbers(a)), "MAX": lambda *a: max(_numbers(a)), "COUNT": lambda *a: len(_numbers(a)),
        "ABS": abs, "ROUND": lambda x, n=0: round(x, int(n)), "SUMIF": lambda keys, key, values: sum(v for k, v in zip(keys, values, strict=True) if k == key and isinstance(v, (int, float))),
    }

    def _run(self, node: ast.AST, env: dict) -> object:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id in env:
                return env[node.id]
            if node.id in self.names:
                return self._value(self.names[node.id])
            raise ValueError(f"unknown name {node.id}")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name = node.func.id.upper()
            if name == "IF":
                return self._run(node.args[1] if self._run(node.args[0], env) else node.args[2], env)
            if name not in self.FUNCTIONS:
                raise ValueError(f"unknown function {name}")
            return self.FUNCTIONS[name](*(self._run(a, env) for a in node.args))
        from tessella.functions.formula import PLAIN_OPS

        if isinstance(node, ast.BinOp) and type(node.op) in PLAIN_OPS:
            return PLAIN_OPS[type(node.op)](self._run(node.left, env) or 0, self._run(node.right, env) or 0)
        if isinstance(node, ast.UnaryOp) and type(node.op) in PLAIN_OPS:
            return PLAIN_OPS[type(node.op)](self._run(node.operand, env) or 0)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in PLAIN_OPS:
            return PLAIN_OPS[type(node.ops[0])](self._run(node.left, env), self._run(node.comparators[0], env))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    def sheets(self) -> tuple[dict[str, list[list]], dict[tuple[str, int, int], str]]:
        """Rows of values of each sheet, and the formulas: what grid_from_lists and the workbook writer take."""
        out: dict[str, dict[tuple[int, int], object]] = {}
        for (sheet, r, c), held in self.cells.items():
            out.setdefault(sheet, {})[r, c] = self._value((sheet, r, c))
        return {s: lines(cells) for s, cells in out.items()}, {at: v for at, v in self.cells.items() if isinstance(v, str) and v.startswith("=")}


def _numbers(values: Sequence) -> list:
    flat = [x for v in values for x in (v if isinstance(v, list) else [v])]
    return [x for x in flat if isinstance(x, (int, float)) and not isinstance(x, bool)]


REGIONS, CATEGORIES = ("North", "South", "East", "West", "Central"), ("Hardware", "Software", "Services", "Support")


def ledger(spark: SparkSession, rows: int = 100_000, seed: int = 7) -> DataFrame:
    """A ledger of any number of transactions, each the same in every run: keys, date, dimensions, and amounts that follow from each other."""
    i = F.col("id")
    draw = lambda tag, n: F.pmod(F.xxhash64(i, F.lit(f"{seed}{tag}")), F.lit(n))
    base = spark.range(rows).select(
        (i + 1).alias("n"), F.concat(F.lit("T"), F.lpad((i + 1).cast("string"), 9, "0")).alias("TxnID"), F.date_format(F.date_add(F.lit("2024-01-01"), (draw("day", 366)).cast("int")), "yyyy-MM-dd").alias("Date"),
        F.element_at(F.array(*map(F.lit, REGIONS)), (draw("region", len(REGIONS)) + 1).cast("int")).alias("Region"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (draw("category", len(CATEGORIES)) + 1).cast("int")).alias("Category"),
        (draw("units", 50) + 1).alias("Units"), (draw("price", 19_900) + 100).alias("_cents"), draw("discount", 30).alias("_percent"),
    )
    money = lambda c: F.round(c, 2)
    gross = base.withColumn("UnitPrice", F.col("_cents") / 100).withColumn("Gross", money(F.col("Units") * F.col("_cents") / 100))
    net = gross.withColumn("Discount", money(F.col("Gross") * F.col("_percent") / 100)).withColumn("NetRevenue", money(F.col("Gross") - F.col("Discount")))
    cost = net.withColumn("COGS", money(F.col("Gross") * 0.6)).withColumn("GrossProfit", money(F.col("NetRevenue") - F.col("COGS"))).withColumn("Tax", money(F.col("NetRevenue") * 0.08))
    return cost.drop("_cents", "_percent")


def ledger_totals(rows: DataFrame, dimension: str, measures: Sequence[str] = ("Units", "NetRevenue", "COGS", "GrossProfit", "Tax")) -> DataFrame:
    """One row for each region, category, or month, with the sums of the measures."""
    key = F.substring("Date", 1, 7) if dimension == "Month" else F.col(dimension)
    return rows.groupBy(key.alias(dimension)).agg(*(F.round(F.sum(m), 2).alias(m) for m in measures))


def build_summary(labels: Sequence[Mapping]) -> dict[str, dict[str, int]]:
    """For each workbook the number of samples of each kind, and of formula cells."""
    out = {}
    for label in labels:
        kinds: dict[str, int] = {}
        for s in label["samples"]:
            kinds[s["type"]] = kinds.get(s["type"], 0) + 1
        out[label["workbook"]] = kinds | {"formula_cells": sum(c["is_formula"] for t in label["tables"] for c in t["cells"])}
    return out


def examples() -> tuple[WorkbookSpec, ...]:
    """Workbooks of three tiers: plain, with titles, offsets, totals and stacked tables, and with grouped headings and numbers as text."""
    money = lambda *labels: tuple(Col(x, unit="USD") for x in labels)
    stores = {"Mon": (10, 120.5), "Tue": (12, 150.0), "Wed": (9, 99.0)}
    return (
        WorkbookSpec("teams", (TableSpec("teams", "Teams", "Teams", (1, 1), "Team", (Col("People"), *money("Budget")), {"Blue": (4, 900), "Green": (7, 1200), "Red": (3, 450)}),), measures=(Measure("blue_people", "teams", "Blue", "People"), Measure("red_people", "teams", "Red", "People")), formulas=(FormulaSample("both teams", "a + b", {"a": "blue_people", "b": "red_people"}),)),
        WorkbookSpec("plan", (TableSpec("plan", "Spending Plan", "Plan", (2, 2), "Project", (*money("Y1", "Y2"), Col("Owner", "string")), {"Roof": (100, 50, "Ann"), "Lift": (70, 80, "Bo")}, title="Spending Plan", totals_row="Total", totals_col="Sum"),), "medium"),
        WorkbookSpec("shops", tuple(TableSpec(f"shop{i}", f"Shop {i}", "Shops", (1 + 7 * (i - 1), 1), "Day", (Col("Visits"), *money("Sales")), {k: (v * i, s * i) for k, (v, s) in stores.items()}) for i in (1, 2)), "medium"),
        WorkbookSpec("regions", (TableSpec("regions", "Results", "Results", (1, 1), "Line", (Col("Plan A", group="East"), Col("Fact A", group="East"), Col("Plan B", group="West"), Col("Fact B", group="West")), {"Sales": (40, 42, 30, 31), "Costs": (20, 25, 14, 13)}, title="Results by region"),), "hard"),
        WorkbookSpec("notes", (TableSpec("notes", "Segments", "Segments", (1, 1), "Segment", money("Revenue", "Change"), {"Cloud": (124500, -3000), "Tools": (9800, 250)}, thousands=True, parens=True, footnotes=frozenset({("Cloud", "Revenue")})),), "hard"),
    )
