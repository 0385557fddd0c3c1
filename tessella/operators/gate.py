"""The quality gate: each check is a query whose rows are findings; nothing short-circuits and nothing raises on bad data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFF_TYPE_SHARE = 0.2
MIN_SAMPLES = 5


def dtype_conformance(values: DataFrame, fits: Column, by: str = "column_name", share: float = OFF_TYPE_SHARE, least: int = MIN_SAMPLES) -> DataFrame:
    """column, total, bad of the columns in which more than a share of the non-empty values does not fit; few values never fail."""
    sums = values.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~fits).alias("bad"))
    return sums.where((F.col("total") >= least) & (F.col("bad") / F.col("total") > share))


def duplicate_names(names: DataFrame) -> DataFrame:
    """Declared names that occur more than once, with the number of surplus declarations."""
    return names.groupBy("name").agg((F.count("*") - 1).alias("surplus")).where("surplus > 0")


def header_differences(declared: DataFrame, live: DataFrame) -> DataFrame:
    """name, check: declared names that the live header lacks, live names that nobody declared, and names in another place."""
    missing = declared.join(live, "name", "left_anti").select("name", F.lit("column-name").alias("check"))
    extra = live.join(declared, "name", "left_anti").select("name", F.lit("column-coverage").alias("check"))
    moved = declared.join(live.withColumnRenamed("col", "_live"), "name").where("col <> _live").select("name", F.lit("column-integrity").alias("check"))
    return missing.unionByName(extra).unionByName(moved)


def row_integrity(index: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed keys whose live cell has another key, or is gone: key, row, live_key. index: key, row; live: row, live_key."""
    return index.join(live, "row", "left").where(~F.col("key").eqNullSafe(F.col("live_key"))).select("key", "row", "live_key")


def round_trip(expected: DataFrame, got: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells (row_key, column_name) whose queried value differs from the live one beyond a relative tolerance."""
    both = expected.withColumnRenamed("value", "want").join(got.withColumnRenamed("value", "have"), ["row_key", "column_name"], "left")
    near = F.coalesce(F.abs(F.col("want") - F.col("have")) <= F.lit(tolerance) * F.greatest(F.abs("want"), F.lit(1.0)), F.col("want").eqNullSafe(F.col("have")))
    return both.where(~near)


def computed_mismatch(table: DataFrame, target: str, formula: Column, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stored value differs from the formula, or whose formula cannot be evaluated (null): adds `want` and `failed`."""
    want = formula
    ok = F.abs(F.col(target) - want) <= F.lit(tolerance) * F.greatest(F.abs(want), F.lit(1.0))
    return table.withColumn("want", want).withColumn("failed", want.isNull()).where(~F.coalesce(ok, F.lit(False)))


def band_conflicts(bands: DataFrame) -> DataFrame:
    """band, name, problem against band 0: extra-column or dtype-mismatch. A column that a later band lacks is no conflict."""
    first = bands.where("band = 0").select("name", F.col("dtype").alias("_dtype"))
    later = bands.where("band > 0").join(first, "name", "left")
    problem = F.when(F.col("_dtype").isNull(), "extra-column").when(F.col("_dtype") != F.col("dtype"), "dtype-mismatch")
    return later.select("band", "name", problem.alias("problem")).where("problem is not null")


def first_kept(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Duplicates by key removed, the first in order kept."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


#: Keys looked at in a table of more rows; all keys of smaller ones. Keys of which the sampled cells are read back.
SAMPLE_KEYS = 300
ROUND_TRIP_KEYS = 5
#: Rows of a table whose keys a task puts in order together.
PART = 1024


def sampled_keys(index: DataFrame, size: int = SAMPLE_KEYS, full: int = SAMPLE_KEYS) -> DataFrame:
    """table_id, sheet, key, row_key, row, place (from 0) of the keys that a stride over each table's keys, in order of first sight, takes."""
    # Keys are counted by parts of PART rows; only parts that the stride meets are put in order, so that neither a task nor a shuffle holds a large table's keys.
    from tessella.operators.durable import durable
    from tessella.operators.grid import stride_hit

    part = F.floor(F.col("first") / PART).alias("_part")
    counts = durable(index.groupBy("table_id", part).agg(F.count("*").alias("_m")), "parts")
    upto = Window.partitionBy("table_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = counts.withColumn("_low", F.sum("_m").over(upto) - F.col("_m")).join(counts.groupBy("table_id").agg(F.sum("_m").alias("_n")), "table_id")
    step = (F.col("_n") - 1) / F.lit(float(max(size - 1, 1)))
    stride = lambda place: F.coalesce(F.floor(F.try_divide(place, step)), F.lit(0).cast("bigint"))
    near = F.sequence(stride(F.col("_low")) - 1, stride(F.col("_low") + F.col("_m")) + 1)
    met = F.exists(near, lambda k: (k >= 0) & (k <= max(size - 1, 1)) & F.bround(k * (F.col("_n") - 1).cast("double") / F.lit(float(max(size - 1, 1))), 0).between(F.col("_low"), F.col("_low") + F.col("_m") - 1))
    met = durable(parts.where((F.col("_n") <= max(size, full)) | met).select("table_id", "_part", "_low", "_n"), "met")
    keys = index.select("table_id", "sheet", "key", "row_key", "row", "first", part).join(met, ["table_id", "_part"])
    placed = keys.withColumn("place", F.col("_low") + F.row_number().over(Window.partitionBy("table_id", "_part").orderBy("first")) - 1)
    return placed.where(stride_hit(F.col("place"), F.col("_n"), size, full)).select("table_id", "sheet", "key", "row_key", "row", "place")


def run_gate(tables, live: DataFrame | None = None, size: int = SAMPLE_KEYS, full: int = SAMPLE_KEYS) -> DataFrame:
    """Every check of the gate on every table at once, as findings; a table passes if it has none.

    tables: what was extracted (plans.tables.Tables). live: the cells as they are now (table_id, row, col, cell), by default those extracted.
    The checks: coverage gap, row-key collision, blank row key, empty index, dtype-mismatch, column-name, column-coverage, column-integrity, row-integrity, round-trip, computed.
    """
    from tessella.functions import cells as K
    from tessella.functions import text as X
    from tessella.functions.a1 import letters_column
    from tessella.operators import findings as Q
    from tessella.operators import index as I
    from tessella.operators.durable import durable

    live = tables.cells if live is None else live
    # A table that was not read (ambiguous, conflicting bands, a key without a name) has its error already.
    stubs = tables.notes.where("severity = 'error'").select("table_id").distinct()
    heads = durable(tables.handles.where("not ambiguous").join(stubs, "table_id", "left_anti"), "gated")
    mine = lambda f: f.join(heads.select("table_id"), "table_id", "left_semi")
    columns, places, index = mine(tables.columns).join(heads.select("table_id", "sheet"), "table_id"), mine(tables.places), mine(tables.index)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shown = F.coalesce("row_key", F.lit("(empty)"))
    made = []

    def fail(frame: DataFrame, message: Column, ref: Column | None = None) -> None:
        made.append(Q.finding(frame, X.category(message), "error", "table", message, ref, "gate"))

    fail(columns.join(places, ["table_id", "name"], "left_anti"), say("coverage gap: column ", F.col("name"), " is declared and cannot be resolved"))
    rows = mine(tables.rows)
    repeated = durable(index.where("n > 1").select("table_id", "sheet", "key", "row_key"), "repeated")
    pairs = I.collisions(rows, ["table_id", "key"], several=repeated.select("table_id", "key")).join(repeated, ["table_id", "key"])
    fail(pairs, say("row-key collision: key ", shown, " at row ", F.col("shadowed_row"), " is shadowed by row ", F.col("winning_row")))
    fail(rows.where("blank"), say("blank row key: data row ", F.col("row"), " has an empty key cell"))
    fail(heads.join(index.select("table_id").distinct(), "table_id", "left_anti"), F.lit("empty index: no row key was resolved"))

    sample = durable(sampled_keys(index, size, full), "sampled")
    # The cells that the checks look at, those of the sampled rows and of the header, are picked in one pass.
    picked = sample.select("table_id", "row").union(heads.where("span > 0").select("table_id", F.explode(F.sequence("header_row", F.col("header_row") + F.col("span") - 1)).alias("row")))
    picked = durable(picked.distinct(), "picked")
    asked = tables.cells
    same_cells = live is asked
    live = durable(live.join(picked, ["table_id", "row"], "left_semi"), "live")
    asked = live if same_cells else durable(asked.join(picked, ["table_id", "row"], "left_semi"), "asked")
    seen = durable(sample.join(places, "table_id").join(live, ["table_id", "row", "col"], "left"), "seen")  # a row for each sampled key and column, empty cells too
    full_cell = ~K.empty(F.col("cell"))
    keys = columns.where("role = 'key'").groupBy("table_id").agg(F.min_by("name", "pos").alias("_key"))
    typed = seen.where(full_cell).join(columns.where("dtype <> 'string'").select("table_id", "name", "dtype"), ["table_id", "name"]).join(keys, "table_id", "left").where(~F.col("name").eqNullSafe(F.col("_key")))
    off = typed.groupBy("table_id", "sheet", "name", "dtype").agg(F.count("*").alias("total"), F.count_if(~K.conforms(F.col("cell"), F.col("dtype"))).alias("bad"))
    off = off.where((F.col("total") >= MIN_SAMPLES) & (F.col("bad") / F.col("total") > OFF_TYPE_SHARE))
    fail(off, say("dtype-mismatch: column ", F.col("name"), " declared ", F.col("dtype"), " but ", F.col("bad"), " of ", F.col("total"), " sampled cells are not"))

    # The header as it is now.
    header = heads.join(live, "table_id").where((F.col("row") >= F.col("header_row")) & (F.col("row") < F.col("header_row") + F.col("span")))
    now = header.groupBy("table_id", "sheet", "col").agg(F.max_by(F.coalesce(F.col("cell.str"), K.cell_text(F.col("cell"))), "row").alias("name"))
    now = durable(now.groupBy("table_id", "sheet", "name").agg(F.max("col").alias("live_col")), "header")
    twice = columns.groupBy("table_id", "sheet", "name").agg((F.count("*") - 1).cast("int").alias("surplus")).where("surplus > 0")
    fail(twice.withColumn("_i", F.explode(F.sequence(F.lit(1), "surplus"))), say("column-name: ", F.col("name"), " is declared twice"))
    fail(columns.join(now.select("table_id", "name"), ["table_id", "name"], "left_anti"), say("column-name: ", F.col("name"), " is declared and not in the live header"))
    fail(now.join(columns.select("table_id", "name"), ["table_id", "name"], "left_anti"), say("column-coverage: live header ", F.col("name"), " is not declared"))
    moved = places.join(now.drop("sheet"), ["table_id", "name"], "left").join(heads.select("table_id", "sheet"), "table_id")
    fail(moved.where("live_col is null"), say("column-integrity: ", F.col("name"), " is indexed and not in the live header"))
    fail(moved.where("live_col <> col"), say("column-integrity: ", F.col("name"), " is indexed in column ", letters_column(F.col("col")), " but the live header has it in ", letters_column(F.col("live_col"))))

    key_cells = seen.join(keys.withColumnRenamed("_key", "name"), ["table_id", "name"])
    fail(key_cells.where(~K.canonical_key(F.col("cell")).eqNullSafe(F.col("key"))), say("row-integrity: key ", shown, " points to row ", F.col("row"), " but the live cell has ", F.coalesce(K.cell_text(F.col("cell")), F.lit("(empty)"))))

    few = seen.where(F.col("place").isNotNull()).join(_first_places(sample), ["table_id", "place"], "left_semi")
    both = few.join(asked.withColumnRenamed("cell", "asked"), ["table_id", "row", "col"], "left").join(columns.select("table_id", "name", "dtype"), ["table_id", "name"], "left")
    as_text = lambda c: F.trim(K.cell_text(F.col(c)))
    near = (F.col("dtype") == "number") & K.values_match(K.cell_number(F.col("cell")), K.cell_number(F.col("asked")))
    same = (K.empty(F.col("cell")) & K.empty(F.col("asked"))) | F.coalesce(as_text("cell") == as_text("asked"), F.lit(False)) | F.coalesce(near, F.lit(False))
    fail(both.where(~same), say("round-trip: ", F.col("name"), " of ", shown, " is ", F.coalesce(as_text("cell"), F.lit("(empty)")), " but the query gives ", F.coalesce(as_text("asked"), F.lit("(empty)"))))

    wrong = computed_failures(mine(tables.formulas), columns, seen)
    fail(wrong, F.col("message"))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def _first_places(sample: DataFrame) -> DataFrame:
    """table_id and place of the first ROUND_TRIP_KEYS sampled keys; a sample is bounded, so its order is too."""
    w = Window.partitionBy("table_id").orderBy("place")
    return sample.select("table_id", "place", F.row_number().over(w).alias("_n")).where(F.col("_n") <= ROUND_TRIP_KEYS).drop("_n")


def computed_failures(formulas: DataFrame, columns: DataFrame, seen: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """table_id, sheet, message of the sampled cells of computed columns that their formula does not give, or that it cannot be evaluated for.

    Tables have formulas of their own, so rows are evaluated in Arrow batches, each distinct expression compiled once in a worker.
    """
    import pyarrow as pa

    from tessella.functions import cells as K
    from tessella.functions.formula import plain_function

    last = formulas.where("expression is not null").groupBy("table_id", "target").agg(F.max_by(F.struct("expression", "operands"), "row").alias("f"))
    of = last.join(columns.where("role = 'computed'").select("table_id", F.col("name").alias("target")), ["table_id", "target"], "left_semi").select("table_id", "target", "f.expression", "f.operands")
    value = F.struct(K.cell_number(F.col("cell")).alias("number"), K.cell_text(F.col("cell")).alias("text"), F.col("cell.kind").alias("kind"))
    asked = of.select("table_id", "target", "expression", F.explode(F.array_distinct(F.concat("operands", F.array("target")))).alias("name"))
    read = asked.join(seen.select("table_id", "sheet", "row", "row_key", "name", "cell"), ["table_id", "name"])
    rows = read.groupBy("table_id", "sheet", "target", "expression", "row").agg(F.first("row_key").alias("row_key"), F.map_from_entries(F.collect_list(F.struct("name", value.alias("v")))).alias("of"))

    def run(batches):
        kind = pa.schema([("table_id", pa.string()), ("sheet", pa.string()), ("message", pa.string())])
        for batch in batches:
            out = []
            for table_id, sheet, target, expression, _row, key, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                env = {n: (v["number"] if v["kind"] in ("int", "num") else v["text"]) for n, v in given}
                stored = dict(given).get(target, {}).get("number")
                try:
                    got = float(plain_function(expression)(env))
                except Exception as e:  # whatever the data make of it
                    out.append((table_id, sheet, f"computed eval failed {target}@{key}: {e}"))
                    continue
                if stored is None or not abs(stored - got) <= tolerance * max(abs(stored), 1.0):
                    out.append((table_id, sheet, f"computed mismatch {target}@{key}: live={stored} calc={got}"))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(kind.names)}, schema=kind)

    return rows.select("table_id", "sheet", "target", "expression", "row", "row_key", "of").mapInArrow(run, "table_id string, sheet string, message string")


def gate_report(findings: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, passed, failures (messages in order) of every table."""
    failed = findings.where("severity = 'error'").groupBy("table_id").agg(F.sort_array(F.collect_list("message")).alias("failures"))
    return tables.select("table_id").join(failed, "table_id", "left").select("table_id", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))
