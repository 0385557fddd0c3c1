"""The catalog of what can be asked: tables, their queryable columns and row keys, and no values; and answers by phrase on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.cells import cell_number
from tessella.functions.formula import compile_expression
from tessella.operators import resolve as R
from tessella.plans import ports as P

#: Row keys listed of a table; keys of a table up to which its cells are measures.
MOST_KEYS = 60
MEASURE_KEYS = 40


def queryable_columns(columns: DataFrame, places: DataFrame) -> DataFrame:
    """table_id, name, ord of the headings that a phrase can mean: all but keys, or all where a table has nothing else."""
    named = places.join(columns.groupBy("table_id", "name").agg(F.max_by("role", "pos").alias("role")), ["table_id", "name"], "left")
    other = F.coalesce(F.col("role") != "key", F.lit(True))
    some = named.groupBy("table_id").agg(F.bool_or(other).alias("_some"))
    return named.join(some, "table_id").where(other | ~F.col("_some")).select("table_id", "name", "ord")


def catalog_frames(extraction) -> tuple[DataFrame, DataFrame]:
    """Columns and rows of the tables without errors, as the resolver takes them: table_id, tpos, cpos, column_name; table_id, tpos, rpos, row_key."""
    from tessella.operators.grid import with_row_number

    good = extraction.indices()
    place = with_row_number(good.handles.select("table_id"), ["table_id"], "tpos", 0)
    cols = queryable_columns(good.tables.columns, good.tables.places).join(place, "table_id").select("table_id", "tpos", F.col("ord").alias("cpos"), F.col("name").alias("column_name"))
    rows = good.tables.index.where("row_key is not null").join(place, "table_id").select("table_id", "tpos", F.col("first").alias("rpos"), "row_key")
    return cols, rows


def capped_keys(rows: DataFrame, by: str = "table_id", order: str = "rpos", key: str = "row_key", most: int = MOST_KEYS) -> DataFrame:
    """row_keys (the first of each table, in order) and whether there are more; the place of a key is found without sorting a table in one task."""
    from tessella.operators.grid import with_row_number

    numbered = with_row_number(rows.select(by, order, key), [by, order], "_i", 0)
    low = numbered.groupBy(by).agg(F.min("_i").alias("_low"), F.count("*").alias("_n"))
    first = numbered.join(low, by).where(F.col("_i") - F.col("_low") < most)
    listed = first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]).alias("row_keys"), F.first("_n").alias("_n"))
    return listed.select(by, "row_keys", (F.col("_n") > most).alias("row_keys_truncated"))


def catalog(columns: DataFrame, rows: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """table_id, columns, row_keys, row_keys_truncated: one entry for each table, with the first of its row keys."""
    named = columns.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cpos", "column_name"))), lambda x: x["column_name"]).alias("columns"))
    return named.join(capped_keys(rows, most=most), "table_id", "left").select("table_id", "columns", F.coalesce("row_keys", F.array().cast("array<string>")).alias("row_keys"), F.coalesce("row_keys_truncated", F.lit(False)).alias("row_keys_truncated"))


RESOLVE_TASK = "Which table, row and column does the phrase mean? Take table_id, row_label and col_label as they stand in the catalog; found is false if nothing fits."


def resolve_by_client(phrases: DataFrame, entries: DataFrame, client: P.Client) -> DataFrame:
    """pid, table_id, row_key, column_name of the phrases that a client resolves to names of the catalog; other answers, and failures, resolve nothing.

    The client is called from the driver, once for each phrase, with the capped catalog.
    """
    spark = phrases.sparkSession
    shown = [r.asDict(recursive=True) for r in entries.orderBy("table_id").collect()]
    known = {e["table_id"]: (set(e["columns"]), set(e["row_keys"])) for e in shown}
    out = []
    for r in phrases.orderBy("pid").collect():
        try:
            got = client.complete(RESOLVE_TASK, f"Catalog: {P.as_json(shown)}\nPhrase: {r.phrase}", schema=P.COORDINATE)
        except Exception:  # the deterministic resolver has its turn
            continue
        columns, keys = known.get(got.get("table_id"), (set(), set()))
        if got["found"] and got.get("col_label") in columns and got.get("row_label") in keys:
            out.append((r.pid, got["table_id"], got["row_label"], got["col_label"]))
    return spark.createDataFrame(out, f"pid {phrases.schema['pid'].dataType.simpleString()}, table_id string, row_key string, column_name string")


def resolve_phrases(phrases: DataFrame, columns: DataFrame, rows: DataFrame, client: P.Client | None = None, cache: R.IndexCache | None = None) -> DataFrame:
    """Coordinates by the client first, where there is one, and by exact matching for the rest."""
    index = (cache or R.IndexCache()).get(columns, rows)
    if client is None:
        return R.resolve(phrases, index=index)
    said = resolve_by_client(phrases, catalog(columns, rows), client)
    return said.union(R.resolve(phrases.join(said.select("pid"), "pid", "left_anti"), index=index))


def cell_values(extraction) -> DataFrame:
    """table_id, row_key, column_name, cell: what the tables' keys lead to, the last row of each key."""
    t = extraction.tables
    return t.index.select("table_id", "row_key", "row").join(t.cells, ["table_id", "row"]).join(t.places.select("table_id", "col", F.col("name").alias("column_name")), ["table_id", "col"]).select("table_id", "row_key", "column_name", "cell")


def answer_phrases(phrases: DataFrame, extraction, client: P.Client | None = None, cache: R.IndexCache | None = None) -> DataFrame:
    """pid, cell and where it was found; nulls where a phrase resolves to nothing."""
    columns, rows = catalog_frames(extraction)
    found = resolve_phrases(phrases, columns, rows, client, cache).join(cell_values(extraction), ["table_id", "row_key", "column_name"], "left")
    return phrases.select("pid").join(found, "pid", "left").select("pid", "cell", "table_id", "row_key", "column_name")


def small_tables(keys: DataFrame, most: int = MEASURE_KEYS, by: str = "table_id", key: str = "row_key") -> DataFrame:
    """The tables with few enough keys to be summaries."""
    return keys.groupBy(by).agg(F.countDistinct(key).alias("_n")).where(F.col("_n") <= most).select(by)


def measures(extraction, most: int = MEASURE_KEYS) -> DataFrame:
    """table_id, row_key, column_name, value: numbers of value and computed columns of small tables without errors."""
    good = extraction.indices()
    t = good.tables
    numeric = t.columns.where("role in ('value', 'computed') and dtype = 'number'").select("table_id", F.col("name").alias("column_name"))
    every = cell_values(good).join(small_tables(t.index, most, key="key"), "table_id", "left_semi").join(numeric, ["table_id", "column_name"], "left_semi")
    return every.select("table_id", "row_key", "column_name", cell_number(F.col("cell")).alias("value"), "cell").where("cell is not null").drop("cell")


def formulas_by_phrase(asked: DataFrame, values: DataFrame, expressions: dict[str, str], by: str = "formula") -> DataFrame:
    """The value of each named expression whose operands are phrases; null if an operand has no number.

    asked: pid, formula, name (of the operand), phrase; values: pid, value. expressions: formula -> text over operand names, compiled once.
    """
    found = asked.join(values, "pid", "left")
    bound = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("double").alias("value")))).alias("_of"))

    def value_of(text: str) -> Column:
        import ast

        names = {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)}
        return compile_expression(text, {n: F.try_element_at("_of", F.lit(n)) for n in names})

    out = F.lit(None).cast("double")
    for name, text in expressions.items():
        out = F.when(F.col(by) == name, value_of(text)).otherwise(out)
    return bound.select(by, out.alias("value"))
