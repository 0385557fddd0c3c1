"""Key index of a table and lookups in batches: last row wins, duplicates and blanks are reported, unknown names are told apart."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.a1 import cell_text
from tessella.operators.grid import with_row_number


def key_map(rows: DataFrame, key: str | Column, row: str = "row") -> DataFrame:
    """key, last (the row that wins) and first (its place in the order of keys). Combines before the shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(k.alias("key")).agg(F.max(row).alias("last"), F.min(row).alias("first"))


def collisions(rows: DataFrame, key: str | Sequence[str], row: str = "row", several: DataFrame | None = None) -> DataFrame:
    """key, shadowed_row, winning_row of each neighbouring pair of rows with one key (several columns are one key).

    several: the keys that occur more than once, if they are known. Only their rows are ordered; neighbours meet by a join on their number in that order, so that no task holds all rows of a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    named = rows.select(*(F.col(k).alias("key") if isinstance(key, str) else F.col(k) for k in keys), F.col(row).alias("_row"))
    names = ["key"] if isinstance(key, str) else keys
    if several is None:
        several = named.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = lambda a, b: functools.reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))
    repeated = named.join(several, same(named, several), "left_semi")
    ordered = with_row_number(repeated, [*names, "_row"], "_i")
    before = ordered.select((F.col("_i") + 1).alias("_i"), *(F.col(n).alias(f"_{n}") for n in names), F.col("_row").alias("shadowed_row"))
    both = ordered.join(before, "_i").where(functools.reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names)))
    return both.select(*names, "shadowed_row", F.col("_row").alias("winning_row"))


def blank_keys(rows: DataFrame, keys: Sequence[str], row: str = "row") -> DataFrame:
    """Rows of which every part of the key is null or the empty text."""
    blank = F.lit(True)
    for k in keys:
        blank = blank & F.coalesce(F.col(k).cast("string") == "", F.lit(True))
    return rows.where(blank).select(row)


def lookup(table: DataFrame, key: str, requests: DataFrame, columns: Sequence[str], row: str = "row") -> DataFrame:
    """Answer (row_key, column_name) requests: the requests' columns, value (as text), cell_ref, status.

    status is ok, unknown-column or unknown-row, in this order of checks. Requests meet the winning rows by a join on the key,
    of which the request side is usually the small one; Spark picks the strategy from their sizes.
    """
    places = {c: i for i, c in enumerate(table.columns, 1) if c != row}
    wins = table.join(key_map(table, key, row).select(F.col("last").alias(row)), row, "left_semi")
    values = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
    at = F.create_map(*(x for c in columns for x in (F.lit(c), F.lit(places[c]))))
    side = wins.select(F.col(key).alias("_key"), F.col(row).alias("_row"), values.alias("_values"))
    joined = requests.join(side, requests["row_key"].eqNullSafe(side["_key"]), "left")
    known = F.col("column_name").isin(list(columns))
    status = F.when(~F.coalesce(known, F.lit(False)), "unknown-column").when(F.col("_row").isNull(), "unknown-row").otherwise("ok")
    ok = status == "ok"
    return joined.select(
        *(requests[c] for c in requests.columns), F.when(ok, F.try_element_at("_values", "column_name")).alias("value"), F.when(ok, cell_text(F.col("_row"), F.try_element_at(at, "column_name"))).alias("cell_ref"), status.alias("status")
    )


def read_all(table: DataFrame, key: str, columns: Sequence[str], max_keys: int | None = None, row: str = "row") -> DataFrame:
    """row_key, column_name, value (text), cell_ref of every key, the winning row's values; max_keys counts keys in order of first sight."""
    wins = table.join(key_map(table, key, row).select(F.col("last").alias(row), F.col("first").alias("_first")), row)
    if max_keys is not None:
        # A limit on keys is the feature: the smallest first rows, as a top-k and not a full sort.
        kept = wins.select("_first").orderBy("_first").limit(max_keys)
        wins = wins.join(kept, "_first", "left_semi")
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), cell_text(F.col(row), F.lit(i)).alias("cell_ref")) for i, c in enumerate(columns, 1)))
    return wins.select(F.col(key).alias("row_key"), F.inline(cells))


def positional(table: DataFrame, rows: DataFrame, row: str = "row") -> DataFrame:
    """Rows by their 1-based position among data rows, for tables without a key."""
    return table.join(rows.select((F.col("position") + 1).alias(row), "position"), row)


def register(table: DataFrame, name: str) -> None:
    """The table as a temporary view, so that SQL can use it."""
    table.createOrReplaceTempView(name)
