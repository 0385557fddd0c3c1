"""Choosing between layouts and repairs: ranking, dominance, acceptance rules, column patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.cells import text_number

DTYPES = ("number", "string", "boolean", "date")
ROLES = ("key", "value", "computed")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Per sheet: one candidate for each signature (the most confident, then the first), ranked by coverage, errors, gaps, confidence, place."""
    one = Window.partitionBy("sheet", "signature").orderBy(F.desc("confidence"), F.asc("pos"))
    order = Window.partitionBy("sheet").orderBy(F.desc("coverage"), F.asc("errors"), F.asc("gaps"), F.desc("confidence"), F.asc("pos"))
    return candidates.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").withColumn("rank", F.row_number().over(order))


def dominated(ranked: DataFrame) -> DataFrame:
    """Per sheet, whether the first candidate is no worse than the second in coverage, errors and gaps; alone counts as dominant."""
    second = ranked.where("rank = 2").select("sheet", *(F.col(c).alias(f"_{c}") for c in ("coverage", "errors", "gaps")))
    s = ranked.where("rank = 1").join(second, "sheet", "left")
    no_worse = (F.col("coverage") >= F.col("_coverage")) & (F.col("errors") <= F.col("_errors")) & (F.col("gaps") <= F.col("_gaps"))
    return s.select("sheet", "pos", F.coalesce(no_worse, F.lit(True)).alias("dominant"))


def accept_recut(new: str = "new_", old: str = "old_") -> Column:
    """Coverage strictly up; errors and gaps not up."""
    return (F.col(new + "coverage") > F.col(old + "coverage")) & (F.col(new + "errors") <= F.col(old + "errors")) & (F.col(new + "gaps") <= F.col(old + "gaps"))


def accept_repair(new: str = "new_", old: str = "old_") -> Column:
    """Fewer errors, or as many and a higher label score."""
    return (F.col(new + "errors") < F.col(old + "errors")) | ((F.col(new + "errors") == F.col(old + "errors")) & (F.col(new + "labels") > F.col(old + "labels")))


def best_repair(candidates: DataFrame) -> DataFrame:
    """Per table: the candidate with fewest errors, then most labels, then first."""
    w = Window.partitionBy("table_id").orderBy(F.asc("errors"), F.desc("labels"), F.asc("pos"))
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def label_like(text: Column) -> Column:
    """A heading rather than a value: not a number, commas aside, or a whole number that reads as a year."""
    number = text_number(F.regexp_replace(text, ",", ""))
    return number.isNull() | ((number == F.floor(number)) & number.between(1900, 2100))


def label_scores(columns: DataFrame) -> DataFrame:
    """table_id and labels: how many of a table's headings read as such."""
    return columns.groupBy("table_id").agg(F.count_if(label_like(F.col("name"))).alias("labels"))


def apply_patches(columns: DataFrame, patches: DataFrame) -> DataFrame:
    """Columns (name, dtype, role) with patched dtype and role; unknown names, and values outside the lists, change nothing."""
    p = patches.select("name", F.when(F.col("dtype").isin(*DTYPES), F.col("dtype")).alias("_dtype"), F.when(F.col("role").isin(*ROLES), F.col("role")).alias("_role"))
    return columns.join(p, "name", "left").select("name", F.coalesce("_dtype", "dtype").alias("dtype"), F.coalesce("_role", "role").alias("role"))


def role_disagreements(declared: DataFrame, found: DataFrame) -> DataFrame:
    return declared.join(found.withColumnRenamed("role", "found_role"), "name").where("role <> found_role").select("name", "role", "found_role")
