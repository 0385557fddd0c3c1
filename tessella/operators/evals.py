"""Scoring answers against labels: pass marks, measure precision and recall, score cards by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.cells import values_match


def score_samples(labels: DataFrame, answers: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Labels with `passed`: the answer is near the expected value; a missing answer fails."""
    joined = labels.join(answers.withColumnRenamed("value", "got"), "sample_id", "left")
    return joined.withColumn("passed", values_match(F.col("expected"), F.col("got"), tolerance))


def score_measures(labelled: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn over measures matched on keys and value; a detected measure that is there twice counts once, the other is a false positive."""
    d = detected.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("value")))
    both = labelled.withColumn("_n", F.lit(1)).withColumnRenamed("value", "want").join(d.withColumnRenamed("value", "have"), [*keys, "_n"], "full_outer")
    ok = values_match(F.col("want"), F.col("have"))
    return both.agg(F.count_if(ok).alias("tp"), F.count_if(F.col("have").isNotNull() & ~ok).alias("fp"), F.count_if(F.col("want").isNotNull() & ~ok).alias("fn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """precision and recall are 1 without cases, f1 is 0 where both are 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), (a + b).cast("double")), F.lit(1.0))
    out = counts.select("*", ratio(F.col("tp"), F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("fn")).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def score_card(scored: DataFrame, *sets: str) -> DataFrame:
    """Pass rate by each of the named columns and overall, in one pass by grouping sets."""
    rate = F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(1.0))  # a group without samples passes
    return scored.groupingSets([[F.col(s)] for s in sets] + [[]], *(F.col(s) for s in sets)).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), rate.alias("rate"))


def pass_rates(scored: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """grp (column:value, or all:), n, n_passed, rate. The listed values of a column are there even without samples, with a rate of 1."""
    spark = scored.sparkSession
    kinds = F.array(*(F.concat(F.lit(f"{c}:"), F.col(c)) for c in groups), F.lit("all:"))
    found = scored.select("passed", F.explode(kinds).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))
    named = spark.createDataFrame([(f"{c}:{v}",) for c, values in groups.items() for v in values] + [("all:",)], "grp string")
    every = named.join(found, "grp", "full_outer").fillna(0, ["n", "n_passed"])
    return every.where("grp is not null").select("grp", "n", "n_passed", F.coalesce(F.try_divide(F.col("n_passed").cast("double"), F.col("n").cast("double")), F.lit(1.0)).alias("rate"))
