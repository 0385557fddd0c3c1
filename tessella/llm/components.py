"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (u, v); null ends and loops are left out, repeats allowed.

    Each round is joins and aggregates by node, cut off in the shared folder; a node with many neighbours is met by minimum
    aggregates, which combine before the shuffle, and by joins, which Spark splits. The number of rounds is logarithmic.
    """
    # Every edge points from the larger node to the smaller.
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, now = now, stash(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", before[0])
        after = _state(now)
        discard(last)
        if after == before:
            break
        before = after
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v"), F.col("v")).distinct())
