"""Mixing sources to target weights by hash-threshold histograms.

A source's target is a multiple of its size: whole copies of every document, and one more copy of the
documents whose hash lies below a threshold. The threshold is found from histograms of tokens by source and hash
bucket: cumulative sums find the bucket in which the budget ends, and only that bucket is split further, digit by digit.
No rows are sorted. A histogram has at most sources x BUCKETS rows at each level, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stash, unused

#: The hash has LEVELS digits of DIGIT_BITS bits.
DIGIT_BITS, LEVELS = 12, 5
BUCKETS = 1 << DIGIT_BITS
HASH_BITS = DIGIT_BITS * LEVELS
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0


def id_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text, so that SQL elsewhere can follow; rows without an id are told apart by their text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight, none above cap times its size; what the cap cuts off is shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ -= set(full)
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
    return targets


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, copies (whole copies of all) and rest (tokens of the extra copy). One row per source."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").cast("long").alias("n")).collect()
    # Code point order is the order of the UTF-8 bytes; null comes last.
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.n or 0) for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), cap)
    rows = []
    for r, n, t in zip(found, sizes, targets, strict=True):
        copies = min(int(t // n), int(cap)) if n else 0
        rows.append((r.source, n, float(t), copies, float(t - copies * n)))
    return spark.createDataFrame(rows, "source string, source_size long, target double, copies int, rest double")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source and bound: the documents of the source whose hash is below bound get the extra copy.

    The kept hashes are the longest prefix, in hash order, such that each kept hash has its middle token within rest.
    Each level sums tokens by digit within the one open bucket of each source.
    """
    spark = sized.sparkSession
    at = {r.source: (0, r.rest) for r in targets.where("source_size > 0 and rest > 0").collect()}
    open_ = set(at)
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        width = 1 << shift
        if not open_:
            break
        # One row per source at most.
        state = F.broadcast(spark.createDataFrame([(s, *at[s]) for s in open_], "source string, low long, left double"))
        rows = sized.where("size > 0").select(F.col("source").alias("_s"), "size", "h")
        inside = rows.join(state, rows["_s"].eqNullSafe(state["source"])).where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(width * BUCKETS)))
        digit = F.shiftright(F.col("h") - F.col("low"), shift).cast("int")
        counts = inside.groupBy("source", "low", "left", digit.alias("digit")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        # The first bucket that cannot be kept whole is opened; a bucket of one hash is kept by its middle token.
        kept = F.col("before") + (F.col("n") / 2 if not shift else F.col("n")) <= F.col("left")
        first = sums.groupBy("source").agg(F.min(F.when(~kept, F.struct("digit", "before"))).alias("first")).collect()
        for source, found in ((r["source"], r["first"]) for r in first):
            low, left = at[source]
            if found is None:
                at[source] = (low + width * BUCKETS, 0.0)
                open_.discard(source)
            else:
                at[source] = (low + found["digit"] * width, left - found["before"])
    return spark.createDataFrame([(s, low) for s, (low, _) in at.items()], "source string, bound long")


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_source, source_size, target, _copies (of every document) and _bound (below it one more): one row per source."""
    targets = source_targets(sized, weights, share, cap)
    bounds = thresholds(sized, targets)
    return targets.join(bounds, targets["source"].eqNullSafe(bounds["source"]), "left").select(
        targets["source"].alias("_source"), "source_size", "target", F.col("copies").alias("_copies"), F.coalesce("bound", F.lit(0)).alias("_bound")
    )


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add source_size, target and taken to rows that have source, size and h.

    taken is size times the copies that the mix takes, 0 up to cap. Null source is a source of its own, the last.
    Rows of one hash (repeated ids; equal texts without an id) are kept or left together. Columns of the three names are replaced. An empty table gives an empty result.
    """
    sized = sized.drop("source_size", "target", "taken")
    copies, bound, of = unused(sized, "_copies", "_bound", "_source")
    plan = mixing_plan(sized, weights, share, cap).select(F.col("_source").alias(of), "source_size", "target", F.col("_copies").alias(copies), F.col("_bound").alias(bound))
    # One row per source: its size does not grow with the documents.
    joined = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan[of]), "left")
    times = F.col(copies) + F.when(F.col("h") < F.col(bound), 1).otherwise(0)
    return joined.withColumn("taken", (F.col("size") * times).cast("long")).drop(of, copies, bound)


def mixed_documents(documents: DataFrame, size: Column) -> DataFrame:
    """The documents as often as the mix takes them: left out, once or more. Columns and rows are otherwise as they were.

    Each row is decided by its own id, or, without one, by its text, so repeated rows go together; texts without words and null texts have size 0, and as many
    copies as their hash gives. An empty table gives no rows.
    """
    plan = mixing_plan(sized_documents(documents, size)).drop("source_size", "target")
    of, copies, bound, times = unused(documents, "_source", "_copies", "_bound", "_times")
    plan = plan.select(F.col("_source").alias(of), F.col("_copies").alias(copies), F.col("_bound").alias(bound))
    joined = documents.join(F.broadcast(plan), documents["source"].eqNullSafe(plan[of]), "left")
    taken = F.col(copies) + F.when(id_hash(F.col("doc_id"), F.col("text")) < F.col(bound), 1).otherwise(0)
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(0), taken.cast("int")))).select(*(F.col(f"`{c}`") for c in documents.columns))


def sized_documents(documents: DataFrame, size: Column) -> DataFrame:
    """doc_id, source, size and hash, written once to the shared folder so that texts are read once."""
    return stash(documents.select("doc_id", "source", size.alias("size"), id_hash(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
