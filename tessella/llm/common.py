"""Helpers that several operators share: tables, shared storage, ordered buckets, text batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D, and nothing else.
WORD_GAP = r"[\x20\x09-\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a side of a join is broadcast after it has been counted.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; Spark's reader alone touches the path."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "tessella-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tessella"


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Rows of a table of a few columns that one file of an intermediate table holds at least.
FILE_ROWS = 200_000


def stash(frame: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read again. A lost executor costs no earlier stage.

    rows: about how many rows there are, where that is known; few rows are then written by few tasks.
    """
    spark, path = frame.sparkSession, fresh_dir(frame.sparkSession, kind)
    if rows is not None:
        frame = frame.coalesce(rows // FILE_ROWS + 1)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of stashed frames that nothing will read again. What is gone already is passed over.

    The exchanges of the jobs that wrote them are no longer needed either; Spark removes an exchange's files once its plan has been collected as garbage.
    """
    for frame in frames:
        spark, shared = frame.sparkSession, shared_dir(frame.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if shared.split("://")[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def release() -> None:
    """Give back to the system what a worker process no longer uses; called at the end of a task, as the process lives on for others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def sized_broadcast(frame: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted rows are few; else Spark picks a shuffled join and splits skew."""
    return F.broadcast(frame) if rows <= limit else frame


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of the frame is called so, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words between runs of WORD_GAP, as long; null has none."""
    parts = F.size(F.split(text, WORD_GAP))
    outer = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.isNull() | text.rlike(r"\A[\x20\x09-\x0D]*\z"), 0).otherwise(parts - outer).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a text column holds about most_bytes at a time; one long text stays whole."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(lengths):
        return
    part = np.cumsum(lengths) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(low, high - low)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def ordered_buckets(frame: DataFrame, key: str, text: str, bucket_bytes: int = 8 << 20) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """Deal rows to buckets that are disjoint, ascending ranges of a long key; rows with a null key come last, in the order of their text's hash.

    Adds `_bucket` and `_at` (the key, or the hash); returns the frame, the number of buckets, and (bucket, smallest `_at`) of each bucket that has rows.
    Bounds are quantiles of the key over all rows, so a bucket holds rows of about bucket_bytes of text; above 20,000 buckets they grow,
    so who reads them must take their rows one after the other.
    """
    spark = frame.sparkSession
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    size_of = lambda c: F.coalesce(F.sum(F.when(c, F.octet_length(text))), F.lit(0))
    null = F.col(key).isNull()
    rows, size, null_rows, null_size = frame.agg(F.count_if(~null), size_of(~null), F.count_if(null), size_of(null)).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_of = lambda rows, size: max(1, min(max(int(size) // bucket_bytes, least), rows // 16, 20_000)) if rows else 0
    wanted, nulls = parts_of(rows, size), parts_of(null_rows, null_size)
    bounds: list[int] = []
    if wanted > 1:
        found = frame.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 20 * wanted).alias("q"), F.max(key).alias("m")).first()
        bounds = [int(x) for x in sorted(set(found.q)) if x < found.m]
    step = max(1, int(len(bounds) ** 0.5))
    # Two levels, so that a row looks at about twice the square root of the number of bounds.
    coarse = F.lit(bounds[step - 1 :: step]).cast("array<bigint>")
    fine = F.from_json(F.lit(str([bounds[i : i + step] for i in range(0, len(bounds), step)] + [[]])), "array<array<bigint>>")
    at = F.size(F.filter(coarse, lambda b: b < F.col(key)))
    within = F.size(F.filter(F.element_at(fine, at + 1), lambda b: b < F.col(key)))
    known = len(bounds) + 1 if rows else 0
    last = F.least(F.floor((hashed / F.lit(2.0**64) + 0.5) * nulls), F.lit(nulls - 1)) + known
    bucket = F.when(null, last).otherwise(at * step + within if bounds else 0)
    frame = frame.withColumn("_bucket", bucket.cast("int")).withColumn("_at", F.coalesce(F.col(key), hashed))
    heads = frame.groupBy("_bucket").agg(F.min("_at").alias("head")).orderBy("_bucket").collect() if known + nulls > 1 else []
    return frame, max(1, known + nulls), [(h["_bucket"], h["head"]) for h in heads]
