"""Streams: workbooks that land in a folder, and windowed totals of late-arriving events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources.workbook import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_workbooks(spark: SparkSession, folder: str, on_grid: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.xlsx", trigger: dict | None = None) -> StreamingQuery:
    """Call on_grid(grid, batch) for the workbooks that arrive; a batch that fails is run again from the checkpoint."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(folder)
    return files.writeStream.foreachBatch(lambda batch, n: on_grid(parse_files(batch), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_totals(events: DataFrame, time: str, keys: list[str], value: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by key and time window; what comes later than the watermark is left out. Batch frames work as well."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    marked = events.withWatermark(time, late)
    return marked.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
