"""Cutting the lineage of iterative plans through a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def durable(frame: DataFrame, kind: str) -> DataFrame:
    """The frame, written under spark.checkpoint.dir and read again. Where that is unset, a temporary folder serves on a single machine; on a cluster it is an error."""
    spark = frame.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tessella-shared")
    path = f"{base.rstrip('/')}/tessella/{kind}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
