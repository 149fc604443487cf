"""Cutting lineage with shared tables, and the bounds of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.sources.shared import settled as stash
from millrace.sources.shared import shared_folder as shared_dir

__all__ = ["shared_dir", "small_batches", "stash"]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, and so what a Python worker holds at once; applications call it, operators don't."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
