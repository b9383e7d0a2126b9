"""Verdict records as they arrive: each asset's first record is appended to a table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from attestor import schemas


def verdict_stream(spark: SparkSession, source: str) -> DataFrame:
    """Verdict JSON lines of a folder, one record an asset (state: the assets seen)."""
    return spark.readStream.schema(schemas.VERDICT).json(source).where("sha256 IS NOT NULL").dropDuplicates(["sha256"])


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append new verdicts to a Parquet table; the checkpoint folder makes restarts exact."""
    writer = verdict_stream(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
