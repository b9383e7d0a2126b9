"""The evaluation harness: the one door to the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.operators.verdicts import run_batch
from attestor.sources.store import HarnessToken, load_split


def load_test_split(spark: SparkSession, path: str) -> DataFrame:
    return load_split(spark, path, "test", HarnessToken())


def reason_on_split(spark: SparkSession, path: str, split: str, frame: DataFrame | None = None, **batch) -> DataFrame:
    """A batch over train or val, or over a given frame; the test split comes through reason_on_test."""
    if frame is None and split == "test":
        raise ValueError("test-split inference goes through reason_on_test()")
    return run_batch(split, load_split(spark, path, split) if frame is None else frame, **batch)


def reason_on_test(spark: SparkSession, path: str, **batch) -> DataFrame:
    return run_batch("test", load_test_split(spark, path), **batch)
