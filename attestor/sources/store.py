"""Stores on files: the signal store by extractor and version, the embedding cache, gated splits, predictions."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import schemas
from attestor.operators.kernels import EXTRACTORS, extract


def path_exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system Spark reads the path from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_features(spark: SparkSession, path: str, keys: DataFrame | None = None, extractors=None) -> DataFrame:
    """Rows of the current versions only (partition pruning), of some keys if given; an absent store is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.SIGNAL)
    current = F.lit(False)
    for name, (_, version) in (EXTRACTORS if extractors is None else extractors).items():
        current = current | ((F.col("extractor") == name) & (F.col("version") == version))
    rows = spark.read.schema(schemas.SIGNAL).option("basePath", path).parquet(path).where(current).select(*schemas.SIGNAL.names)
    return rows if keys is None else rows.join(keys.select("sha256").distinct(), "sha256", "left_semi")


def build_store(images: DataFrame, path: str, extractors=None) -> DataFrame:
    """Extract what the store lacks, by extractor, and append it; one row (extractor, new_assets) each.

    Appending new files keeps the old ones as they are, so a failed run loses nothing.
    """
    spark, extractors = images.sparkSession, EXTRACTORS if extractors is None else extractors
    counts = []
    for name, kernel in extractors.items():
        done = load_features(spark, path, extractors={name: kernel}).select("sha256").distinct()
        todo = images.join(done, "sha256", "left_anti")
        rows = extract(todo, {name: kernel}).checkpoint()
        rows.sortWithinPartitions("sha256", "signal", "region").write.mode("append").partitionBy("extractor", "version").parquet(path)
        counts.append((name, rows.select("sha256").distinct().count()))
    return spark.createDataFrame(counts, "extractor string, new_assets long")


def append_embeddings(images: DataFrame, path: str, embed) -> int:
    """Append embeddings of assets that the cache lacks; ``embed`` maps images to (sha256, embedding). Returns how many."""
    todo = images.join(load_embeddings(images.sparkSession, path).select("sha256"), "sha256", "left_anti")
    new = embed(todo).select("sha256", F.col("embedding").cast("array<float>").alias("embedding")).checkpoint()
    new.write.mode("append").option("maxRecordsPerFile", 8192).parquet(path)
    return new.count()


def load_embeddings(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.EMBEDDING)
    rows = spark.read.schema(schemas.EMBEDDING).parquet(path)
    return rows if keys is None else rows.join(keys.select("sha256").distinct(), "sha256", "left_semi")


class TestSplitAccessError(PermissionError):
    """The test split was asked for outside the evaluation harness."""

    __test__ = False


SPLITS = ("train", "val", "test")
HARNESS = "attestor.plans.harness"


class HarnessToken:
    """Made by the evaluation harness only."""

    def __init__(self) -> None:
        caller = inspect.currentframe().f_back.f_globals.get("__name__")
        if caller != HARNESS:
            raise TestSplitAccessError(f"only {HARNESS} may read the test split, not {caller}")


def write_splits(assigned: DataFrame, path: str) -> None:
    """Assets in folders by split."""
    assigned.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, name: str, token: HarnessToken | None = None) -> DataFrame:
    """One split, without its name; the test split needs a token."""
    if name not in SPLITS:
        raise ValueError(f"no split named {name!r}")
    if name == "test" and not isinstance(token, HarnessToken):
        raise TestSplitAccessError("the test split is read through the evaluation harness")
    return spark.read.parquet(path).where(F.col("split") == name).drop("split")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Sorted by sha256 over all files."""
    manifest.orderBy("sha256").write.mode("overwrite").parquet(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """A single-shot result: a second one is an error."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)
