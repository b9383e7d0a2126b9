"""File-to-file stages: raw files to manifest, manifest to splits, images to the signal store, evaluation to report.

Each stage is skipped when its inputs' digest is the one that it left beside its result; ``force``
runs it anyway. Paths are whatever Spark can read and write.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import schemas
from attestor.operators import dedupe, splits
from attestor.operators.kernels import resize_axis
from attestor.plans.report import render, to_json
from attestor.sources import assets, store
from attestor.session import prepare


def image_phash(gray: np.ndarray) -> str:
    """64-bit perceptual hash: the 8 x 8 lowest cosine frequencies of a 32 x 32 reduction against their median."""
    small = resize_axis(resize_axis(gray, 32).T, 32).T
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


@F.pandas_udf(schemas._struct(width=schemas.I, height=schemas.I, phash=schemas.S))
def measure(contents: pd.Series) -> pd.DataFrame:
    """struct(width, height, phash) of image files that decode_gray() reads."""
    grays = [assets.decode_gray(bytes(c)) for c in contents]
    return pd.DataFrame({"width": [g.shape[1] for g in grays], "height": [g.shape[0] for g in grays], "phash": [image_phash(g) for g in grays]})


def read_images(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(sha256, height, width, pixels) of a manifest's files below a folder."""

    @F.pandas_udf(schemas._struct(height=schemas.I, width=schemas.I, pixels=schemas.T.ArrayType(schemas.D)))
    def decode(contents: pd.Series) -> pd.DataFrame:
        grays = [assets.decode_gray(bytes(c)) for c in contents]
        return pd.DataFrame({"height": [g.shape[0] for g in grays], "width": [g.shape[1] for g in grays], "pixels": [g.ravel() for g in grays]})

    files = assets.read_files(spark, path).join(manifest.select("sha256", "path"), "path")
    return files.select("sha256", decode("content").alias("i")).select("sha256", "i.*")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not store.path_exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # a small file of this module


def _digest(df: DataFrame, *columns: str) -> str:
    """Order-free digest of some columns."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(str(tuple(row)).encode()).hexdigest()


def _fresh(spark: SparkSession, out: str, digest: str, force: bool) -> bool:
    return not force and (read_text(spark, f"{out}.digest") or "").strip() == digest


def raw_assets(spark: SparkSession, root: str) -> DataFrame:
    """Files of every source below a folder that has a source record; paths start with the source's folder."""
    prepare(spark)
    records = spark.read.option("multiLine", True).schema(schemas.SOURCE_RECORD).json(f"{root}/*/source_record.json")
    rows = None
    for r in records.select("source", "license").orderBy("source").collect():  # a configuration of some few sources
        found = assets.scan_assets(assets.read_files(spark, f"{root}/{r['source']}"), r["source"], r["license"], lambda c: measure(c))
        found = found.withColumn("path", F.concat(F.lit(f"{r['source']}/"), "path"))
        rows = found if rows is None else rows.unionByName(found)
    return rows if rows is not None else spark.createDataFrame([], schemas.MANIFEST)


def path_order(path: Column) -> Column:
    """Order of paths by their parts, not by their characters."""
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def build_manifest(spark: SparkSession, root: str, out: str, force: bool = False) -> dict | None:
    """Write the deduplicated manifest and return its report; None if nothing changed."""
    rows = raw_assets(spark, root).checkpoint()
    digest = _digest(rows, "sha256", "path")
    if _fresh(spark, out, digest, force):
        return None
    fated = dedupe.collapse(rows.withColumn("_order", path_order(F.col("path"))), "_order").drop("_order").checkpoint()
    kept = fated.where("fate = 'kept'").select(*schemas.MANIFEST.names)
    store.write_manifest(kept, out)
    report = dedupe.collapse_report(fated).first().asDict()
    for name in ("source", "label"):
        report[f"by_{name}"] = {r[name]: r["count"] for r in kept.groupBy(name).count().orderBy(name).collect()}
    write_text(spark, json.dumps(report, indent=2), f"{out}.report.json")
    write_text(spark, digest, f"{out}.digest")
    return report


def build_splits(spark: SparkSession, manifest: str, out: str, seed: int = splits.SPLIT_SEED, force: bool = False) -> dict | None:
    """Write the splits and their summary with the test split's hash; None if nothing changed."""
    rows = prepare(spark).read.parquet(manifest)
    digest = _digest(rows, *schemas.MANIFEST.names)
    if _fresh(spark, out, digest, force):
        return None
    assigned = splits.assign_splits(rows, seed).select(*schemas.MANIFEST.names, "split").checkpoint()
    store.write_splits(assigned, out)
    shares: dict[str, dict] = {}
    counts: dict[str, int] = {}
    for r in splits.split_shares(assigned).orderBy("split", "manipulation").collect():  # splits times types
        shares.setdefault(r["split"], {})[r["manipulation"]] = r["share"]
        counts[r["split"]] = counts.get(r["split"], 0) + r["n"]
    summary = {"seed": seed, "counts": counts, "type_shares": shares, "test_sha256": splits.canonical_hash(assigned.where("split = 'test'"))}
    write_text(spark, json.dumps(summary, indent=2), f"{out}.summary.json")
    write_text(spark, digest, f"{out}.digest")
    return summary


def verify_splits(spark: SparkSession, manifest: str, out: str) -> bool:
    """Does the assignment, made again, have the committed test hash?"""
    summary = json.loads(read_text(spark, f"{out}.summary.json"))
    return splits.verify_split(splits.assign_splits(prepare(spark).read.parquet(manifest), summary["seed"]), summary["test_sha256"])


def build_signals(spark: SparkSession, root: str, manifest: str, out: str) -> dict:
    """Extract what the store lacks; new assets by extractor."""
    images = read_images(spark, root, prepare(spark).read.parquet(manifest))
    return {r["extractor"]: r["new_assets"] for r in store.build_store(images, out).collect()}


def write_report(spark: SparkSession, summary: dict, out: str) -> None:
    write_text(spark, to_json(summary), f"{out}/summary.json")
    write_text(spark, render(summary), f"{out}/README.md")


__all__ = ["build_manifest", "build_signals", "build_splits", "image_phash", "raw_assets", "read_images", "verify_splits", "write_report"]
