"""Leakage-safe stratified splits: order, greedy assignment, shares, canonical hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.scalars import order_key
from attestor.operators.dedupe import cluster_assets, dominant_types
from attestor.session import prepare

SPLIT_SEED = 20260803
#: Shares of the splits.
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def assign_clusters(typed: DataFrame, seed: int = SPLIT_SEED, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(cluster, split) from (cluster, size, dominant).

    Within a dominant type, clusters in seeded order go to the split that lacks most of its share
    (ties: the alphabetically first). Types are independent; within one the choice depends on all
    choices before, so each type is one sorted stream that a task reads with a state of three numbers.
    """
    prepare(typed.sparkSession)
    names = sorted(ratios)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, fill = None, {}
        for batch in batches:
            chosen = []
            for dominant, size, total in zip(batch["dominant"], batch["size"], batch["total"], strict=True):
                if dominant != kind:
                    kind, fill = dominant, dict.fromkeys(names, 0)
                best = max(names, key=lambda s: ratios[s] * total - fill[s])  # max keeps the first of equals
                fill[best] += size
                chosen.append(best)
            yield pd.DataFrame({"cluster": batch["cluster"], "split": chosen})

    totals = typed.groupBy("dominant").agg(F.sum("size").alias("total"))
    ordered = typed.join(F.broadcast(totals), "dominant").withColumn("key", order_key(seed, F.col("cluster")))  # a row for each type
    ordered = ordered.repartition("dominant").sortWithinPartitions("dominant", "key", "cluster")
    kind = typed.schema["cluster"].dataType.simpleString()
    return ordered.select("dominant", "cluster", "size", "total").mapInPandas(run, f"cluster {kind}, split string")


def assign_splits(assets: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Every asset with its cluster and split; a cluster lies in one split."""
    clusters = cluster_assets(assets).checkpoint()
    splits = assign_clusters(dominant_types(assets, clusters), seed)
    return assets.join(clusters, "sha256").join(splits, "cluster")


def split_shares(assigned: DataFrame) -> DataFrame:
    """(split, manipulation, n, share) with shares of the split, four decimals."""
    counted = assigned.groupBy("split", "manipulation").agg(F.count("*").alias("n"))
    totals = counted.groupBy("split").agg(F.sum("n").alias("total"))
    return counted.join(totals, "split").select("split", "manipulation", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def canonical_hash(keys: DataFrame, key: str = "sha256") -> str:
    """SHA-256 of the sorted keys, one a line: made as a stream over sorted ranges, so the keys are never one row."""
    import hashlib

    digest = hashlib.sha256()
    for row in keys.select(key).orderBy(key).toLocalIterator(prefetchPartitions=True):
        digest.update((row[0] + "\n").encode())
    return digest.hexdigest()


def canonical_hash_column(keys: DataFrame, *by: str, key: str = "sha256") -> DataFrame:
    """The same hash as a column, for key sets of a size that fits a row (some hundreds of thousands)."""
    text = F.concat(F.array_join(F.array_sort(F.collect_list(key)), "\n"), F.lit("\n"))
    return keys.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(text, 256).alias("sha256"))


def verify_split(assigned: DataFrame, expected: str) -> bool:
    """Does the test split still have the committed hash?"""
    return canonical_hash(assigned.where("split = 'test'")) == expected
