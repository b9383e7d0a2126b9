"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import cut

#: Links that one task may join by itself (16 bytes each); more are contracted by joins.
FEW_LINKS = 100_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of a few links, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in parent], columns=["node", "root"], dtype="int64")


def _smallest(links: DataFrame) -> DataFrame:
    """u -> the smallest of u and its neighbours (map-side combined, so hot vertices are no matter)."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the links (u, v), root being the smallest vertex reachable.

    Alternating star contraction: large stars hang the larger neighbours of each vertex on its
    smallest neighbour, small stars the smaller ones; the forest's depth falls geometrically. Each
    round is a combined minimum and an equi-join (which adaptive execution splits where a vertex is
    hot), written by checkpoint(); only a count and a sum of hashes of the links visit the driver.
    FEW_LINKS and fewer, by their count, are joined in one task instead, which is some thousand tasks
    less. Vertices are longs.
    """
    links = cut(links.where("u <> v").distinct())
    if links.count() <= FEW_LINKS:
        return cut(links.coalesce(1).mapInPandas(_joined, "node long, root long"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = down.join(_smallest(down), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    # every link now goes from a vertex to its root
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
