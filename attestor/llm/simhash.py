"""SimHash near-duplicate groups by vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. All links (a few differing bits at most) are
found by a vantage-point tree under the Hamming distance, in two parts:

* The top of the tree is fitted on a bounded sample. It deals every distinct fingerprint to the
  shard that owns it. By the triangle inequality a fingerprint within the radius of a border can have
  partners beyond it, so it also visits the shards across that border.
* Each shard builds the rest of the tree over the fingerprints that it owns, sends owners and
  visitors down it with the same bounds, and compares exactly what meets in a leaf.

Visits are directed (from the near side of a border to the far side), so each pair meets once. A
shard joins what it finds in a union-find and returns a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import prepare
from attestor.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Distinct fingerprints that the top of the tree is fitted on, at most.
SAMPLE = 8192
#: Distinct fingerprints that a shard owns, about.
SHARD_ROWS = 16_000
LEAF = 48
_CHUNK = 1 << 16


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero of none."""
    votes = sum((_votes(hashes[k : k + _CHUNK]) for k in range(0, len(hashes), _CHUNK)), np.zeros(64, dtype=np.int64))
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]


def simhash(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, words split at ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    last = ends[size - 1 :].tolist()
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(first), _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], dtype="<u8")
        votes += _votes(h)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) of every whole text; the fingerprint's 64 bits as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([simhash(t, size) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, fp long").withColumnRenamed("id", id_column)


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The point, of some few, from which distances spread most, and the median distance; None if nothing can be split."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = _far(points, v)
        border = int(np.median(d))
        if border == d.max():
            border -= 1
        if (spread := float(d.var())) > 0 and border >= d.min() and (best is None or spread > best[0]):
            best = spread, v, border
    return best and best[1:]


class TopTree:
    """Top of a vantage-point tree: deals fingerprints to shards."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = MAX_BITS):
        self.radius, self.shards, rng = radius, 0, np.random.default_rng(9)

        def grow(points: np.ndarray, left: int):
            at = _vantage(points, rng) if left and len(points) > 8 else None
            if at is None:
                self.shards += 1
                return self.shards - 1
            inside = _far(points, at[0]) <= at[1]
            return (*at, grow(points[inside], left - 1), grow(points[~inside], left - 1))

        self.root = grow(sample, depth)

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows, owned) for all points."""

        def down(node, rows: np.ndarray, owned: np.ndarray):
            if not len(rows):
                return
            if isinstance(node, int):
                yield node, rows, owned
                return
            vantage, border, near, far = node
            d = _far(points[rows], vantage).astype(np.int16)
            inside = d <= border
            to_near = inside | (~owned & (d - self.radius <= border))
            to_far = ~inside | (d + self.radius > border)
            yield from down(near, rows[to_near], owned[to_near])
            yield from down(far, rows[to_far], (owned & ~inside)[to_far])

        yield from down(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))


class _Forest:
    """Union-find whose hint array keeps the latest root seen for each element."""

    def __init__(self, n: int):
        self.parent, self.hint = list(range(n)), np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, one: int, others: np.ndarray) -> None:
        hints = self.hint[others]
        root = self.find(one)
        if len(hints) and (hints.min() != root or hints.max() != root):
            for h in np.unique(hints).tolist():
                other = self.find(h)
                if other != root:
                    low, high = min(root, other), max(root, other)
                    self.parent[high], root = low, low
            self.hint[others] = root
            self.hint[one] = root


def link_shard(points: np.ndarray, owned: np.ndarray, radius: int = MAX_BITS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, root's row) among points that have an owned one at one end."""
    forest, rng = _Forest(len(points)), np.random.default_rng(11)
    stack = [(np.flatnonzero(owned), np.flatnonzero(~owned))]
    while stack:
        own, visit = stack.pop()
        if not len(own):
            continue
        p, q = points[own], points[visit]
        at = _vantage(p, rng) if len(own) > leaf else None
        if at is None:
            both, r = np.concatenate([own, visit]), np.concatenate([p, q])
            step = max(1, 4_000_000 // len(r))
            for k in range(0, len(own), step):
                near = _far(p[k : k + step, None], r[None, :]) <= radius
                for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                    forest.join(int(own[k + i]), both[near[i]])
            continue
        vantage, border = at
        d, e = _far(p, vantage).astype(np.int16), _far(q, vantage).astype(np.int16)
        inside = d <= border
        crosses = own[inside & (d + radius > border)]
        stack.append((own[inside], visit[e - radius <= border]))
        stack.append((own[~inside], np.concatenate([visit[e + radius > border], crosses])))
    roots = np.array([forest.find(i) for i in range(len(points))], dtype=np.int64)
    rows = np.flatnonzero(roots != np.arange(len(points)))
    return rows, roots[rows]


def near_links(nodes: DataFrame, radius: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (u, v) of all pairs of distinct fingerprints within the radius; nodes: (fp)."""
    spark = nodes.sparkSession
    count = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, count / shard_rows)))))
    picked = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if depth else []
    tree = spark.sparkContext.broadcast(TopTree(np.array([r["fp"] for r in picked], dtype=np.int64).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            for shard, rows, owned in tree.value.deal(fps.view(np.uint64)):
                yield pd.DataFrame({"shard": np.int32(shard), "fp": fps[rows], "owned": owned})

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        fps = shard["fp"].to_numpy(dtype=np.int64)
        u, v = link_shard(fps.view(np.uint64), shard["owned"].to_numpy(dtype=bool), radius)
        return pd.DataFrame({"u": fps[u], "v": fps[v]})

    dealt = nodes.mapInPandas(deal, "shard int, fp long, owned boolean")
    return dealt.groupBy("shard").applyInPandas(link, "u long, v long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id): every document with the smallest id that links lead to.

    Null and empty texts have the fingerprint zero and link like any other. Copies share one
    fingerprint and are compared once. Null ids never name a component unless it has no other;
    repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    fps = fingerprints(docs, id_column, text_column, size).withColumnRenamed(id_column, "id").checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first")).checkpoint()
    roots = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_column), "fp", "component_id")
