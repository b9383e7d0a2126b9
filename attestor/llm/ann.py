"""Approximate nearest neighbours by shifted space-filling curves.

Every vector's direction is projected at random to a few dimensions, shifted, and put on a Hilbert
curve; eight projections and shifts give eight orders. Each order is cut into key ranges (borders
from a bounded sample), and neighbouring ranges make a chunk, which Spark deals out. On every curve a
query looks at the ranges within a window around its own, in two passes:

1. *Home.* The part of each window that lies in the query's own chunk. The curves' lists merge, and the
   worst neighbour of the merged list is a lower bound for the rest.
2. *Away.* The chunks that the rest of the windows reach. A chunk yields only what meets the bound, so
   that what is shuffled does not grow with the rows looked at.

All lists are ranked by the exact cosine. How wide the window must be depends on the data: near
neighbours of clustered vectors share a range, while those of directions spread evenly over many
dimensions are hardly nearer than anything else. So the width is fitted: for a bounded sample of
queries the true neighbours are found by one exact pass over all rows, and the narrowest window that
holds the target share of them on some curve is taken. Every row is indexed whatever the width.

Equal vectors are one point of the index, which stands for the smallest ids that can be returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import cut, prepare
from attestor.llm.hilbert import hilbert_keys

CURVES = 8
#: Dimensions of a projection, and bits of each.
DIMS, BITS = 6, 8
#: Rows, and bytes of their vectors, that the ranges' borders are fitted on, at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Rows of a range, ranges of a chunk, and rows of a chunk that one task holds, about (chunks with more are split).
RANGE_ROWS, CHUNK_RANGES, BLOCK_ROWS = 512, 32, 32_768
#: Queries that the window is fitted on, at most; share of their true neighbours that it must hold.
FIT_QUERIES, FIT_SHARE = 160, 0.96
_FOUND = "query_id long, rank int, vec_id long, score double"


class Curves:
    """The curves' projections, shifts and range borders."""

    def __init__(self, sample: np.ndarray, ranges: int, seed: int = 7):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        dims = min(DIMS, dim)
        self.axes = [np.linalg.qr(rng.normal(size=(dim, dims)))[0] for _ in range(CURVES)]
        self.shifts = [rng.random(dims) for _ in range(CURVES)]
        self.spread = [max(1e-9, float(np.abs(_unit(sample) @ a).max())) * 1.05 for a in self.axes]
        keys = self.keys(sample)
        at = np.linspace(0, len(sample), ranges + 1)[1:-1].astype(int)
        self.borders = [np.unique(np.sort(k)[at]) for k in keys]

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit, cells = _unit(vectors), 1 << BITS
        out = []
        for axes, shift, spread in zip(self.axes, self.shifts, self.spread, strict=True):
            # the cube is twice as wide as needed in no direction, but moved by up to a quarter of it
            place = ((unit @ axes) / spread + 1) * 0.375 + shift * 0.25
            out.append(hilbert_keys(np.clip(place * cells, 0, cells - 1).astype(np.int64), BITS))
        return out

    def ranges(self, vectors: np.ndarray) -> np.ndarray:
        """Range of each vector (columns) on each curve (rows)."""
        return np.array([np.searchsorted(b, k, side="right") for b, k in zip(self.borders, self.keys(vectors), strict=True)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cosines) of the k nearest of each query, ties to the smaller id; exact, in double precision. ``least``: lower scores are of no use."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    least = np.full(len(queries), -np.inf) if least is None else least
    for at in range(0, len(queries), 256):
        rough = _unit(queries[at : at + 256]) @ (vectors / norms[:, None]).T
        for q, near, floor in zip(queries[at : at + 256], rough, least[at : at + 256], strict=True):
            if len(near) > k:
                floor = max(floor, np.partition(near, len(near) - k)[len(near) - k])
            rows = np.flatnonzero(near >= floor - 1e-9)  # rounding of the product cannot hide a tie
            cosine = (vectors[rows] * q).sum(axis=1) / (np.sqrt((q * q).sum()) * norms[rows])
            order = np.lexsort((ids[rows], -cosine))[:k]
            yield rows[order], cosine[order]


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column) if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id meets ``is_query``.

    ``is_query`` maps an id column to a condition. Candidates are all rows but those with the query's
    id (where ids repeat, other vectors of the query's id are none either); score is the cosine of the
    original vectors in double precision; nearest first, ties to the smaller id. Null ids, and vectors
    that are null, zero, or hold null, NaN or infinite components take no part. Vectors of different
    lengths have no cosine: each length is a space of its own. Repeated rows (same id and vector)
    count once. Queries with fewer candidates than k get them all; empty tables give an empty result;
    other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    rows = _valid(vectors, id_column, vector_column)
    out = spark.createDataFrame([], _FOUND)
    for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():  # lengths of vectors
        out = out.unionByName(_nearest(rows.where(F.size("v") == r["dim"]).distinct(), is_query, k, r["dim"]))
    return out


def _best(lists: DataFrame, by: str, k: int) -> DataFrame:
    """The k best rows of each query, as column ``rank``."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(rows: DataFrame, is_query, k: int, dim: int) -> DataFrame:
    """nearest() of distinct rows (id, v) of one length."""
    spark = rows.sparkSession
    # a vector's k + 1 smallest ids are all that any query can return of it
    by_vector = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1).select("id", "v").checkpoint()
    asked = rows.where(is_query(F.col("id"))).checkpoint()
    queries = asked.groupBy("v").agg(F.min("id").alias("q"))

    n = points.count()
    by_hash = lambda df, c, m: df.orderBy(F.xxhash64(c), c).limit(m).collect()
    sample = np.array([r["v"] for r in by_hash(points, "id", max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim))))], dtype=np.float64)
    curves = Curves(sample, max(1, min(-(-n // RANGE_ROWS), len(sample) // 2)))
    some = by_hash(queries, "q", FIT_QUERIES)
    if not some:
        return spark.createDataFrame([], _FOUND)
    width = _fit_window(points, np.array([r["v"] for r in some], dtype=np.float64), curves, k)
    lists = window_lists(points, queries, curves, width, k + 1, n)
    # back from distinct query vectors to the queries, each without its own row
    each = asked.join(queries, "v").select("q", F.col("id").alias("query_id"))
    merged = each.join(_best(lists, "q", k + 1).drop("rank"), "q").where(F.col("id") != F.col("query_id"))
    return _best(merged, "query_id", k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def window_lists(points: DataFrame, queries: DataFrame, curves: Curves, width: int, k: int, n: int) -> DataFrame:
    """(q, id, score): all that the k nearest in a query's windows can be; points: (id, v), queries: (q, v), distinct vectors."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((curves, width))
    # rows of a chunk are split by id where chunks are so large that one task should not hold them
    ranges = max(len(b) for b in curves.borders) + 1
    splits = max(1, -(-n * CHUNK_RANGES // (ranges * BLOCK_ROWS)))
    kind = points.schema["v"].dataType.simpleString()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                split = (batch["id"].to_numpy() % splits).astype(np.int32)
                for c, at in enumerate(shared.value[0].ranges(_stack(batch["v"]))):
                    yield pd.DataFrame({"curve": np.int32(c), "chunk": (at // CHUNK_RANGES).astype(np.int32), "split": split, "at": at.astype(np.int32), "id": batch["id"], "v": batch["v"]})

    def visit(home: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            curves, width = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                floor = np.full(len(batch), -np.inf) if home else batch["floor"].to_numpy()
                for c, at in enumerate(curves.ranges(_stack(batch["v"]))):
                    low, high = np.maximum(at - width, 0), np.minimum(at + width, len(curves.borders[c]))
                    first, last, own = low // CHUNK_RANGES, high // CHUNK_RANGES, at // CHUNK_RANGES
                    count = last - first + 1
                    q = np.repeat(np.arange(len(at)), count)
                    chunk = np.arange(len(q)) - np.repeat(np.cumsum(count) - count - first, count)
                    here = (chunk == own[q]) == home
                    q, chunk = q[here], chunk[here]
                    for split in range(splits):
                        yield pd.DataFrame({
                            "curve": np.int32(c), "chunk": chunk.astype(np.int32), "split": np.int32(split), "low": low[q].astype(np.int32), "high": high[q].astype(np.int32),
                            "q": batch["q"].to_numpy()[q], "floor": floor[q], "v": batch["v"].to_numpy()[q],
                        })

        return run

    def rank(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q, found, scores = [], [], []
        if len(points) and len(queries):
            points = points.sort_values("at", kind="stable")
            at, ids, vectors = points["at"].to_numpy(), points["id"].to_numpy(), _stack(points["v"])
            for (low, high), asked in queries.groupby(["low", "high"], sort=False):
                a, b = np.searchsorted(at, low, side="left"), np.searchsorted(at, high, side="right")
                if a < b:
                    for name, (rows, near) in zip(asked["q"], best_of(_stack(asked["v"]), ids[a:b], vectors[a:b], k, asked["floor"].to_numpy()), strict=True):
                        q.append(np.full(len(rows), name))
                        found.append(ids[a:b][rows])
                        scores.append(near)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        return pd.DataFrame({"q": joined(q, "int64"), "id": joined(found, "int64"), "score": joined(scores, "float64")})

    key = ["curve", "chunk", "split"]
    dealt = points.mapInPandas(index, f"curve int, chunk int, split int, at int, id long, v {kind}").groupBy(*key)
    visits = f"curve int, chunk int, split int, low int, high int, q long, floor double, v {kind}"
    look = lambda queries, home: dealt.cogroup(queries.mapInPandas(visit(home), visits).groupBy(*key)).applyInPandas(rank, "q long, id long, score double")
    near = cut(_best(look(queries, True).distinct(), "q", k))
    floor = near.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    away = look(queries.join(floor, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), False)
    return near.drop("rank").unionByName(away).distinct()


def exact_nearest(points: DataFrame, queries: np.ndarray, k: int) -> dict[int, list[tuple[float, int, list[float]]]]:
    """k nearest points of some few queries by one pass over all: query -> [(score, id, vector)]."""
    shared = points.sparkSession.sparkContext.broadcast(queries)
    kind = points.schema["v"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ids, vectors = batch["id"].to_numpy(), batch["v"].to_numpy()
                for q, (rows, scores) in enumerate(best_of(shared.value, ids, _stack(batch["v"]), k)):
                    yield pd.DataFrame({"q": np.int32(q), "id": ids[rows], "score": scores, "v": vectors[rows]})

    lists = _best(points.mapInPandas(scan, f"q int, id long, score double, v {kind}"), "q", k)
    out: dict[int, list] = {}
    for r in lists.collect():  # k rows for each of the few queries
        out.setdefault(r["q"], []).append((r["score"], r["id"], r["v"]))
    return out


def _fit_window(points: DataFrame, queries: np.ndarray, curves: Curves, k: int) -> int:
    """Ranges to each side that hold the wanted share of the true neighbours of the sampled queries."""
    true = exact_nearest(points, queries, k + 1)
    own, away = curves.ranges(queries), []
    for q, near in true.items():
        at = curves.ranges(np.array([v for _, _, v in near], dtype=np.float64))
        far = np.abs(at - own[:, q][:, None]).min(axis=0)
        itself = np.array([np.array_equal(v, queries[q]) for _, _, v in near])
        away.extend(far[~itself].tolist())
    return int(np.quantile(away, FIT_SHARE, method="higher")) if away else 0
