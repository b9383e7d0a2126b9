"""Groups of near-duplicate documents: SimHashes and banded minimum hashes bring pairs together, whole shingle sets decide.

Two documents are linked if the Jaccard similarity of their five-word shingle sets is at least 0.8.

1. Documents with equal sets are one class, found by the digest of the set.
2. Each class has the SimHash of its shingles. Classes whose SimHashes are at most four bits apart meet by
   the vantage-point trees of simhash.near_links(). At similarity 0.8 that is rarely so (SimHashes then
   differ in ten bits of 64 on average, and a tree of that radius prunes nothing), hence:
3. Each class also has BANDS keys, each of BAND_ROWS minimum hashes. Classes at similarity s share a key
   with probability 1 - (1 - s^4)^16: 0.9998 at 0.8, more above.
4. Classes that share a key are compared by their whole sets. A key's classes meet pivots first (another
   one in each round), which makes no pairs within a group; classes that links have joined are
   not compared again. What PIVOT_ROUNDS leave apart is compared pair by pair, so that no pair of a key is
   left undecided. Before sets are compared, their sizes and marks are: a set marks one of 256 bits for
   each member, so a bit that only one of two sets has is a member that the other lacks, which bounds
   what they can share. Only pairs that may still be alike leave the join.

Sets are of 40-bit hashes. Only classes that meet another one have their sets written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.bitset import bitset, only_possible
from attestor.llm.common import cut, prepare
from attestor.llm.components import components
from attestor.llm.simhash import majority, near_links
from attestor.llm.sketch import distinct_hashes, shingle_hashes, shingles

LEAST = 0.8
BANDS, BAND_ROWS = 16, 4
PIVOT_ROUNDS = 3
#: Bits that a set's members mark, as words of 64.
_MARKS = ["m0", "m1", "m2", "m3"]
_RNG = np.random.default_rng(31)
_ADD, _TIMES = (_RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 14


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys of a set of hashes, as signed longs; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        v = (hashes[None, k : k + _CHUNK] + _ADD[:, None]) * _TIMES[:, None]
        v ^= v >> np.uint64(29)
        v *= _MIX
        least = np.minimum(least, (v ^ (v >> np.uint64(32))).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets, each the bytes of its hashes."""
    a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def marks(hashes: np.ndarray) -> np.ndarray:
    """The bits that the members of a set of hashes mark."""
    marked = np.zeros(64 * len(_MARKS), dtype=bool)
    marked[(hashes % np.uint64(len(marked))).astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").view("<i8")


def _may_be_alike(least: float) -> Column:
    """Can the sets (n, marks) and (o_n, o_marks) have the similarity? A bound: false only if they cannot."""
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}{m}").bitwiseAND(F.bitwise_not(F.col(f"{b}{m}")))) for m in _MARKS[1:]), F.bit_count(F.col(f"{a}{_MARKS[0]}").bitwiseAND(F.bitwise_not(F.col(f"{b}{_MARKS[0]}")))))
    shared = F.least(F.col("n") - lacks("", "o_"), F.col("o_n") - lacks("o_", ""))
    return shared * F.lit(1 + least) >= (F.col("n") + F.col("o_n")) * F.lit(least) - F.lit(1e-6)


def _classes(rows: DataFrame) -> DataFrame:
    """(id, set1, set2, n, fp, bands, marks) of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingles(t or "") for t in batch["text"]]
            sets = [distinct_hashes(h) for h in hashes]
            fps = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]).reshape(-1, 2)
            yield pd.DataFrame({"id": batch["id"], "set1": digests[:, 0], "set2": digests[:, 1], "n": [len(s) for s in sets], "fp": fps, "bands": [band_keys(s) for s in sets]} | dict(zip(_MARKS, np.array([marks(s) for s in sets]).reshape(-1, len(_MARKS)).T, strict=True)))

    return rows.mapInPandas(run, "id long, set1 long, set2 long, n long, fp long, bands array<long>, " + ", ".join(f"{m} long" for m in _MARKS))


def _sets(rows: DataFrame) -> DataFrame:
    """(id, hashes) of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hashes": [shingle_hashes(t or "").tobytes() for t in batch["text"]]})

    return rows.mapInPandas(run, "id long, hashes binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike enough."""

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    one, two = (sets.select(F.col("id").alias(c), F.col("hashes").alias(h)) for c, h in (("u", "a"), ("v", "b")))
    return pairs.join(one, "u").join(two, "v").where(test("a", "b")).select("u", "v")


def _members(classes: DataFrame) -> DataFrame:
    """(key, id, n, marks) of keys that several classes hold."""
    keys = classes.select("id", "n", *_MARKS, F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key"))
    return cut(only_possible(keys, F.col("key"), bitset(shared, F.col("key"))).join(shared, "key", "left_semi").select("key", "id", "n", *_MARKS))


def _by_simhash(firsts: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes that hang together by equal or near SimHashes: a class with the first of its SimHash, firsts of linked SimHashes."""
    fps = firsts.groupBy("fp").agg(F.min("id").alias("head")).checkpoint()
    equal = firsts.join(fps, "fp").where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    of = lambda c, name: fps.select(F.col("fp").alias(c), F.col("head").alias(name))
    near = near_links(fps.select("fp")).join(of("u", "a"), "u").join(of("v", "b"), "v")
    return equal.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def _joined(now: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the roots that the links give them."""
    roots = components(links).withColumnRenamed("node", "id").withColumnRenamed("root", "to")
    return now.join(roots, "id", "left").select("key", "id", "n", *_MARKS, F.coalesce("to", "id").alias("root"))


def _links(members: DataFrame, sets: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Links (u, v), spanning the components of all alike pairs that share a key or are ``known`` to be near."""
    of = ["id", "n", *_MARKS, "root"]
    tested, links = known, cut(_alike(known, sets, least))
    now = _joined(members, links)
    for k in range(PIVOT_ROUNDS + 1):
        live = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        now = cut(now.join(live, "key", "left_semi").select("key", "id", "n", *_MARKS, "root"))
        if now.isEmpty():
            break
        if k < PIVOT_ROUNDS:
            order = F.xxhash64("id", F.lit(k))  # one order for all keys: classes that share several keys mostly meet one pivot
            others = now.groupBy("key").agg(F.min(F.struct(order.alias("order"), *of)).alias("o")).select("key", *[F.col(f"o.{c}").alias(f"o_{c}") for c in of])
            met = now.join(others, "key")
        else:
            others = now.select("key", *[F.col(c).alias(f"o_{c}") for c in of])
            met = now.join(others, "key").where("id < o_id")
        met = met.where((F.col("root") != F.col("o_root")) & _may_be_alike(least)).select(F.least("id", "o_id").alias("u"), F.greatest("id", "o_id").alias("v")).distinct()
        pairs = cut(met.join(tested, ["u", "v"], "left_anti"))
        links = links.unionByName(cut(_alike(pairs, sets, least)))
        if k < PIVOT_ROUNDS:
            tested = tested.unionByName(pairs)
            now = _joined(now.drop("root"), links)
    return links


def near_documents(docs: DataFrame, id_column: str, text_column: str = "text", least: float = LEAST) -> DataFrame:
    """(id, component_id): every document with the smallest id that links lead to.

    Ids are distinct longs. Null texts and texts without words have the empty set and are one class.
    docs is read twice, so the ids must be the same in both readings (common.numbered()); an empty
    table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    all_ = _classes(rows).checkpoint()
    same = all_.groupBy("set1", "set2").agg(F.min("id").alias("first")).checkpoint()
    firsts = all_.join(same.select(F.col("first").alias("id")), "id", "left_semi")
    members, known = _members(firsts), cut(_by_simhash(firsts.select("id", "fp")))
    ids = cut(members.select("id").unionByName(known.select(F.col("u").alias("id"))).unionByName(known.select(F.col("v").alias("id"))).distinct())
    sets = _sets(only_possible(rows, F.xxhash64("id"), bitset(ids, F.xxhash64("id"))).join(ids, "id", "left_semi")).checkpoint()
    roots = components(_links(members, sets, known, least)).withColumnRenamed("node", "first")
    named = same.join(roots, "first", "left").select("set1", "set2", F.coalesce("root", "first").alias("component_id"))
    return all_.select("id", "set1", "set2").join(named, ["set1", "set2"]).select(F.col("id").alias(id_column), "component_id")
