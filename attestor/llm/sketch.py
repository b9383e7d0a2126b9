"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space. The fraction does not
depend on the document, so sketches of very unequal documents can be compared: the kept hashes of a
document inside another are kept there too. The sketch of a concatenation of shingle sets is the
union of the sketches (``merge``), and containment and resemblance are estimated from the kept
hashes alone.

A fingerprint string is ``<number of distinct shingles>:<digest of the set>:<kept hashes>``, all in
hexadecimal, the hashes sorted and of fixed width. Documents too short to keep any hash are still
compared by the exact part of the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import partitions, prepare

SHINGLE_WORDS = 5
#: Kept share of the hash space: hashes below 2^40 / 4.
HASH_BITS = 40
SCALE = 4
_LIMIT = np.uint64((1 << HASH_BITS) // SCALE)
_WIDTH = HASH_BITS // 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORD_MEMORY = 100_000


class _Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _Words()


def spread(h: np.ndarray) -> np.ndarray:
    """64-bit hashes whose bits are all mixed."""
    h = h ^ (h >> np.uint64(32))
    h = h * _B
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of a text's shingles in order (lower case, split at white space; a text of fewer words is one shingle, an empty one none)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ w[k : len(w) - size + 1 + k]) * _A
        h ^= h >> np.uint64(31)
    return spread(h)


def distinct_hashes(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 40-bit hashes of shingles."""
    return np.unique(h >> np.uint64(64 - HASH_BITS))


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text's shingles."""
    return distinct_hashes(shingles(text, size))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The kept hashes of a sorted set of hashes."""
    return hashes[: np.searchsorted(hashes, _LIMIT)]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of a's shingles that are in b; None if a keeps nothing."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else None


def resemblance(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated Jaccard similarity; None if neither keeps anything."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else None


def fingerprint(hashes: np.ndarray) -> str:
    """Fingerprint string of a sorted set of hashes."""
    kept = "".join(f"{h:0{_WIDTH}x}" for h in sketch(hashes).tolist())
    return f"{len(hashes):x}:{hashlib.blake2b(hashes.tobytes(), digest_size=8).hexdigest()}:{kept}"


def parse(text: str) -> tuple[int, str, np.ndarray]:
    """(number of shingles, digest, kept hashes) of a fingerprint string."""
    n, digest, kept = text.split(":")
    return int(n, 16), digest, np.array([int(kept[i : i + _WIDTH], 16) for i in range(0, len(kept), _WIDTH)], dtype=np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Resemblance of two sets of hashes by their sketches; where neither keeps a hash, 1 if the sets are equal, else 0."""
    near = resemblance(sketch(a), sketch(b))
    return near if near is not None else float(np.array_equal(a, b))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, fingerprint) of every whole text; a null text is the empty text, repeated rows each give a row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t or "") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_shingles": [len(h) for h in sets], "fingerprint": [fingerprint(h) for h in sets]})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_shingles long, fingerprint string").withColumnRenamed("id", id_column)


_BLOCK = 32


def _place(borders: list[int]):
    """How many of the borders (descending) are at or above doc_id; nulls stand below all."""
    if not borders:
        return F.lit(0)
    above = lambda b: b >= F.col("doc_id")
    blocks = F.size(F.filter(F.array(*map(F.lit, borders[::_BLOCK])), above))
    block = F.slice(F.array(*map(F.lit, borders)), (blocks - 1) * _BLOCK + 1, F.lit(_BLOCK))
    found = F.when(blocks > 0, (blocks - 1) * _BLOCK + F.size(F.filter(block, above))).otherwise(0)
    return F.when(F.col("doc_id").isNull(), len(borders)).otherwise(found)


def _with_successors(docs: DataFrame) -> DataFrame:
    """(place, guest, doc_id, text): documents dealt by ranges of doc_id, largest first.

    Each range also gets the first row of the next range (the last range: of the first), marked as
    guest, so that every document meets its successor in its own task and texts move once. Only the
    ranges' borders and first ids, one of each for a shuffle partition, visit the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("b")).first()["b"] if shares else None
    docs = docs.withColumn("place", _place(sorted(set(found or []), reverse=True)))
    heads = sorted((r["place"], r["head"]) for r in docs.groupBy("place").agg(F.max("doc_id").alias("head")).collect())
    guests = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "head long, to int")
    own = F.struct(F.col("place"), F.lit(0).alias("guest"))
    also = F.struct(F.col("to").alias("place"), F.lit(1).alias("guest"))
    dealt = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")  # a row for each range
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))))
    dealt = dealt.select("at.place", "at.guest", "doc_id", "text").repartitionByRange(n, "place")
    return dealt.sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), "text")


def compare_with_successors(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document by descending doc_id.

    The edited text: the last floor(n_chars / 2) code points replaced by as many first ones of the
    next document; after the last document comes the first. Null texts are empty; rows that share a
    doc_id follow each other by text; null ids come last. A single document is its own next one. An
    empty table gives an empty result; other columns are not read.
    """
    spark = prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, rows, size = None, [], 0
        for batch in batches:
            for place, guest, doc, text in batch.itertuples(index=False, name=None):
                doc = None if pd.isna(doc) else int(doc)
                now = (place, guest, doc, text, shingle_hashes(text))
                if before and before[0] == place and not before[1]:
                    rows.append(_pair(before, now))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                    if size > 4_000_000:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows, size = [], 0
                before = now
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.isEmpty():
        return spark.createDataFrame([], schema)
    return _with_successors(docs).mapInPandas(run, schema)


def _pair(row: tuple, successor: tuple) -> tuple:
    _, _, doc, text, own = row
    half = len(text) // 2
    edited = text[: len(text) - half] + successor[3][:half]
    changed = shingle_hashes(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, successor[4])
