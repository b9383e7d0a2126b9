"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's words give three families of hashed n-grams: the words and their pairs, the shapes of the
words (case, digits, marks, length) and their pairs and triples, and how often each word comes
again. Within a family the counts are divided by their Euclidean length, so that a text's length
does not decide. The model is a table of 2^18 weights, fitted on the driver by FTRL-Proximal
updates, one document at a time, and scored as a sparse dot product.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import give_back, prepare

BITS = 18
#: Labelled rows that the model is fitted on, at most (those with the smallest hash of their id).
TRAINING_ROWS = 4000
WORD_MEMORY = 100_000
_MASK = np.uint64((1 << BITS) - 1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_DIGIT = re.compile(r"\d+")


def shape(word: str) -> str:
    """Case, digits, marks and length class of a word."""
    letters = "".join(c for c in word if c.isalpha())
    case = "-" if not letters else "U" if letters.isupper() and len(letters) > 1 else "l" if letters.islower() else "T" if letters[1:].islower() or len(letters) == 1 else "m"
    marks = _DIGIT.sub("0", "".join(c for c in word if not c.isalpha()))
    return f"{case}{min(len(letters), 12) // 3}{marks[:6]}"


class _Words(dict):
    """word -> (hash of the word << 32) | hash of its shape; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"))
        return value


_words = _Words()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text and their values; the empty text has the bias alone."""
    words = (text or "").split()
    bias = np.zeros(1, dtype=np.int64)
    if not words:
        return bias, np.ones(1)
    both = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    _, counts = np.unique(w, return_counts=True)
    again = np.minimum(np.log2(counts).astype(np.uint64), np.uint64(8))
    families = (
        (_mix(w, 1), _mix(w[:-1] * _M3 + w[1:], 2)),
        (_mix(s, 3), _mix(s[:-1] * _M3 + s[1:], 4), _mix((s[:-2] * _M3 + s[1:-1]) * _M3 + s[2:], 5)),
        (_mix(np.repeat(again, counts), 6), _mix((w[:-1] == w[1:]).astype(np.uint64), 7)),
    )
    index, value = [bias], [np.ones(1)]
    for family in families:
        keys = np.concatenate(family) & _MASK
        distinct, n = np.unique(keys, return_counts=True)
        index.append(distinct.astype(np.int64))
        value.append(n / math.sqrt(float(n @ n)))
    return np.concatenate(index), np.concatenate(value)


@dataclass
class Ftrl:
    """FTRL-Proximal logistic regression over a table of hashed features."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def _at(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        """One update by one document."""
        w = self._at(i)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        np.add.at(self.z, i, g - step * w)
        np.add.at(self.n, i, g * g)

    def weights(self) -> np.ndarray:
        return self._at(np.arange(1 << BITS)).astype(np.float32)


def fit(rows: Iterable[tuple[str | None, int]], epochs: int = 4, seed: int = 5) -> np.ndarray | None:
    """Weights from (text, label) rows; None if there are none."""
    rows = [(*features(t), y) for t, y in rows]
    if not rows:
        return None
    model, order = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights()


def score_text(weights: np.ndarray, text: str | None) -> float:
    """Probability of label 1."""
    i, x = features(text)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(weights[i] @ x)))))


def train(docs: DataFrame, labels: DataFrame, keep, bound: int = TRAINING_ROWS) -> np.ndarray | None:
    """Fit on at most ``bound`` labelled documents for whose doc_id the condition ``keep`` holds.

    They are those with the smallest hashes of doc_id; of a repeated id the text with the smallest hash.
    """
    order = F.xxhash64("doc_id")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep).select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(order, "doc_id", "y").limit(bound)  # at most `bound` rows: small enough to broadcast
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(text).collect()
    weights = fit((r["text"], r["y"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"] or "", r["y"])))
    del rows
    give_back()
    return weights


def scorer(spark, weights: np.ndarray | None):
    """A function from a text column to its score column; 1.0 everywhere without a model."""
    if weights is None:
        return lambda column: F.lit(1.0)
    shared = prepare(spark).sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score_text(shared.value, t) for t in batch], dtype="float64")

    return score


def score_documents(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """docs with one more column ``quality_score`` (0 to 1).

    Null and empty texts are scored by the bias. Without a model (no labelled row) every score is
    1.0: nothing is known against any document. Repeated rows get equal scores; an empty table
    gives an empty result; every column of docs is kept (one named quality_score is replaced).
    """
    return docs.withColumn("quality_score", scorer(docs.sparkSession, weights)(docs["text"]))
