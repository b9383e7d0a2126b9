"""Column functions: hashing, hash bands, labels, calibration, prompt text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values: (offset from the low bit, width) of the five bands of a 64-bit hash.
BANDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
MAX_BITS = 4
#: Asset file endings.
SUFFIXES = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp"]
#: Parts of feature names that would leak how a file was stored.
FORBIDDEN = ["file_bytes", "file_size", "quality_factor", "qf"]


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, in hexadecimal."""
    return F.sha2(content.cast("binary"), 256)


def has_asset_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(SUFFIXES)


def classify(source: Column, path: Column) -> Column:
    """struct(label, manipulation) by source and path; an unknown source raises."""
    name, parent = F.element_at(F.split(path, "/"), -1), F.try_element_at(F.split(path, "/"), F.lit(-2))
    both = lambda label, kind: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("manipulation"))
    return (
        F.when(source.startswith("micc"), F.when(F.contains(F.lower(name), F.lit("tamp")), both("manipulated", "copy_move")).otherwise(both("authentic", "none")))
        .when(source == "cifake", F.when(parent == "fake", both("manipulated", "ai_generated")).otherwise(both("authentic", "none")))
        .otherwise(F.raise_error(F.concat(F.lit("no label rule for source "), source)))
    )


def scene_of(source: Column, path: Column) -> Column:
    """Scene key: the name's leading letters and digits for micc sources, else the name without its ending."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    found = F.regexp_extract(name, r"^([A-Za-z]*_?\d+)", 1)
    return F.concat(source, F.lit(":"), F.when(source == "cifake", stem).otherwise(F.when(found == "", name).otherwise(found)))


def hex_to_long(hash_hex: Column) -> Column:
    """16 hexadecimal digits as a signed long (in two halves: one would overflow)."""
    half = lambda at: F.conv(F.substring(hash_hex, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(value: Column) -> Column:
    """Array of struct(band, key): two hashes at most MAX_BITS apart share one of the five."""
    key = lambda i, at, width: F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)).alias("key"))
    return F.array(*[key(i, at, width) for i, (at, width) in enumerate(BANDS)])


def order_key(seed: int, cluster: Column) -> Column:
    """Seeded order of clusters."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), cluster.cast("string")), 256)


def binary_label(label: Column) -> Column:
    return (label == "manipulated").cast("int")


def clip_probability(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def logit(p: Column) -> Column:
    p = clip_probability(p)
    return F.log(p / (1 - p))


def scaled(p: Column, temperature: Column) -> Column:
    """Temperature-scaled probability."""
    return 1 / (1 + F.exp(-logit(p) / temperature))


def predicted_class_confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def verdict_score(label: Column, confidence: Column) -> Column:
    """Probability of manipulation that a verdict states; 0.5 without one."""
    return F.when(label == "manipulated", confidence).when(label == "authentic", 1 - confidence).otherwise(0.5)


def angular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


#: Signal families by prefix, in order of precedence.
FAMILIES = [
    ("jpeg_ghost", "Compression: JPEG ghost analysis"), ("blocking", "Compression: blocking grid"), ("noise", "Noise residuals"), ("edge", "Edge structure"), ("lighting", "Lighting direction"),
]


def family(signal: Column) -> Column:
    found = F.lit("Other signals")
    for prefix, title in reversed(FAMILIES):
        found = F.when(signal.startswith(prefix), title).otherwise(found)
    return found


@F.pandas_udf(StringType())
def four_decimals(values: pd.Series) -> pd.Series:
    """Exact binary value with four decimals, ties to even (the engine's own formats round the shortest decimal)."""
    return values.map(lambda v: None if v is None else f"{v:.4f}")


_token_votes: dict[str, np.ndarray] = {}


def _votes(token: str) -> np.ndarray:
    found = _token_votes.get(token)
    if found is None:
        if len(_token_votes) > 200_000:
            _token_votes.clear()
        bits = np.unpackbits(np.frombuffer(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:8], dtype=np.uint8))
        found = _token_votes[token] = bits.astype(np.int8) * 2 - 1
    return found


@F.pandas_udf(StringType())
def text_phash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Perceptual hash of a text: majority of the bits of its words' hashes, 16 hexadecimal digits."""

    def one(text: str | None) -> str:
        words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(words), 4096):
            total += np.sum([_votes(w) for w in words[at : at + 4096]], axis=0, dtype=np.int64)
        return np.packbits(total > 0).tobytes().hex()

    for batch in texts:
        yield batch.map(one)


def region_edges(size: Column) -> Column:
    """Edges of three regions along a side."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.round(i * size / 3).cast("int"))


def metric_text(value: Column, low: Column, high: Column) -> Column:
    """``0.9547 [0.9517, 0.9579]``; without bounds ``0.9547 (CI undefined)``."""
    undefined = F.isnan(low) | F.isnan(high) | low.isNull() | high.isNull()
    return F.when(undefined, F.concat(four_decimals(value), F.lit(" (CI undefined)"))).otherwise(
        F.concat(four_decimals(value), F.lit(" ["), four_decimals(low), F.lit(", "), four_decimals(high), F.lit("]"))
    )


def check_feature_names(names: list[str]) -> list[str]:
    """The names, if none tells how a file was stored."""
    bad = [n for n in names if any(f in n for f in FORBIDDEN)]
    if bad:
        raise ValueError(f"features leak storage traits: {bad}")
    return names
