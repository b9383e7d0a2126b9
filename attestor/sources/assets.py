"""Raw sources: catalog, checksums, archives, embedded images, asset scan, decoding of simple formats."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import schemas
from attestor.functions.scalars import classify, content_hash, has_asset_suffix, scene_of
from attestor.session import prepare
from attestor.sources import jpeg


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source catalog (YAML or JSON, read through Spark): one row a source; ``enabled`` as a boolean, no urls: no files."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # a configuration file
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    rows = []
    for s in found.get("sources", []):
        urls = s.get("urls") or s.get("files") or []
        files = [(u, None) if isinstance(u, str) else (u.get("url"), u.get("sha256")) for u in urls]
        rows.append((s.get("name"), s.get("kind"), s.get("license"), [str(c) for c in s.get("classes") or []], bool(s.get("enabled", True)), files, s.get("notes")))
    return spark.createDataFrame(rows, schemas.SOURCE)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


class ChecksumMismatchError(ValueError):
    """A file's bytes do not have the committed hash."""

    def __init__(self, url: str, expected: str, actual: str):
        super().__init__(f"{url}: expected sha256 {expected}, found {actual}")
        self.url, self.expected, self.actual = url, expected, actual


class TruncatedDownloadError(OSError):
    """A file is shorter than announced."""

    def __init__(self, url: str, expected: int, actual: int):
        super().__init__(f"{url}: {actual} of {expected} bytes")
        self.url, self.expected, self.actual = url, expected, actual


def fetch(url: str, path: str) -> str:
    """Copy a URL to a file of the driver's disk, by way of ``path.part``; fewer bytes than announced raise and leave nothing."""
    part = f"{path}.part"
    try:
        with urllib.request.urlopen(url) as source, open(part, "wb") as to:  # noqa: S310
            announced = source.headers.get("Content-Length")
            shutil.copyfileobj(source, to, 1 << 20)
        size = os.path.getsize(part)
        if announced is not None and int(announced) != size:
            raise TruncatedDownloadError(url, int(announced), size)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def ensure_file(url: str, expected: str, folder: str) -> str:
    """The file of a URL in a folder of the driver, fetched if need be, with the expected SHA-256.

    A marker beside it tells that this was verified before; a file with another hash is deleted and raises.
    """
    path = os.path.join(folder, url.rsplit("/", 1)[-1])
    marker = f"{path}.verified"
    if os.path.exists(path) and os.path.exists(marker):
        with open(marker, encoding="utf-8") as f:
            if f.read().strip() == expected:
                return path
    if not os.path.exists(path):
        fetch(url, path)
    with open(path, "rb") as f:
        actual = hashlib.file_digest(f, "sha256").hexdigest()
    if actual != expected:
        os.remove(path)
        raise ChecksumMismatchError(url, expected, actual)
    with open(marker, "w", encoding="utf-8") as f:
        f.write(expected)
    return path


def checksum_violations(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(url, expected, actual) where a file's content (name, content) is absent or has another hash; expected: (url, sha256)."""
    have = files.select("name", content_hash(F.col("content")).alias("actual"))
    want = expected.select("url", F.element_at(F.split("url", "/"), -1).alias("name"), F.col("sha256").alias("expected"))
    return want.join(have, "name", "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select("url", "expected", "actual")


def check_files(files: DataFrame, expected: DataFrame) -> None:
    if bad := checksum_violations(files, expected).first():
        raise ChecksumMismatchError(bad["url"], bad["expected"], bad["actual"] or "no file")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, content) of all files below a folder; path is relative to it."""
    root = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.expr(f"substring_index(path, '{root.split('://')[-1].lstrip('/')}/', -1)")
    return rows.select(inside.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def extract_archives(files: DataFrame) -> DataFrame:
    """(archive, path, content) of every member of zip files (name, content)."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            yield pd.DataFrame([(name, member.filename, z.read(member))], columns=["archive", "path", "content"])

    return files.select("name", "content").mapInPandas(run, "archive string, path string, content binary")


def embedded_images(spark: SparkSession, path: str, image: str = "image", label: str = "label") -> DataFrame:
    """(path, content) of images in a Parquet table: cells are bytes or struct(bytes); 0 is real, 1 fake; numbered by file order."""
    rows = spark.read.parquet(path)
    content = F.col(f"{image}.bytes") if rows.schema[image].dataType.typeName() == "struct" else F.col(image)
    folder = F.when(F.col(label).cast("string") == "0", "real").when(F.col(label).cast("string") == "1", "fake").otherwise(F.col(label).cast("string"))
    stem = path.rstrip("/").split("/")[-1].removesuffix(".parquet")
    from attestor.operators.ranking import global_row_number

    numbered = global_row_number(rows.withColumn("_at", F.monotonically_increasing_id()), "_at")
    return numbered.select(F.concat(folder, F.lit("/"), F.lit(stem), F.lit("_"), F.lpad((F.col("rn") - 1).cast("string"), 6, "0"), F.lit(".png")).alias("path"), content.alias("content"))


def scan_assets(files: DataFrame, source: str, license_: str, measure=None) -> DataFrame:
    """Manifest rows of files (path, name, content): label rule, scene, hash; ``measure`` maps content to struct(width, height, phash)."""
    rows = files.where(has_asset_suffix(F.col("name")))
    src, kind = F.lit(source), classify(F.lit(source), F.col("path"))
    size = measure(F.col("content")) if measure is not None else F.lit(None).cast("struct<width:int,height:int,phash:string>")
    rows = rows.select(content_hash(F.col("content")).alias("sha256"), src.alias("source"), F.lit(license_).alias("license"), kind.alias("k"), scene_of(src, F.col("path")).alias("scene"), size.alias("m"), "path")
    return rows.select("sha256", "source", "license", "k.label", "k.manipulation", "scene", "m.width", "m.height", "m.phash", "path")


def decode_gray(content: bytes) -> np.ndarray:
    """Gray values 0..255 of a binary PGM or PPM, a plain 8-bit PNG, or a sequential JPEG (its luminance)."""
    if content[:2] == b"\xff\xd8":
        return jpeg.luminance(content)
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            line = content.index(b"\n", at)
            fields += content[at:line].split(b"#")[0].split()
            at = line + 1
        w, h, most = map(int, fields)
        kind = np.uint8 if most < 256 else np.dtype(">u2")
        planes = np.frombuffer(content, dtype=kind, offset=at).reshape(h, w, -1) * (255.0 / most)
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        planes = _png(content)
    else:
        raise ValueError("this image format needs another decoder")
    x = np.rint(planes.astype(np.float64))
    return x[:, :, 0] if x.shape[2] < 3 else np.floor((x[:, :, 0] * 299 + x[:, :, 1] * 587 + x[:, :, 2] * 114) / 1000 + 0.5)


def _png(content: bytes) -> np.ndarray:
    at, data, head = 8, [], b""
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        data += [body] if kind == b"IDAT" else []
        at += 12 + size
    w, h, depth, colour, interlaced = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), head[8], head[9], head[12]
    if depth != 8 or colour not in (0, 2, 4, 6) or interlaced:
        raise ValueError("only plain 8-bit PNG is decoded here")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w, step), dtype=np.uint8), np.zeros((w, step), dtype=np.uint8)
    for y, row in enumerate(raw):
        above = out[y] = _unfilter(row[0], row[1:].reshape(w, step), above)
    return out


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row of a PNG (pixels x channels) from its filtered form; only the last two kinds need a walk along the row."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out, left, corner = np.empty_like(line), np.zeros(line.shape[1], dtype=np.int64), np.zeros(line.shape[1], dtype=np.int64)
    for x, (value, up) in enumerate(zip(line.astype(np.int64), above.astype(np.int64), strict=True)):
        if kind == 3:
            guess = (left + up) // 2
        else:
            far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
            guess = np.choose(far.argmin(axis=0), [left, up, corner])  # the nearest of the three, the first of equals
        left, corner = (value + guess) & 255, up
        out[x] = left
    return out
