"""Sequential JPEG: luminance of an image, and the quality that its quantisation table tells of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attestor.operators.kernels import LUMINANCE, _cosines

#: Places of an 8 x 8 block in the order of a file: along the diagonals, in turns up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) * (1 if (k // 8 + k % 8) % 2 else -1))))


def segments(content: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, body, end) of a file's segments up to the start of the scan."""
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("not a JPEG")
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
        if marker == 0xFF:
            at += 1
            continue
        yield marker, content[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def _tables(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(number, 8 x 8 table in natural order) of a segment of quantisation tables."""
    at = 0
    while at < len(body):
        wide, number = body[at] >> 4, body[at] & 15
        size = 128 if wide else 64
        out = np.empty(64, dtype=np.int64)
        out[ZIGZAG] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=at + 1)
        yield number, out
        at += 1 + size


def quality(content: bytes) -> float:
    """Quality estimate: mean scale s of the luminance table against the standard one, 5000 / s above 100, else 100 - s / 2; NaN where there is none."""
    try:
        table = next((t for marker, body, _ in segments(content) if marker == 0xDB for number, t in _tables(body) if number == 0), None) if content[:2] == b"\xff\xd8" else None
    except (ValueError, IndexError):
        table = None
    if table is None:
        return float("nan")
    scale = float(np.mean(100 * table / np.array(LUMINANCE)))
    return 5000 / scale if scale > 100 else 100 - scale / 2


@F.pandas_udf(DoubleType())
def quality_of(contents: pd.Series) -> pd.Series:
    """quality() as a column function over files' contents; null where there is no table."""
    return pd.Series([quality(bytes(c)) if c is not None else float("nan") for c in contents], dtype="float64")


class _Codes:
    """A table of Huffman codes, by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.symbol[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


class _Bits:
    """Bits of one stretch of a scan; ones stand beyond its end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for k in range(self.at, self.at + n):
            value = value << 1 | (self.bits[k] if k < len(self.bits) else 1)
        self.at += n
        return value

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.symbol.get((length, code))) is not None:
                return found
        raise ValueError("damaged JPEG")

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: _Codes, ac: _Codes, before: int) -> np.ndarray:
    out, k = np.zeros(64, dtype=np.int64), 1
    out[0] = before + bits.number(bits.symbol(dc))
    while k < 64:
        both = bits.symbol(ac)
        if both == 0:
            break
        k += both >> 4
        if both & 15 and k < 64:
            out[ZIGZAG[k]] = bits.number(both & 15)
        k += 1
    return out


def _stretches(scan: bytes) -> list[bytes]:
    """The scan's data between restart marks."""
    out, at, begin = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[begin:at])
            begin = at + 2
        elif scan[at + 1] not in (0, 0xFF):
            return [*out, scan[begin:at]]
        at += 2 if scan[at + 1] != 0xFF else 1
    return [*out, scan[begin:]]


def luminance(content: bytes) -> np.ndarray:
    """Gray values 0..255 of the first component of a sequential (baseline or extended) Huffman-coded JPEG."""
    quantised, codes, parts, restart = {}, {}, {}, 0
    for marker, body, end in segments(content):
        if marker == 0xDB:
            quantised |= dict(_tables(body))
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                codes[body[at]] = _Codes(counts, body[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2])
        elif marker in (0xC0, 0xC1):
            depth, h, w = body[0], int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only sequential JPEG is decoded here")
        elif marker == 0xDA:
            order = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            scan = content[end:]
    if not parts or depth != 8 or len(order) != len(parts):
        raise ValueError("only sequential 8-bit JPEG in one scan is decoded here")
    first = next(iter(parts))
    most_x, most_y = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(parts) == 1:
        parts, most_x, most_y = {first: (1, 1, parts[first][2])}, 1, 1
    per_x, per_y = parts[first][:2]
    if (per_x, per_y) != (most_x, most_y):
        raise ValueError("a luminance of lower resolution is not decoded here")
    across, down = -(-w // (8 * most_x)), -(-h // (8 * most_y))
    blocks = np.zeros((down * per_y, across * per_x, 64), dtype=np.int64)
    unit, stretches = 0, iter(_stretches(scan))
    bits, before = None, {}
    for unit in range(across * down):
        if bits is None or restart and unit % restart == 0:
            bits, before = _Bits(next(stretches)), dict.fromkeys(parts, 0)
        for name, dc, ac in order:
            nx, ny, _ = parts[name]
            for k in range(nx * ny):
                block = _block(bits, codes[dc], codes[16 + ac], before[name])
                before[name] = int(block[0])
                if name == first:
                    blocks[unit // across * ny + k // nx, unit % across * nx + k % nx] = block
    c = _cosines()
    values = c.T @ (blocks * quantised[parts[first][2]]).reshape(*blocks.shape[:2], 8, 8).astype(np.float64) @ c + 128
    return np.clip(np.rint(values.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)), 0, 255)[:h, :w]
