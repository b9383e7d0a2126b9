"""Hilbert keys of points with small non-negative integer coordinates, vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``points`` (n x dims, values below 2^bits) on the Hilbert curve.

    Works from the highest bit plane to the lowest. In each plane the bits of a cell name an orthant;
    the curve inside an orthant is a mirrored and turned copy of the whole, which is undone on the
    remaining planes by complementing or exchanging coordinates. A Gray code of the planes' bits,
    read plane by plane, is the key.
    """
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            up = (x[:, d] >> plane) & 1 == 1
            x[up, 0] ^= low  # mirrored
            turn = np.where(up, 0, (x[:, 0] ^ x[:, d]) & low)  # turned
            x[:, 0] ^= turn
            x[:, d] ^= turn
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, dtype=np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip[:, None]
    keys = np.zeros(n, dtype=np.int64)
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = keys << 1 | (x[:, d] >> plane & 1)
    return keys
