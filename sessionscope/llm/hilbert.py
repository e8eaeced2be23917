"""Keys along a Hilbert curve through a cube of any dimension."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of ``cells`` (integers below ``2**bits``).

    Walks from the coarsest bit to the finest.  At each one the sub-cube's place in the
    reflected Gray order is the next digit of the key, and the axes are then turned so
    that the sub-cube's own curve starts where the last one ended.
    """
    n, dims = cells.shape
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for axis in range(dims):
            high = (x[axis] & bit) != 0
            x[0] = np.where(high, x[0] ^ low, x[0])
            swap = np.where(high, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= swap
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(n, dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip = np.where((x[dims - 1] & bit) != 0, flip ^ (bit - one), flip)
    x ^= flip
    key = np.zeros(n, dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)
