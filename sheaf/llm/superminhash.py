"""SuperMinHash signatures of sets of 64-bit values.

Every element draws, position by position, from its own random permutation of
the signature: at step ``j`` it offers ``j + u`` to the position that its
permutation has there.  Values of one element are correlated so that no two of
its offers meet, which lowers the variance against independent hashes.  Once
every position holds a value below ``j``, later steps cannot change any, and the
walk stops; for sets much larger than the signature that is after one or two.
"""

from __future__ import annotations

import numpy as np

from sheaf.llm.common import ODD, mixed

_SPREAD = 2.0**-53


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """Signature of distinct elements; equal at a position for two sets with their Jaccard similarity."""
    best = np.full(size, np.inf)
    n = len(elements)
    if not n:
        return best
    order = None  # permutations, one row an element, made from the second step on
    first = None
    for j in range(size):
        draw = mixed(elements + np.uint64(int(ODD) * (2 * j + 1) % 2**64))
        rank = (draw >> np.uint64(11)).astype(np.float64) * _SPREAD + j
        pick = j + ((mixed(draw ^ ODD) >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            first, place = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.int32), (n, 1))
                rows = np.arange(n)
                order[rows, 0], order[rows, first] = first, 0
            place = order[rows, pick]
            order[rows, pick] = order[rows, j]
            order[rows, j] = place
        np.minimum.at(best, place, rank)
        if best.max() < j + 1:
            break
    return best


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of ``rows`` positions."""
    parts = sig.view(np.uint64).reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * ODD
    for k in range(rows):
        out = mixed(out * ODD + parts[:, k])
    return out
