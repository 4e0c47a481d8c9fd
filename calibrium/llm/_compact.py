"""Compact windows of shingle sequences, in numpy.

For one hash function, all subsequences whose least hash stands at place c and
that are long enough form a compact window (l, c, r): those that begin in
l..c and end in c..r. The windows are the nodes of the Cartesian tree of the
hashes; l and r are bounded by the nearest smaller hashes on either side. Only
places that are the minimum of some subsequence of the least length matter,
and sliding minima give those; their bounds come from a descent over minima of
blocks of 1, 2, 4, ... places, up to `REACH` places to either side. A longer
passage holds shorter ones, so nothing is lost by that bound.

Everything is linear in the length of the shingles, periodic texts included.
"""

from __future__ import annotations

import numpy as np

from ._kernels import U64, mix, stream

#: Places fit the low 20 bits of a hash's order key.
MOST = 1 << 20
_LOW = U64(MOST - 1)
#: Farthest bound of a window from its minimum; it fits a byte.
REACH = 255
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the odd base of sequence hashes, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def stretch_hashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` shingles from each place on, wherever that many follow."""
    n = max(0, len(shingles) - width + 1)
    if not n:
        return np.empty(0, U64)
    p, inverse = powers(len(shingles))
    before = np.zeros(len(shingles) + 1, U64)
    np.cumsum(shingles * p[: len(shingles)], out=before[1:])
    return mix((before[width:] - before[:n]) * inverse[:n])


def order_keys(shingles: np.ndarray, real: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """Hash by one function and place, in one number; 0 between documents."""
    return np.where(real, ((shingles * multiplier) | U64(1 << 63)) & ~_LOW | np.arange(len(shingles), dtype=U64), U64(0))


def block_minima(key: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of 2**k places from each place on, as far as `longest`."""
    out, step = [key], 1
    while step <= longest:
        last = out[-1]
        nxt = np.empty_like(last)
        np.minimum(last[:-step], last[step:], out=nxt[:-step])
        nxt[-step:] = 0
        out.append(nxt)
        step *= 2
    return out


def sliding_minima(minima: list[np.ndarray], least: int) -> np.ndarray:
    """Least key of the `least` places from each place on; 0 over an end of a document."""
    k = least.bit_length() - 1
    span, rest, n = minima[k], least - (1 << k), len(minima[0])
    return np.minimum(span[: n - least + 1], span[rest : n - least + 1 + rest])


def places(minimum: np.ndarray) -> np.ndarray:
    """Places of sliding minima that are not 0, each once, ascending."""
    kept = minimum[np.concatenate(([0], np.flatnonzero(minimum[1:] != minimum[:-1]) + 1))]
    return (kept[kept > 0] & _LOW).astype(np.int64)


def windows(key: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all compact windows at least `least` wide. key starts and ends with 0.

    l and r are bounded by the longest blocks of minima: REACH for `longest` half of that.
    """
    if len(key) < least:
        return (np.empty(0, np.int64),) * 3
    minima = block_minima(key, max(longest, least))
    c = places(sliding_minima(minima, least))
    own, n = key[c], len(key)
    right, left = c + 1, c - 1
    for j in range(len(minima) - 1, -1, -1):
        step = 1 << j
        go = (right + step <= n) & (minima[j][np.minimum(right, n - 1)] > own)
        right = np.where(go, right + step, right)
        at = left - step + 1
        go = (at >= 0) & (minima[j][np.maximum(at, 0)] > own)
        left = np.where(go, left - step, left)
    return c, left + 1, right - 1


def multipliers(functions: int) -> np.ndarray:
    return stream(41, functions) | U64(1)
