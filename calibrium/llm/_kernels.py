"""Vectorised numpy kernels over UTF-8 buffers of Arrow string columns.

Words are found and hashed straight in the byte buffer, so no Python object is
made per word. Work runs in pieces of a few MB, which bounds memory whatever
the length of one document or the size of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Odd base of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply, as in splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    start = (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK
    return mix(U64(start) + np.arange(1, n + 1, dtype=U64) * U64(_BASE))


def _byte_table() -> np.ndarray:
    """A random number per byte; A-Z share those of a-z."""
    t = stream(7, 256)
    t[65:91] = t[97:123]
    return t


BYTE, CASED = _byte_table(), stream(7, 256)
#: Bytes of words `[^\x20\x09-\x0D]+`: everything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or data is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of at most `limit` bytes, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Pieces of the buffer that end at no word's inside."""
    pos, n = 0, len(buf)
    while pos < n:
        end = min(pos + piece, n)
        if end < n:
            gaps = np.flatnonzero(~is_word[buf[pos:end]])
            cut = pos + int(gaps[-1]) + 1 if len(gaps) else pos
            cut = max(cut, int(offsets[np.searchsorted(offsets, end, "right") - 1]))
            if cut <= pos:  # one word fills the piece: go on to its end
                stop = int(offsets[np.searchsorted(offsets, pos, "right")])
                cut = end
                while cut < stop:
                    gaps = np.flatnonzero(~is_word[buf[cut : min(cut + piece, stop)]])
                    if len(gaps):
                        cut += int(gaps[0])
                        break
                    cut = min(cut + piece, stop)
            end = cut
        yield pos, end
        pos = end


def hash_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and word offsets by document.

    A-Z count as a-z. A word never spans two documents.
    """
    return placed_words(buf, offsets, is_word, piece)[:2]


def placed_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, piece: int = PIECE, table: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hash_words, with the first byte of each word and the byte after it.

    `table` has the number of each byte: CASED tells A-Z from a-z.
    """
    hashes, starts_all, ends_all = [], [], []
    for lo, hi in _cuts(buf, offsets, is_word, piece):
        b = buf[lo:hi]
        w = is_word[b]
        first = w.copy()
        first[1:] &= ~w[:-1]
        own = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[own] = w[own]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        last = w.copy()
        last[:-1] &= ~w[1:]
        ends_at = own[own > 0] - 1
        last[ends_at] = w[ends_at]
        ends = np.flatnonzero(last) + 1
        p, inv = _power_tables(len(b) + 1)
        pre = np.empty(len(b) + 1, U64)
        pre[0] = 0
        np.cumsum(table[b] * p[: len(b)], out=pre[1:])
        h = (pre[ends] - pre[starts]) * inv[starts]
        hashes.append(mix(h ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407))))
        starts_all.append(starts + lo)
        ends_all.append(ends + lo)
    if not hashes:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets), starts, np.concatenate(ends_all)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their offsets by document.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(out_at[-1]), U64)
    q = stream(11, k) | U64(1)
    if len(words) >= k:
        rolled = words[: len(words) - k + 1] * q[0]
        for j in range(1, k):
            rolled += words[j : len(words) - k + 1 + j] * q[j]
        long = n >= k
        keep = np.repeat(long, count)
        shift = np.repeat(offsets[:-1] - out_at[:-1], count)
        src = np.arange(len(out)) + shift
        out[keep] = rolled[src[keep]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        out[out_at[d]] = np.sum(words[offsets[d] : offsets[d + 1]] * q[: n[d]], keepdims=True)[0] ^ U64(int(n[d]) * 0x632BE59BD9B4E019 & _MASK)
    return mix(out), out_at


def as_longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
