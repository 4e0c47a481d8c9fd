"""An FM-index over a sequence of word hashes, in numpy.

Suffixes are sorted by prefix doubling that goes on with unresolved groups
alone. The transformed text (the word before each suffix) is held in a wavelet
matrix: per bit of a symbol, running counts of ones, from which the rank of any
symbol at any place takes one lookup a bit. Backward search narrows a range of
suffixes word by word; a suffix's place is found by stepping back to one whose
place was sampled. All searches run side by side.
"""

from __future__ import annotations

import numpy as np

from ._kernels import U64

#: Most symbols of one index: places fit the low 20 bits of a sort key.
MOST = (1 << 20) - 2
SAMPLE = 8
_LOW = U64((1 << 20) - 1)


def _symbols(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the 1-based number of each word's hash."""
    n = len(words)
    key = np.sort((words & ~_LOW) | np.arange(n, dtype=U64))
    place = (key & _LOW).astype(np.int64)
    full = words[place]
    new = np.concatenate(([True], (key[1:] ^ key[:-1]) > _LOW)) if n else np.empty(0, bool)
    if n and (full[1:] != full[:-1]).sum() != new[1:].sum():  # hashes that differ in their low bits only
        vocab, inverse = np.unique(words, return_inverse=True)
        return vocab, inverse.astype(np.int64) + 1
    out = np.empty(n, np.int64)
    out[place] = np.cumsum(new)
    return full[new], out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order; the end is less than any symbol."""
    n = len(symbols)
    rank, todo, step = None, np.arange(n), 0
    # the rank of a suffix: where its group of equal prefixes begins
    order = np.sort((symbols.astype(U64) << U64(20)) | np.arange(n, dtype=U64))
    at = np.arange(n)
    group = order >> U64(20)
    while True:
        place = (order & _LOW).astype(np.int64)
        first = np.concatenate(([True], group[1:] != group[:-1]))
        start = np.maximum.accumulate(np.where(first, at, 0))
        if rank is None:
            rank = np.empty(n, np.int64)
        rank[place] = start
        last = np.concatenate((first[1:], [True]))
        keep = ~(first & last)
        todo = place[keep]
        if not len(todo):
            break
        step = step * 2 or 1
        after = todo + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        base = rank[todo]
        order = np.sort((base.astype(U64) << U64(41)) | (second.astype(U64) << U64(20)) | todo.astype(U64))
        group = order >> U64(20)
        base = (group >> U64(21)).astype(np.int64)
        own = np.concatenate(([True], base[1:] != base[:-1]))
        at = base + np.arange(len(base)) - np.maximum.accumulate(np.where(own, np.arange(len(base)), 0))
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of documents' words; a separator ends each document."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        n_docs = len(offsets) - 1
        n = len(words) + n_docs
        if n > MOST:
            raise ValueError(f"an index holds {MOST} symbols, not {n}")
        self.vocab, numbers = _symbols(words)
        text = np.zeros(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[offsets[1:] + np.arange(n_docs)] = False
        text[is_word] = numbers
        self.n = n
        suffix = suffix_order(text)
        symbol = text[suffix - 1]  # that of the first suffix wraps to the last separator
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.vocab) + 1))))
        # A step back over a separator is never needed: places after one are sampled too.
        sampled = (suffix % SAMPLE == 0) | (symbol == 0)
        self.sampled, self.samples = np.concatenate(([0], np.cumsum(sampled))).astype(np.int32), suffix[sampled]
        self.symbol = symbol.astype(np.int32)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest = self.symbol
        for bit in reversed(range(max(1, int(len(self.vocab)).bit_length()))):
            one = (rest >> bit) & 1 == 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=count[1:])
            self.levels.append((bit, count, n - int(count[-1])))
            rest = np.concatenate((rest[~one], rest[one]))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 for words that the index doesn't have."""
        if not len(self.vocab):
            return np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at + 1, 0)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, count, zeros in self.levels:
            ones = count[i]
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where suffixes that start with the symbol come, before i of which it stands."""
        return self.before[symbol] + self._down(symbol, i) - self._down(symbol, np.zeros_like(i))

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first, end) of the suffix ranges of patterns that occur.

        patterns: word hashes, a row each, aligned to the right.
        """
        width = patterns.shape[1]
        numbers = self.numbers(patterns)
        inside = np.arange(width)[None, :] >= width - lengths[:, None]
        live = np.flatnonzero((lengths > 0) & ((numbers > 0) | ~inside).all(axis=1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(width - 1, -1, -1):
            on = inside[live, j]
            if on.any():
                c = numbers[live[on], j]
                lo[on], hi[on] = self.step(c, lo[on]), self.step(c, hi[on])
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, by their rows."""
        out, walk, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        row = rows.astype(np.int64)
        while len(walk):
            known = self.sampled[row + 1] > self.sampled[row]
            out[walk[known]] = self.samples[self.sampled[row[known]]] + steps
            walk, row = walk[~known], row[~known]
            row = self.step(self.symbol[row].astype(np.int64), row)
            steps += 1
        return out
