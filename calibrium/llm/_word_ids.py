"""Token ids of whole batches of texts, word by word, in numpy.

For a tokenizer that lower-cases and then cuts at white space, a text's ids are
those of its spaced words one after the other. Words are told apart by their
64-bit hashes (two of 10**9 words share one with probability 0.03), so a word is
taken out of the text and encoded only when it is met first; what a batch needs
else are gathers. Texts that may hold the name of a special token, whose case
counts, are encoded by the library itself.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable

import numpy as np
import pandas as pd

from ._kernels import SPACED, U64, groups, placed_words

#: Distinct words whose ids a worker remembers at once; a bound on memory alone, 30 bytes a word.
REMEMBERED = 3_000_000
#: What names of special tokens begin with.
SPECIAL = b"<|"


class Remembered:
    """The ids of the words met so far, found by hash; a subclass encodes the others."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.lengths = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """hashes: ascending, not known yet."""
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        more = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        starts = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + len(more)] = more
        self.used += len(more)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.lengths = np.insert(self.hashes, at, hashes), np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at

    def gather(self, hashes: np.ndarray, encode: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by word) of words by their hashes; encode(places) gives those of words at some places."""
        codes, kinds = pd.factorize(hashes)
        if len(kinds) == 0:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if len(self.hashes) + len(kinds) > REMEMBERED:
            self._forget()
        order = np.argsort(kinds)
        ranked = kinds[order]
        fresh = self.hashes[self._found(ranked)] != ranked if len(self.hashes) else np.ones(len(ranked), bool)
        if fresh.any():
            top = np.maximum.accumulate(codes)
            met = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))[order[fresh]]
            self._learn(ranked[fresh], encode(met))
        at = np.empty(len(kinds), np.int64)
        at[order] = self._found(ranked)
        starts, lengths = self.starts[at][codes], self.lengths[at][codes]
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        return self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


class WordIds(Remembered):
    """Words of a tokenizer that lower-cases and cuts at white space."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self._encode = getattr(t, "encode_batch_fast", t.encode_batch)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts of UTF-8 bytes."""
        hashes, word_at, first, end = placed_words(buf, offsets, SPACED)

        def words(at: np.ndarray) -> list[list[int]]:
            text = buf.tobytes()
            return [e.ids for e in self._encode([text[x:y].lower().decode() for x, y in zip(first[at].tolist(), end[at].tolist())], add_special_tokens=False)]

        ids, ends = self.gather(hashes, words)
        return ids, ends[word_at]

    def encode_all(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, a few MB at a time, texts with names of special tokens by the library."""
        parts, sizes = [], []
        for lo, hi in groups(offsets):
            own, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            ids, at = self.encode(own, off)
            counts = np.diff(at)
            if SPECIAL in (text := own.tobytes()):
                rows = [ids[x:y] for x, y in zip(at[:-1], at[1:])]
                for d in range(hi - lo):
                    if SPECIAL in (t := text[off[d] : off[d + 1]]):
                        rows[d] = np.array([i for e in self._encode([w.decode() for w in t.split()], add_special_tokens=False) for i in e.ids], np.uint32)
                ids, counts = np.concatenate(rows), np.array(list(map(len, rows)), np.int64)
            parts.append(ids)
            sizes.append(counts)
        return np.concatenate([*parts, np.empty(0, np.uint32)]), np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)])))).astype(np.int64)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
