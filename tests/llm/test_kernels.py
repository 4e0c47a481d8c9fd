"""Numpy kernels against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from calibrium.llm import _kernels as K
from calibrium.llm._compact import order_keys, windows
from calibrium.llm._fm_index import FMIndex, suffix_order
from calibrium.llm.token_files import pack, unpack

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ z\t\n\x0b1.,é日-", max_size=40)), max_size=6)


def lower(b: bytes) -> bytes:
    return b.lower()


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_are_those_of_the_pattern(texts, piece):
    buf, off = K.utf8(pa.array(texts, pa.string()))
    for table, pattern in ((K.SPACED, rb"[^\x20\x09-\x0D]+"), (K.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, at = K.hash_words(buf, off, table, piece)
        want = [re.findall(pattern, lower((t or "").encode())) for t in texts]
        assert np.diff(at).tolist() == [len(w) for w in want]
        flat = [w for d in want for w in d]
        pairs = dict(zip(flat, hashes.tolist()))
        assert [pairs[w] for w in flat] == hashes.tolist() and len(set(pairs.values())) == len(pairs)


def test_sliced_and_null_columns():
    col = pa.array(["x y", None, "z"]).slice(1)
    buf, off = K.utf8(col)
    assert buf.tobytes() == b"z" and off.tolist() == [0, 0, 1]
    assert K.utf8(pa.array([], pa.string()))[1].tolist() == [0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=5))
def test_shingles_are_equal_where_their_words_are(docs):
    words = K.stream(1, 4)
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    flat = np.array([words[x] for d in docs for x in d], np.uint64)
    sh, at = K.shingle_hashes(flat, off, 3)
    want = [[tuple(d[i : i + 3]) for i in range(len(d) - 2)] if len(d) >= 3 else [tuple(d)] if d else [] for d in docs]
    assert np.diff(at).tolist() == [len(w) for w in want]
    pairs = dict(zip([x for w in want for x in w], sh.tolist()))
    assert [pairs[x] for w in want for x in w] == sh.tolist() and len(set(pairs.values())) == len(pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_suffix_order(symbols):
    s = np.array(symbols, np.int64)
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all_occurrences(docs, patterns):
    names = K.stream(2, 5)
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    index = FMIndex(np.array([names[x] for d in docs for x in d], np.uint64), off)
    rows = np.zeros((len(patterns), 4), np.uint64)
    for i, p in enumerate(patterns):
        rows[i, 4 - len(p) :] = names[p]
    which, lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    found = {(int(w), int(x)) for w, a, b in zip(which, lo, hi) for x in index.locate(np.arange(a, b))}
    starts = [int(o) + i for i, o in enumerate(off[:-1])]
    want = {(k, starts[i] + j) for k, p in enumerate(patterns) for i, d in enumerate(docs) for j in range(len(d) - len(p) + 1) if d[j : j + len(p)] == p}
    assert found == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 6))
def test_compact_windows_are_the_wide_nodes(values, least):
    sh = np.concatenate(([0], K.mix(np.array(values, np.uint64)), [0])).astype(np.uint64)
    real = np.ones(len(sh), bool)
    real[[0, -1]] = False
    key = order_keys(sh, real, np.uint64(3))
    got = {(int(a), int(b), int(c)) for a, b, c in zip(*windows(key, len(values), least))}
    want = set()
    for c in range(1, len(sh) - 1):
        left = right = c
        while key[left - 1] > key[c]:
            left -= 1
        while key[right + 1] > key[c]:
            right += 1
        if right - left + 1 >= least:
            want.add((c, left, right))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bit_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert unpack(packed, len(ids), bits).tolist() == ids.tolist()
