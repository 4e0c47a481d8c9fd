"""Equal and near-duplicate stretches of two shingle sequences, in numpy.

A stretch of b whose shingles nearly all occur in a is a chain of equal runs.
Runs are found at once for a batch of pairs; the chains of one pair are all
intervals of its runs, of which those long and similar enough count.
"""

from __future__ import annotations

import numpy as np

from ._kernels import U64, mix

#: Cells of the table of intervals that are worked on together, a bound on memory.
CELLS = 1 << 18


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def keyed(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Values told apart by group."""
    return mix(values + group.astype(U64) * U64(0x9E3779B97F4A7C15))


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of True and the places behind them."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def aligned(anchor: np.ndarray, own: np.ndarray, own_group: np.ndarray, anchor_group: np.ndarray) -> np.ndarray:
    """For each place of `own` a place of an equal element of its group's anchor, or -1.

    Elements are (sequence, group); groups are dealt to ascending ranges of
    both. Of several places the one is taken that continues the nearest sure
    match before it, or the first.
    """
    a, b = keyed(anchor, anchor_group), keyed(own, own_group)
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    first = np.searchsorted(ranked, b)
    hit = first < len(ranked)
    hit[hit] = ranked[first[hit]] == b[hit]
    out = np.full(len(b), -1)
    at = np.flatnonzero(hit)
    if not len(at):
        return out
    lo = first[at]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    rank = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(ranked)]))))
    last = np.concatenate((starts[1:], [len(ranked)]))[rank[lo]] - 1
    sure = lo == last
    out[at] = order[lo]
    if not sure.all():
        # the diagonal of the last sure match of the same group
        seen = np.where(sure, np.arange(len(at)), -1)
        seen = np.maximum.accumulate(seen)
        known = (seen >= 0) & (own_group[at[np.maximum(seen, 0)]] == own_group[at])
        nxt = np.where(sure, np.arange(len(at)), len(at))[::-1]
        nxt = np.minimum.accumulate(nxt)[::-1]
        back = ~known & (nxt < len(at))
        back[back] = own_group[at[nxt[back]]] == own_group[at[back]]
        base = np.where(known, np.maximum(seen, 0), np.where(back, np.minimum(nxt, len(at) - 1), 0))
        aim = np.where(known | back, out[at[base]] + at - at[base], out[at])
        width = len(a) + 1
        line = rank * width + order
        many = np.flatnonzero(~sure)
        upper = np.searchsorted(line, rank[lo[many]] * width + np.clip(aim[many], 0, len(a) - 1))
        above, below = np.clip(upper, lo[many], last[many]), np.clip(upper - 1, lo[many], last[many])
        far, near = order[above], order[below]
        out[at[many]] = np.where(np.abs(far - aim[many]) <= np.abs(near - aim[many]), far, near)
    return out


def runs(match: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, matched place) of runs of consecutive matches in one group."""
    hit = match >= 0
    goes = np.zeros(len(match), bool)
    goes[1:] = hit[1:] & hit[:-1] & (match[1:] == match[:-1] + 1) & (group[1:] == group[:-1])
    first = np.flatnonzero(hit & ~goes)
    if not len(first):
        return (np.empty(0, np.int64),) * 3
    ends = np.flatnonzero(hit & ~np.concatenate((goes[1:], [False]))) + 1
    return first, ends - first, match[first]


def before(sequence: np.ndarray) -> np.ndarray:
    """For each place the last place before it with the same element, or -1."""
    order = np.argsort(sequence, kind="stable")
    out = np.full(len(sequence), -1)
    same = sequence[order[1:]] == sequence[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


class Pair:
    """The runs of one pair of sequences, and how similar intervals of them are."""

    def __init__(self, first: np.ndarray, length: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.first, self.end, self.other, self.over, self.a, self.b = first, first + length, other, other + length, a, b
        self.total = np.concatenate(([0], np.cumsum(length)))
        self.hits: np.ndarray | None = None

    def table(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """For runs lo..hi as the first and all from lo on as the last: whether that is
        an interval, its places in b, the shared ones, the first and last place in a."""
        later = np.arange(lo, len(self.first))[None, :] >= np.arange(lo, hi)[:, None]
        shared = self.total[None, lo + 1 :] - self.total[lo:hi, None]
        wide = self.end[None, lo:] - self.first[lo:hi, None]
        from_a = np.minimum.accumulate(np.where(later, self.other[None, lo:], 1 << 60), axis=1)
        to_a = np.maximum.accumulate(np.where(later, self.over[None, lo:], -1), axis=1)
        return later, wide, shared, from_a, to_a

    def similar(self, x: int, y: int, p: int, q: int, least: float) -> bool:
        s, t = np.unique(self.b[x:y]), np.unique(self.a[p:q])
        same = int(member(s, t).sum())
        return same >= least * (len(s) + len(t) - same)

    def distinct(self, i: int, ends: np.ndarray, from_a: np.ndarray, to_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of b, shared ones, and those of a, for intervals from run i to
        places `ends`; of a, where the interval begins elsewhere in a, no more than the shared."""
        if self.hits is None:
            self.hits = np.zeros(len(self.b), bool)
            for x, y in zip(self.first, self.end):
                self.hits[x:y] = True
            self.before_a, self.before_b = before(self.a), before(self.b)
        x, p = self.first[i], self.other[i]
        new = self.before_b[x : ends[-1]] < x
        of_b, shared = np.cumsum(new)[ends - x - 1], np.cumsum(new & self.hits[x : ends[-1]])[ends - x - 1]
        of_a = np.cumsum(self.before_a[p : to_a.max()] < p)[to_a - p - 1]
        return of_b, shared, np.where(from_a == p, np.maximum(of_a, shared), shared)


def chains(first: np.ndarray, length: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, similar: float) -> list[tuple[int, int, int, int]]:
    """Near-duplicate stretches (b's [x, y), a's [p, q)) made of one pair's runs.

    All intervals of runs are weighed by their lengths; of those that may be
    similar enough the longest from each first run are measured on their sets
    of shingles, and shorter ones where these fall short. None lies in another.
    """
    pair, out, reached = Pair(first, length, other, a, b), [], -1
    hi = 0
    while hi < len(first):
        lo, hi = hi, min(len(first), hi + max(1, CELLS // (len(first) - hi)))
        later, wide_b, shared, from_a, to_a = pair.table(lo, hi)
        wide_a = to_a - from_a
        both = np.minimum(shared, np.minimum(wide_a, wide_b))
        ok = later & (wide_b >= least) & (wide_a >= least) & (both >= similar * (wide_a + wide_b - both))
        for i in np.flatnonzero(ok.any(axis=1)):
            js, counted = np.flatnonzero(ok[i]), False
            while len(js) and lo + js[-1] > reached:
                j = js[-1]
                x, y, p, q = int(first[lo + i]), int(pair.end[lo + j]), int(from_a[i, j]), int(to_a[i, j])
                if y - x == length[lo + i] or pair.similar(x, y, p, q, similar):
                    out.append((x, y, p, q))
                    reached = lo + j
                    break
                js = js[:-1]
                if not counted and len(js):  # shingles repeat: leave those that their distinct ones rule out
                    of_b, same, of_a = pair.distinct(lo + i, pair.end[lo + js], from_a[i, js], to_a[i, js])
                    js, counted = js[same >= similar * (of_b + of_a - same)], True
    return out
