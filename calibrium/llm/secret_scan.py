"""Secret scans: rules, and a character convolutional network over candidates (op12).

Three rules give the base findings of a text. Every run of `LEAST` or more token
characters is a candidate; its window is the bytes before it, its own bytes
(long ones in pieces, all of them) and the bytes after it. The network embeds
bytes, convolves the window, pools inside and around the candidate and gives a
probability for each kind of finding. It is trained in numpy on all distinct
windows (of each candidate's first piece), labelled by the base findings; for
some of them the context is blanked, so that a secret is known without its
keyword. A fifth of the windows, by their keys, calibrates: it sets the scale of
each kind's scores and the kind's threshold, the highest that still finds
`RECALL` of the labelled findings. Candidates apart from all base findings that
reach a threshold are added.

Up to `TOGETHER` windows are learned in one piece. More are dealt by key to
parts; in each of `ROUNDS` rounds every part goes on from the same network over
its own share of the windows, and the networks are averaged by windows. Counts
of scores by level then calibrate, so no window is left out at any size.

Texts are read once. Each document's findings and windows are a row of a written
table; nothing is shuffled but the windows to learn from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import groups, mix, stream, utf8
from ._shared import Tables, small_batches

#: Kinds in the order that decides between equal starts; the network's additions come last.
KINDS, ADDED = ("assign", "access", "hex"), "model"
#: Fixed patterns of the rules; an assigned value has 6 characters or more.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX, LEAST_VALUE = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}"), 6
#: Texts that may hold a finding at all, told by one automaton without a Python object a text.
_MAYBE = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"

#: Characters of a candidate at least; bytes of a window: before, of the candidate, after.
LEAST, BEFORE, OWN, AFTER = 12, 16, 40, 16
WIDE = BEFORE + OWN + AFTER
#: The fewest findings a kind is learned from.
LEAST_FINDINGS = 20
#: Windows that are learned in one piece; windows of a part in a round, and most parts; rounds; rounds of one pass over all windows.
TOGETHER, PART, MOST_PARTS, ROUNDS, SLOTS = 32_768, 16_384, 256, 8, 4
#: Where a part learns, each stratum (three kinds, other candidates with and without digit) counts alike, a window at most this many times the mean.
MOST_WEIGHT = 50.0
#: Levels of log odds that scores are counted by: their width, and the end of both sides.
LEVEL, FAR = 1 / 32, 28.0
#: Sizes of the network: embedding, reach, filters, hidden units; training; recall of the thresholds.
EMBED, REACH, FILTERS, HIDDEN, EPOCHS, RATE, BATCH, BLANKED, SEED = 8, 5, 16, 16, 8, 0.01, 64, 0.25, 12
RECALL = 0.98

TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_KEYS = stream(SEED, WIDE) | np.uint64(1)

#: A document's row: base findings, candidates (code points), their strata and labels (a bit a kind), pieces and windows.
ROW = "doc_id long, base array<string>, n array<int>, starts array<int>, ends array<int>, strata array<int>, labels array<int>, pieces array<int>, windows binary"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), k, m.end()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(out)


def _candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of all runs of LEAST or more token characters; none spans two documents."""
    w = TOKEN[buf]
    own = off[:-1][off[:-1] < len(buf)]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    first[own] = w[own]
    last[:-1] &= ~w[1:]
    last[own[own > 0] - 1] = w[own[own > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= LEAST
    return starts[long], ends[long]


def _windows(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of pieces [starts, ends) of documents [lo, hi); bytes that are not there are 0."""
    at = np.arange(WIDE)[None, :] - BEFORE + starts[:, None]
    own = (ends - starts)[:, None]
    place = np.arange(WIDE)[None, :] - BEFORE
    at = np.where(place >= OWN, ends[:, None] + place - OWN, at)
    real = (at >= lo[:, None]) & (at < hi[:, None]) & ((place < own) | (place >= OWN))
    return np.where(real, buf[np.clip(at, 0, max(len(buf) - 1, 0))], 0).astype(np.uint8)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to rows of ROW."""
    for batch in batches:
        buf_all, off_all = utf8(batch.column(1))
        maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), _MAYBE), False).to_numpy(zero_copy_only=False)
        for i, j in groups(off_all):
            buf, off = buf_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            starts, ends = _candidates(buf, off)
            point = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            doc = np.searchsorted(off, starts, "right") - 1
            shift = point[off[doc]] if len(doc) else doc
            first, end = point[starts] - shift, point[ends] - shift
            labels = np.zeros(len(starts), np.int64)
            named, tally = [], []
            for d in range(j - i):
                found = base_findings(batch.column(1)[i + d].as_py()) if maybe[i + d] else []
                named.append([f"{KINDS[k]}:{s}:{e}" for s, k, e in found])
                tally.append([sum(k == x for _, k, _ in found) for x in range(len(KINDS))])
                if found:
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    for s, k, e in found:
                        labels[own] |= ((first[own] < e) & (end[own] > s)) << k
            digit = np.concatenate(([0], np.cumsum((buf >= 48) & (buf <= 57))))
            strata = np.where(labels & 2, 1, np.where(labels & 4, 2, np.where(labels & 1, 0, np.where(digit[ends] > digit[starts], 3, 4))))
            pieces = -(-(ends - starts) // OWN)
            of = np.repeat(np.arange(len(starts)), pieces)
            step = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * OWN
            s = starts[of] + step
            made = _windows(buf, off[doc[of]], off[doc[of] + 1], s, np.minimum(s + OWN, ends[of]))
            cuts, upto = np.searchsorted(doc, np.arange(j - i + 1)), np.concatenate(([0], np.cumsum(pieces)))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).slice(i, j - i), "base": pa.array(named, pa.list_(pa.string())), "n": pa.array(tally, pa.list_(pa.int32())),
                    "starts": lists(first), "ends": lists(end), "strata": lists(strata), "labels": lists(labels), "pieces": lists(pieces),
                    "windows": pa.array([made[upto[a] : upto[b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                }
            )


class Model(NamedTuple):
    """Embedding and filters as one table for each place of the reach, inside weights, and two dense layers."""

    table: np.ndarray  # (REACH, 256, FILTERS)
    inside: np.ndarray  # (REACH, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: np.ndarray  # of each kind's scores
    shift: np.ndarray
    thresholds: np.ndarray  # infinite for a kind that is not learned


def _inside(x: np.ndarray) -> np.ndarray:
    """Whether a byte of a window is the candidate's: token characters hold no byte 0."""
    own = np.zeros(x.shape, bool)
    own[:, BEFORE : BEFORE + OWN] = x[:, BEFORE : BEFORE + OWN] != 0
    return own


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (REACH // 2, REACH // 2)))


def _pooled(r: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest and mean response inside, largest around; responses are 0 or more."""
    inner = r * own[:, :, None]
    outer = r - inner
    features = np.concatenate((inner.max(axis=1), inner.sum(axis=1) / np.maximum(own.sum(axis=1), 1)[:, None], outer.max(axis=1)), axis=1)
    return features, inner, outer


def scores(model: Model, x: np.ndarray, block: int = 2048) -> np.ndarray:
    """Calibrated probabilities (windows, kinds) of windows (n, WIDE)."""
    out = np.zeros((len(x), len(KINDS)))
    for at in range(0, len(x), block):
        own = _inside(x[at : at + block])
        xp, op = _padded(x[at : at + block]), _padded(own).astype(np.float32)
        r = np.broadcast_to(model.bias, (*own.shape, FILTERS)).copy()
        for o in range(REACH):
            r += model.table[o][xp[:, o : o + WIDE]]
            r += op[:, o : o + WIDE, None] * model.inside[o]
        features, _, _ = _pooled(np.maximum(r, 0), own)
        z = np.maximum(features @ model.hidden + model.hidden_bias, 0) @ model.out + model.out_bias
        out[at : at + block] = 1 / (1 + np.exp(-np.clip(z * model.scale + model.shift, -60, 60)))
    return out


class _Network:
    """The network while it is trained: forward and backward passes, and Adam."""

    def __init__(self, rng: np.random.Generator):
        g = lambda *s: (rng.normal(size=s) * (2 / np.prod(s[:-1])) ** 0.5).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        self.p = {"embed": rng.normal(size=(256, EMBED)).astype(np.float32) * 0.5, "filters": g(REACH, EMBED, FILTERS), "inside": zero(REACH, FILTERS), "bias": zero(FILTERS), "hidden": g(3 * FILTERS, HIDDEN), "hidden_bias": zero(HIDDEN), "out": g(HIDDEN, len(KINDS)), "out_bias": zero(len(KINDS))}
        self.m, self.v, self.t = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, weight: np.ndarray | None = None) -> None:
        p, n = self.p, len(x)
        own = _inside(x)
        xp, op = _padded(x), _padded(own).astype(np.float32)
        e = p["embed"][xp]
        r = p["bias"] + sum(e[:, o : o + WIDE] @ p["filters"][o] + op[:, o : o + WIDE, None] * p["inside"][o] for o in range(REACH))
        r = np.maximum(r, 0)
        f, inner, outer = _pooled(r, own)
        h = np.maximum(f @ p["hidden"] + p["hidden_bias"], 0)
        dz = (1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_bias"], -60, 60))) - y) / n
        if weight is not None:
            dz *= weight[:, None]
        dh = (dz @ p["out"].T) * (h > 0)
        df = dh @ p["hidden"].T
        dr = own[:, :, None] * (df[:, None, FILTERS : 2 * FILTERS] / np.maximum(own.sum(axis=1), 1)[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for part, at in ((inner, 0), (outer, 2 * FILTERS)):
            dr[rows, part.argmax(axis=1), cols] += df[:, at : at + FILTERS]
        dr *= r > 0
        de, flat = np.zeros_like(e), dr.reshape(-1, FILTERS)
        grads = {"bias": flat.sum(axis=0), "hidden": f.T @ dh, "hidden_bias": dh.sum(axis=0), "out": h.T @ dz, "out_bias": dz.sum(axis=0)}
        grads["filters"] = np.stack([e[:, o : o + WIDE].reshape(-1, EMBED).T @ flat for o in range(REACH)])
        grads["inside"] = np.stack([op[:, o : o + WIDE].reshape(-1) @ flat for o in range(REACH)])
        for o in range(REACH):
            de[:, o : o + WIDE] += dr @ p["filters"][o].T
        grads["embed"] = np.stack([np.bincount(xp.ravel(), de[:, :, k].ravel(), 256) for k in range(EMBED)], axis=1)
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)

    def state(self) -> np.ndarray:
        return np.concatenate([d[k].ravel().astype(np.float64) for d in (self.p, self.m, self.v) for k in self.p])

    def resumed(self, state: np.ndarray, t: int) -> _Network:
        at, self.t = 0, t
        for d, kind in ((self.p, np.float32), (self.m, np.float64), (self.v, np.float64)):
            for k, old in self.p.items():
                d[k] = state[at : at + old.size].reshape(old.shape).astype(kind)
                at += old.size
        return self

    def learn(self, x: np.ndarray, y: np.ndarray, rate: float, rng: np.random.Generator, weight: np.ndarray | None = None) -> None:
        """A step for each BATCH of rows; the context of some is blanked."""
        for at in range(0, len(x), BATCH):
            own = x[at : at + BATCH].copy()
            blank = rng.random(len(own)) < BLANKED
            own[blank, :BEFORE] = 0
            own[blank, BEFORE + OWN :] = 0
            self.step(own, y[at : at + BATCH], rate, None if weight is None else weight[at : at + BATCH])

    def model(self) -> Model:
        p, k = self.p, len(KINDS)
        table = np.stack([p["embed"] @ w for w in p["filters"]])
        return Model(table, p["inside"], p["bias"], p["hidden"], p["hidden_bias"], p["out"], p["out_bias"], np.ones(k), np.zeros(k), np.full(k, np.inf))


def _bits(labels: np.ndarray) -> np.ndarray:
    return np.stack([(labels >> k) & 1 for k in range(len(KINDS))], axis=1)


def train(x: np.ndarray, labels: np.ndarray) -> Model | None:
    """A model of windows and their labels (a bit a kind); none if no kind has LEAST_FINDINGS of them."""
    y = _bits(labels)
    learned = y.sum(axis=0) >= LEAST_FINDINGS
    if not learned.any():
        return None
    rng = np.random.default_rng(SEED)
    held = rng.permutation(len(x)) % 5 == 4
    fitted, net = np.flatnonzero(~held), _Network(rng)
    for epoch in range(EPOCHS):
        order = rng.permutation(fitted)
        net.learn(x[order], y[order], RATE * (1 - epoch / EPOCHS), rng)
    model = net.model()
    p = np.clip(scores(model, x[held]), 1e-12, 1 - 1e-12)
    z, t = np.log(p / (1 - p)), y[held]
    scale, shift, limits = np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), np.inf)
    for k in np.flatnonzero(learned):
        grid = [(a, b) for a in 2.0 ** np.arange(-4, 2, 0.5) for b in np.arange(-4, 4.5, 0.5)]
        loss = [np.logaddexp(0, np.where(t[:, k] == 1, -1, 1) * (a * z[:, k] + b)).mean() for a, b in grid]
        scale[k], shift[k] = grid[int(np.argmin(loss))]
        right = np.sort(1 / (1 + np.exp(-(scale[k] * z[:, k] + shift[k])))[t[:, k] == 1])
        if len(right):
            limits[k] = right[int((1 - RECALL) * len(right))]
    return model._replace(scale=scale, shift=shift, thresholds=limits)


def _first_pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, keys, strata, labels) of the first piece of every candidate of some rows."""
    flat = lambda c: batch.column(batch.schema.names.index(c)).flatten().to_numpy()
    data = b"".join(v.as_py() for v in batch.column(batch.schema.names.index("windows")))
    pieces = flat("pieces")
    x = np.frombuffer(data, np.uint8).reshape(-1, WIDE)[np.cumsum(pieces) - pieces]
    return x, mix((x.astype(np.uint64) * _KEYS).sum(axis=1, dtype=np.uint64)), flat("strata"), flat("labels")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, keys, strata, labels = _first_pieces(batch)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "stratum": pa.array(strata, pa.int32()), "label": pa.array(labels, pa.int32()), "x": pa.array([w.tobytes() for w in x], pa.binary())})


def _matrix(windows) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in windows), np.uint8).reshape(-1, WIDE)


def _part(state: np.ndarray, t: int, turn: int, weights: np.ndarray):
    """Windows of a part to the network that goes on from `state` over them."""

    def run(own: pa.Table) -> pa.Table:
        keys = own.column("key").to_numpy()
        rng = np.random.default_rng([SEED, turn, int(own.column("part")[0].as_py())])
        order = np.argsort(keys)[rng.permutation(len(keys))]  # the same at any partitioning
        net = _Network(rng).resumed(state, t)
        net.learn(_matrix(own.column("x"))[order], _bits(own.column("label").to_numpy())[order], RATE * (1 - turn / ROUNDS), rng, weights[own.column("stratum").to_numpy()[order]])
        return pa.table({"n": pa.array([len(keys)], pa.int64()), "t": pa.array([net.t], pa.int64()), "state": pa.array([net.state().tobytes()], pa.binary())})

    return run


def _levels(model: Model):
    """Windows to counts of their scores by kind, label and level of the log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(KINDS), 2, int(2 * FAR / LEVEL)), np.int64)
        for batch in batches:
            p = np.clip(scores(model, _matrix(batch.column(1))), 1e-12, 1 - 1e-12)
            at = np.floor((np.log(p / (1 - p)) + FAR) / LEVEL).astype(np.int64)
            y = _bits(batch.column(0).to_numpy())
            for k in range(len(KINDS)):
                np.add.at(counts[k], (y[:, k], at[:, k]), 1)
        k, label, level = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(k, pa.int32()), "label": pa.array(label, pa.int32()), "level": pa.array(level, pa.int32()), "n": pa.array(counts[k, label, level])})

    return run


def calibrated(model: Model, counts: np.ndarray, learned: np.ndarray) -> Model:
    """The model with scales and thresholds from counts (kind, label, level) of its plain scores."""
    edges = np.arange(counts.shape[2]) * LEVEL - FAR
    scale, shift, limits = np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), np.inf)
    for k in np.flatnonzero(learned & (counts[:, 1].sum(axis=1) > 0)):
        grid = [(a, b) for a in 2.0 ** np.arange(-4, 2, 0.5) for b in np.arange(-4, 4.5, 0.5)]
        z = edges + LEVEL / 2
        loss = [counts[k, 0] @ np.logaddexp(0, a * z + b) + counts[k, 1] @ np.logaddexp(0, -(a * z + b)) for a, b in grid]
        scale[k], shift[k] = grid[int(np.argmin(loss))]
        reach = counts[k, 1][::-1].cumsum()[::-1]  # labelled findings at a level or above
        limits[k] = 1 / (1 + np.exp(-(scale[k] * edges[np.flatnonzero(reach >= RECALL * reach[0])[-1]] + shift[k])))
    return model._replace(scale=scale, shift=shift, thresholds=limits)


def _fit_parts(windows: DataFrame, sizes: np.ndarray, learned: np.ndarray, total: int) -> Model:
    """A model of any number of windows (key, stratum, label, x); no task has more than a part of them."""
    slot = lambda m, n: F.pmod(F.shiftright("key", m), F.lit(n))
    fitted, held = windows.where(slot(40, 5) != 4), windows.where(slot(40, 5) == 4)
    parts = max(1, min(MOST_PARTS, total // (SLOTS * PART)))
    weights = np.minimum(MOST_WEIGHT, total / (np.maximum(sizes, 1) * max(1, np.count_nonzero(sizes))))
    net = _Network(np.random.default_rng(SEED))
    state, t = net.state(), 0
    for turn in range(ROUNDS):
        own = fitted.where(slot(8, SLOTS) == turn % SLOTS).withColumn("part", slot(16, parts)).repartition(parts, "part")  # by number, as small parts would be put together
        got = own.groupBy("part").applyInArrow(_part(state, t, turn, weights), "n long, t long, state binary").toArrow()
        if got.num_rows:
            n = got.column("n").to_numpy()
            order = sorted(range(len(n)), key=lambda i: got.column("state")[i].as_py())  # sums in one order
            state = sum(n[i] * np.frombuffer(got.column("state")[i].as_py()) for i in order) / n.sum()
            t = int(n @ got.column("t").to_numpy() // n.sum())
    model = net.resumed(state, t).model()
    counts = np.zeros((len(KINDS), 2, int(2 * FAR / LEVEL)), np.int64)
    for r in held.select("label", "x").mapInArrow(_levels(model), "kind int, label int, level int, n long").groupBy("kind", "label", "level").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["label"], r["level"]] = r["n"]
    return calibrated(model, counts, learned)


def fit(found: DataFrame, tables: Tables) -> Model | None:
    """A model of all distinct windows of the candidates' first pieces; none if no kind has LEAST_FINDINGS of them."""
    labelled = found.select("pieces", "strata", "labels", "windows").mapInArrow(_labelled, "key long, stratum int, label int, x binary")
    windows = tables.kept(labelled.groupBy("key").agg(F.min("stratum").alias("stratum"), F.bit_or("label").alias("label"), F.min("x").alias("x")))
    rows = windows.groupBy("stratum", "label").agg(F.count("*").alias("n")).collect()
    sizes = np.array([sum(r["n"] for r in rows if r["stratum"] == s) for s in range(len(KINDS) + 2)])
    learned = np.array([sum(r["n"] for r in rows if r["label"] >> k & 1) >= LEAST_FINDINGS for k in range(len(KINDS))])
    if not learned.any():
        return None
    if sizes.sum() > TOGETHER:
        return _fit_parts(windows, sizes, learned, int(sizes.sum()))
    got = windows.select("key", "label", "x").toArrow()
    order = np.argsort(got.column("key").to_numpy())
    return train(_matrix(got.column("x"))[order], got.column("label").to_numpy()[order])


def _told(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            added: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
            pieces = col["pieces"].flatten().to_numpy()
            if model is not None and len(pieces):
                x = np.frombuffer(b"".join(v.as_py() for v in col["windows"]), np.uint8).reshape(-1, WIDE)
                of = np.repeat(np.arange(len(pieces)), pieces)
                hit = np.zeros(len(pieces), bool)
                hit[of[(scores(model, x) >= model.thresholds).any(axis=1)]] = True
                starts, ends, labels = (col[c].flatten().to_numpy() for c in ("starts", "ends", "labels"))
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(col["starts"]).to_numpy())
                for c in np.flatnonzero(hit & (labels == 0)):
                    added[doc[c]].append((int(starts[c]), int(ends[c])))
            n = col["n"].flatten().to_numpy().reshape(-1, len(KINDS))
            sums, spans = [], []
            for named, more in zip(col["base"].to_pylist(), added):
                sums.append(hashlib.sha256(",".join(named).encode()).hexdigest())
                # names sort as listed within a start: additions lie apart from all others
                spans.append(",".join(s for _, s in sorted([(int(s.split(":")[1]), s) for s in named] + [(a, f"{ADDED}:{a}:{b}") for a, b in more], key=lambda v: v[0])))
            yield pa.RecordBatch.from_pydict({"doc_id": col["doc_id"], **{f"n_{k}": pa.array(n[:, i], pa.int64()) for i, k in enumerate(KINDS)}, "n_model": pa.array([len(m) for m in added], pa.int64()), "base_sha256": pa.array(sums, pa.string()), "spans": pa.array(spans, pa.string())})

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans), a row per row of `docs`.

    base_sha256 is of the rules' findings as kind:start:end in code points, spans
    has the network's too. Null or empty text has none, and a null id is kept.
    Repeated rows are told alike, each in a row of its own. A table without
    enough findings to learn from has the rules' alone; an empty one gives no
    rows. Texts of any length are read whole. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tables = Tables(docs.sparkSession, "secrets")
    found = tables.written(rows, _find, ROW)
    told = ", ".join(f"n_{k} long" for k in (*KINDS, ADDED))
    return found.mapInArrow(_told(fit(found, tables)), f"doc_id long, {told}, base_sha256 string, spans string")
