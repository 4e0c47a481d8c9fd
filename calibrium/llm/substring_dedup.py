"""Substring dedup by compact windows (op10).

Passages are sequences of five-word shingles. Under a hash function, all
passages of a document that share their least shingle form a compact window, so
a few windows stand for all its passages of `WORDS` words or more. Two sorts of
keys come from them:

* single keys, the least shingle under each of `FUNCTIONS` functions, with its
  window. Two documents whose windows under `ENOUGH` functions overlap, on both
  sides, by a passage's length (an interval join) are candidates. Near-duplicate
  passages (similarity 0.8) agree under a function with that probability, so
  1.6e-3 of them agree under fewer.
* context keys, the `HALF` shingles up to and from the least shingle of the first
  function. Any equal passage holds one of the two, so documents that share one
  are candidates.

A shard of text compares the documents of a key with the first of them and
hands on that one alone; so do the shards among each other. Keys travel as
packed columns, dealt by ranges of keys, and are met in numpy.

Candidates are verified on the texts: all stretches of either that the other
has too, at all places, and chains of equal runs whose sets of shingles are
similar. Whatever stretch of a passage's length has a context that the first
document of the key has, but is not itself in it, is dealt again by its whole
hash. So all equal passages meet, whatever else their documents share. Least
shingles that the first document has, but where the two are not alike, are dealt
again too, so that near-duplicate passages unlike the first of their keys meet.

Near-duplicate passages without an equal stretch of `WORDS` words are not found
if they agree under fewer than `ENOUGH` functions, or if the first documents of
their keys are others, which agree with them under fewer, or if the first ones
of the second dealing are unlike them as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._anchored import anchored
from ._compact import MOST, REACH, block_minima, multipliers, order_keys, places, powers, sliding_minima, stretch_hashes, windows
from ._kernels import SPACED, U64, groups, hash_words, mix, shingle_hashes, utf8
from ._shared import Tables, components, shuffle_width, small_batches
from ._stretches import aligned, chains, keyed, member, runs, spans_of

SHINGLE, WORDS, SIMILAR = 5, 50, 0.8
LEAST = WORDS - SHINGLE + 1
#: Hash functions, and how many of them candidates agree under.
FUNCTIONS, ENOUGH = 8, 2
#: Of any passage, one half reaches this far from any of its places.
HALF = LEAST // 2
#: Shingles of a shard; of a piece of one long document.
SHARD, PIECE = 1 << 18, 1 << 17
#: Ranges of keys for each partition: a range is met at once.
RANGES = 8
#: kind 0: a document (a), the hashes h1 and h2 of its words and their number n.
#: kind 1: a and b agree under function `slot`, FUNCTIONS for a context; windows al..ar and bl..br.
#: kind 2: packed keys.
MEETING = "part int, kind int, a long, b long, slot int, al int, ar int, bl int, br int, h1 long, h2 long, n long, packed binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, *[pa.int64()] * 3, pa.binary()]
_NAMES = [c.split()[0] for c in MEETING.split(", ")]
#: kind 0: documents one and two share a passage. 1: words first..end of document `one` are in a document of
#: smaller id. 2: are in one of larger id. To be dealt again: 3: document `two` by a stretch of hash `one`; 4: by a single key.
FOUND = "kind int, one long, two long, first int, end int"
_RECORD = [("key", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("slot", "u1")]


def _rows(rows: int, **columns) -> pa.RecordBatch:
    """Rows of MEETING: the columns given, nulls else."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def pack_keys(r: dict[str, np.ndarray]) -> bytes:
    """Columns of keys, byte plane by byte plane, which compresses well."""
    return b"".join(np.ascontiguousarray(r[c].astype(t)).view(np.uint8).reshape(len(r[c]), -1).T.tobytes() for c, t in _RECORD)


def unpack_keys(data: bytes) -> dict[str, np.ndarray]:
    raw, at, out = np.frombuffer(data, np.uint8), 0, {}
    n = len(raw) // sum(np.dtype(t).itemsize for _, t in _RECORD)
    for c, t in _RECORD:
        w = np.dtype(t).itemsize
        out[c] = np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).reshape(-1).view(t)
        at += w * n
    return out


def _stars(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Keys sorted by key and document: pairs of each document with the first of its key; where the first stand.

    Of pairs that share a context one row is left, as that is enough.
    """
    n = len(r["key"])
    new = np.ones(n, bool)
    new[1:] = r["key"][1:] != r["key"][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.empty(0, np.int64)
    other = np.flatnonzero((r["doc"] != r["doc"][head]) & np.concatenate(([False], (r["doc"][1:] != r["doc"][:-1]) | new[1:])) if n else np.empty(0, bool))
    x, y = head[other], other
    swap = r["doc"][x] > r["doc"][y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    slot = np.minimum(r["slot"][y], FUNCTIONS)
    order = np.lexsort((-slot.astype(np.int8), r["doc"][y], r["doc"][x]))
    x, y, slot = x[order], y[order], slot[order]
    a, b = r["doc"][x], r["doc"][y]
    first = np.ones(len(x), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0)) if len(x) else x
    keep = first | (slot[lead] < FUNCTIONS)
    x, y, slot = x[keep], y[keep], slot[keep]
    pos, left, right = r["pos"], r["left"].astype(np.int32), r["right"].astype(np.int32)
    return {"a": r["doc"][x], "b": r["doc"][y], "slot": slot.astype(np.int32), "al": pos[x] - left[x], "ar": pos[x] + right[x], "bl": pos[y] - left[y], "br": pos[y] + right[y]}, np.flatnonzero(new)


def _shard_keys(ids: list[int], shingles: list[np.ndarray], offsets: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    """The keys of a shard: packed, the first document of each; pairs for the others."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], offsets[i]))
    gap, size = np.zeros(1, U64), [len(shingles[i]) + 1 for i in order]
    every = np.concatenate([gap, *(x for i in order for x in (shingles[i], gap))])
    real = np.ones(len(every), bool)
    ends = np.cumsum(size)
    real[0] = False
    real[ends] = False
    doc = np.concatenate(([0], np.repeat(np.array([ids[i] for i in order], np.int64), size)))
    begin = ends - np.array(size) + 1
    place = np.concatenate(([0], np.arange(1, len(every)) - np.repeat(begin, size) + np.repeat(np.array([offsets[i] for i in order]), size)))
    first, last = np.concatenate(([0], np.repeat(begin, size))), np.concatenate(([0], np.repeat(ends, size)))
    got: dict[str, list] = {k: [] for k in ("key", "at", "left", "right", "slot")}

    def add(key, at, left, right, slot):
        for k, v in zip(got, (key, at, left, right, np.full(len(at), slot, np.uint8))):
            got[k].append(v)

    context = None
    for f, by in enumerate(multipliers(FUNCTIONS)):
        c, l, r = windows(order_keys(every, real, by), REACH // 2, LEAST)
        add(single_keys(every[c], f), c, (c - l).astype(np.uint8), (r - c).astype(np.uint8), f)
        if f == 0 and len(c):
            context = stretch_hashes(every, HALF)
            for side, at in enumerate((c - HALF + 1, c)):
                fits = (at >= first[c]) & (at + HALF <= last[c])
                none = np.zeros(int(fits.sum()), np.uint8)
                add(mix(context[at[fits]] + U64(side + 11)), c[fits], none, none, FUNCTIONS + side)
    r = {k: np.concatenate(v) if v else np.empty(0) for k, v in got.items()}
    at = r.pop("at").astype(np.int64)
    r |= {"doc": doc[at], "pos": place[at].astype(np.int32)}
    sort = np.argsort(r["key"], kind="stable")  # with equal keys still by document and place
    r = {k: v[sort] for k, v in r.items()}
    pairs, heads = _stars(r)
    if len(pairs["a"]):
        part = (mix(pairs["b"].astype(U64)) % U64(parts)).astype(np.int32)
        yield _rows(len(part), part=part, kind=np.ones(len(part), np.int32), **pairs)
    r = {k: v[heads] for k, v in r.items()}
    part = ((r["key"] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    packed = [pack_keys({k: v[x:y] for k, v in r.items()}) for x, y in zip(cuts, cuts[1:])]
    if packed:
        yield _rows(len(packed), part=part[cuts[:-1]], kind=np.full(len(packed), 2, np.int32), packed=packed)


def _document_rows(ids: pa.Array, words: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row per document: two hashes of its words in order, and their number."""
    n = len(at) - 1
    p, inverse = powers(len(words) + 1)
    hashes = []
    for x in (words, mix(words ^ U64(0x5851F42D4C957F2D))):
        before = np.zeros(len(words) + 1, U64)
        np.cumsum(x * p[: len(words)], out=before[1:])
        hashes.append(mix((before[at[1:]] - before[at[:-1]]) * inverse[at[:-1]]).view(np.int64))
    return _rows(n, part=(hashes[0].view(U64) % U64(parts)).astype(np.int32), kind=np.zeros(n, np.int32), a=ids, h1=hashes[0], h2=hashes[1], n=np.diff(at))


def _scan(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, at, size = [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            buf, off = utf8(batch.column(1))
            for lo, hi in groups(off):
                words, w_at = hash_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                yield _document_rows(batch.column(0).slice(lo, hi - lo), words, w_at, parts)
                sh, s_at = shingle_hashes(words, w_at, SHINGLE)
                for d in range(hi - lo):
                    own = sh[s_at[d] : s_at[d + 1]]
                    if names[lo + d] is None or len(own) < LEAST:
                        continue
                    for start in range(0, len(own) - LEAST + 1, PIECE):
                        part = own[start : start + PIECE + LEAST - 1]
                        if held and size + len(part) > SHARD:
                            yield from _shard_keys(ids, held, at, parts)
                            ids, held, at, size = [], [], [], 0
                        ids.append(names[lo + d])
                        held.append(part)
                        at.append(start)
                        size += len(part) + 1
        if held:
            yield from _shard_keys(ids, held, at, parts)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MEETING by part: the packed keys of a part become pairs."""
    part, held = None, []

    def met() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:  # within a shard they have met
            return
        r = [unpack_keys(x) for x in held]
        r = {k: np.concatenate([x[k] for x in r]) for k, _ in _RECORD}
        order = np.lexsort((r["doc"], r["key"]))
        pairs, _ = _stars({k: v[order] for k, v in r.items()})
        if len(pairs["a"]):
            yield _rows(len(pairs["a"]), kind=np.ones(len(pairs["a"]), np.int32), **pairs)

    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        if (rest := np.flatnonzero(kind != 2)).size:
            yield batch.take(pa.array(rest))
        for i in np.flatnonzero(kind == 2).tolist():
            p = batch.column(0)[i].as_py()
            if p != part:
                yield from met()
                part, held = p, []
            held.append(batch.column(12)[i].as_py())
    yield from met()


def least_places(shingles: np.ndarray, function: int) -> np.ndarray:
    """For each stretch of LEAST shingles, the place of its least under a function."""
    out, by = np.empty(max(0, len(shingles) - LEAST + 1), np.int64), multipliers(FUNCTIONS)[function]
    step = MOST - LEAST
    for lo in range(0, len(out), step):
        part = shingles[lo : lo + step + LEAST - 1]
        key = order_keys(part, np.ones(len(part), bool), by)
        out[lo : lo + step] = lo + (sliding_minima(block_minima(key, LEAST), LEAST) & U64(MOST - 1)).astype(np.int64)
    return out


def single_keys(shingles: np.ndarray, function: int) -> np.ndarray:
    return mix(shingles * U64(0x9FB21C651E98DF25) + U64(function))


def compare(texts: list[np.ndarray], anchor: np.ndarray, deal: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Stretches that texts and their anchors share.

    texts: shingles; anchor: for each the number of the text to compare it
    with, its own for an anchor, which stands before the others. Returned:
    (text, first, end) of stretches of others and of anchors, and (kind, text,
    route) by which texts are dealt again: the hashes of stretches of LEAST
    shingles, and single keys where many shingles are the anchor's, but no
    stretch is alike. Fewer of them can't hide a passage that others share: two
    near passages have a key of their own wherever the first document has not.
    """
    every = np.concatenate(texts)
    size = np.array(list(map(len, texts)))
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), size)
    group = anchor[of]
    mine = of != group
    others: list[tuple[int, int, int]] = []
    anchors: list[tuple[int, int, int]] = []
    again: list[tuple[int, np.ndarray, np.ndarray]] = []

    whole = stretch_hashes(every, LEAST)
    fits = of[: len(whole)] == of[len(every) - len(whole) :]
    key = keyed(whole, group[: len(whole)])
    own = mine[: len(whole)]
    equal = np.zeros(len(whole), bool)
    for side in (own, ~own):
        at, against = np.flatnonzero(fits & side), np.flatnonzero(fits & ~side)
        equal[at] = member(key[at], np.sort(key[against]))
    for x, y in zip(*spans_of(equal)):
        t = int(of[x])
        (others if mine[x] else anchors).append((t, int(x - begin[t]), int(y - 1 + LEAST - begin[t])))

    m, n = np.flatnonzero(mine), np.flatnonzero(~mine)
    match = aligned(every[n], every[m], group[m], group[n])
    first, length, other = runs(match, of[m])
    cuts = np.flatnonzero(np.concatenate(([True], of[m[first[1:]]] != of[m[first[:-1]]]))) if len(first) else np.empty(0, np.int64)
    for lo, hi in zip(cuts, np.concatenate((cuts[1:], [len(first)])).astype(int)):
        if hi - lo < 2 or length[lo:hi].sum() < SIMILAR * LEAST:
            continue
        t = int(of[m[first[lo]]])
        g = int(anchor[t])
        for x, y, p, q in chains(m[first[lo:hi]] - begin[t], length[lo:hi], n[other[lo:hi]] - begin[g], texts[g], texts[t], LEAST, SIMILAR):
            others.append((t, x, y))
            anchors.append((g, p, q))

    if deal and len(whole):
        lacking = np.flatnonzero(fits & own & ~equal)
        if len(lacking):
            half = stretch_hashes(every, HALF)
            inside = of[: len(half)] == of[len(every) - len(half) :]
            half_key = keyed(half, group[: len(half)])
            known = np.sort(half_key[inside & ~mine[: len(half)]])
            c = least_places(every, 0)[lacking]
            start = np.where(c - HALF + 1 >= lacking, c - HALF + 1, c)
            lacking = lacking[member(half_key[start], known)]
            again.append((3, of[lacking], whole[lacking]))
        loose = np.zeros(len(every), bool)
        loose[m[match >= 0]] = True
        for t, x, y in others:
            loose[begin[t] + x : begin[t] + y] = False
        before = np.concatenate(([0], np.cumsum(loose)))
        wanted = np.flatnonzero(fits & own & (before[np.minimum(np.arange(len(whole)) + LEAST, len(every))] - before[: len(whole)] >= HALF))
        for f in range(FUNCTIONS if len(wanted) else 0):
            c = np.unique(least_places(every, f)[wanted])
            c = c[loose[c]]
            again.append((4, of[c], single_keys(every[c], f)))
    return others, anchors, again


def _verify(deal: bool):
    """Compares documents with their anchor; `deal`: with the stretches to be dealt again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_id, anchor = None, None
        for batch in batches:
            a, role, b = (batch.column(k).to_pylist() for k in (0, 2, 3))
            buf, off = utf8(batch.column(5))
            for lo, hi in groups(off):
                words, w_at = hash_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                sh, s_at = shingle_hashes(words, w_at, SHINGLE)
                texts, to, names = ([anchor], [0], [anchor_id]) if anchor is not None else ([], [], [])
                for d in range(lo, hi):
                    own = sh[s_at[d - lo] : s_at[d - lo + 1]]
                    if role[d] == 0:
                        anchor_id, anchor = a[d], own
                        to.append(len(texts))
                        texts.append(own)
                        names.append(a[d])
                    elif a[d] == anchor_id:
                        to.append(next(i for i in range(len(to) - 1, -1, -1) if to[i] == i))
                        texts.append(own)
                        names.append(b[d])
                if not texts:
                    continue
                others, anchors, again = compare(texts, np.array(to), deal)
                linked = sorted({t for t, _, _ in others})
                rows = [(0, names[to[t]], names[t], None, None) for t in linked]
                rows += [(1, names[t], None, x, y + SHINGLE - 1) for t, x, y in others] + [(2, names[t], None, x, y + SHINGLE - 1) for t, x, y in anchors]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["kind", "one", "two", "first", "end"])
                for kind, of, route in again:
                    n = len(of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(route.view(np.int64)), pa.array(np.array(names, np.int64)[of]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=["kind", "one", "two", "first", "end"])

    return run


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, spans, n): the union of each document's spans (doc_id, first, end)."""
    spans = spans.distinct()
    before = Window.partitionBy("doc_id").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.col("first") > F.max("end").over(before), F.lit(True))
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("int")).over(upto))
    islands = islands.groupBy("doc_id", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return islands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).cast("long").alias("n"))


def candidates(met: DataFrame) -> DataFrame:
    """(a, b) of kind 1 that share a context, or whose windows overlap under enough functions."""
    single = F.when(F.col("slot") < FUNCTIONS, F.struct("slot", "al", "ar", "bl", "br"))
    found = met.where("kind = 1").groupBy("a", "b").agg(F.max("slot").alias("most"), F.collect_list(single).alias("hits"))
    wide = lambda x, y, s: F.least(x[f"{s}r"], y[f"{s}r"]) - F.greatest(x[f"{s}l"], y[f"{s}l"]) + 1 >= LEAST
    agree = lambda x, y: (x["slot"] < y["slot"]) & wide(x, y, "a") & wide(x, y, "b")
    enough = lambda x: F.size(F.array_distinct(F.transform(F.filter("hits", lambda y: agree(x, y)), lambda y: y["slot"]))) >= ENOUGH - 1
    return found.where((F.col("most") == FUNCTIONS) | F.exists("hits", enough)).select("a", "b")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, n_removed, class_id, repeated, spans), a row per row.

    n_repeated: words in passages that another document has too; spans and
    n_removed: those that a document of smaller id has, to be removed, as word
    numbers; class_id: the smallest id linked by such passages, the row's own
    where there are none. Null, empty and short texts have none. Null id: no
    part in the comparison, class null. Repeated rows are one document; rows of
    one id with different texts share their spans, cut where a text ends. Empty
    table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables, width = Tables(spark, "substrings"), shuffle_width(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    scanned = docs.mapInArrow(_scan(RANGES * width), MEETING)
    met = tables.written(scanned.repartition(width, "part").sortWithinPartitions("part"), _meet, MEETING)
    tables.free()
    rows = met.where("kind = 0").select(F.col("a").alias("doc_id"), "h1", "h2", F.col("n").alias("n_words"))

    # Documents of the same words: the first stands for all.
    texts = rows.where(f"doc_id is not null and n_words >= {WORDS}").groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    copies = tables.kept(rows.join(texts, ["h1", "h2", "n_words"]).where("doc_id > rep").select("doc_id", "rep", F.col("n_words").cast("int").alias("end")).distinct())
    first_of = copies.select(F.col("doc_id").alias("_id"), "rep")
    stands = lambda df, c: df.join(first_of, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("rep", c)).drop("_id", "rep")
    pairs = stands(stands(candidates(met), "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = tables.kept(pairs)
    compared = lambda p, deal: anchored(tables, p.withColumn("info", F.lit(0)), known, _verify(deal), FOUND)
    found = compared(pairs, True)

    again = found.where("kind >= 3").select("kind", F.col("one").alias("route"), F.col("two").alias("doc")).distinct()
    heads = again.groupBy("kind", "route").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).where("a < last").select("kind", "route", "a")
    more = again.join(heads, ["kind", "route"]).where("doc <> a").groupBy("a", F.col("doc").alias("b")).agg(F.bool_or(F.col("kind") == 3).alias("whole"), F.count("*").alias("agree"))
    more = more.where(F.col("whole") | (F.col("agree") >= ENOUGH)).select("a", "b").join(pairs, ["a", "b"], "left_anti")
    found = found.where("kind < 3").union(compared(tables.kept(more), False))

    of = lambda kind: found.where(F.col("kind") == kind).select(F.col("one").alias("doc_id"), "first", "end")
    later = of(1).union(copies.select("doc_id", F.lit(0).alias("first"), "end"))
    sooner = of(2).union(copies.select(F.col("rep").alias("doc_id"), F.lit(0).alias("first"), "end").distinct())
    removed = merged(later).select("doc_id", "spans", F.col("n").alias("n_removed"))
    repeated = merged(later.union(sooner)).select("doc_id", F.col("n").alias("n_repeated"))
    edges = found.where("kind = 0").select(F.col("one").alias("a"), F.col("two").alias("b")).union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    classes = components(tables, edges).select(F.col("id").alias("doc_id"), F.col("root").alias("class_id"))
    marks = tables.kept(repeated.join(removed, "doc_id", "left").join(classes, "doc_id", "left"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(marks, "doc_id", "left").select("doc_id", "n_words", zero("n_repeated"), zero("n_removed"), F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n_repeated").isNotNull().alias("repeated"), "spans")
