"""Benchmark decontamination with an FM-index per shard of training text (op2).

A partition's documents are gathered into shards of bounded size and each shard
is indexed. The test phrases (all windows of `window` words of every benchmark
item; an item of fewer words is one phrase) are searched backwards in the
index, side by side. Suffix ranges that remain are located, every place covers
the words of its phrase, and overlapping covers merge into removal spans.

The phrases are written to the shared folder in blocks of bounded size, which a
worker loads one at a time: neither driver nor worker holds the benchmark at
once, however large it is.
"""

from __future__ import annotations

import functools
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import make_folder, opened
from ._fm_index import FMIndex
from ._kernels import ALNUM, U64, groups, mix, placed_words, stream, utf8
from ._shared import Tables, shared_folder, small_batches

#: Words and documents of a shard; characters of benchmark text in a block of phrases.
SHARD, SHARD_DOCS, BLOCK = 900_000, 100_000, 8 << 20
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<first:int,end:int>>, contaminated boolean"


def phrases_of(items: list[tuple[str | None, str]], window: int) -> dict[str, np.ndarray]:
    """Distinct phrases of (item, text): hashes aligned right, lengths, and their items."""
    buf, off = utf8(pa.array([t for _, t in items], pa.string()))
    words, at, _, _ = placed_words(buf, off, ALNUM)
    rows, lengths, owners = [], [], []
    names: dict[str, int] = {}
    for d, (name, _) in enumerate(items):
        own = words[at[d] : at[d + 1]]
        n = min(window, len(own))
        if n:
            w = np.lib.stride_tricks.sliding_window_view(own, n)
            rows.append(np.concatenate((np.zeros((len(w), window - n), U64), w), axis=1))
            lengths += [n] * len(w)
            owners += [-1 if name is None else names.setdefault(name, len(names))] * len(w)
    rows, lengths, owners = np.concatenate(rows) if rows else np.empty((0, window), U64), np.array(lengths, np.int64), np.array(owners, np.int64)
    key = mix((rows * (stream(31, window) | U64(1))).sum(axis=1, dtype=U64) + lengths.astype(U64)) if len(rows) else np.empty(0, U64)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    pair = np.unique(np.column_stack((which, owners)), axis=0) if len(rows) else np.empty((0, 2), np.int64)
    return {"rows": rows[first], "lengths": lengths[first], "items_at": np.searchsorted(pair[:, 0], np.arange(len(first) + 1)), "items": pair[:, 1], "names": np.array(list(names), dtype=np.str_) if names else np.empty(0, "U1")}


def _write_block(folder: str, window: int):
    """A block's items (block, item, text) to a file of their phrases."""

    def run(key: tuple, items: pa.Table) -> pa.Table:
        data = io.BytesIO()
        np.savez(data, **phrases_of(list(zip(items.column("item").to_pylist(), items.column("text").to_pylist())), window))
        uri = f"{folder}/phrases-{uuid.uuid4().hex}.npz"
        f, path = opened(uri)
        with f.open_output_stream(path) as o:
            o.write(data.getvalue())
        return pa.table({"uri": [uri]})

    return run


def write_phrases(benchmark: DataFrame, folder: str, window: int, id_col: str, text_col: str) -> list[str]:
    """Write the phrases of all items in blocks, each in a task of its own; the blocks' names."""
    make_folder(folder)
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "text"), F.lit(int(total // BLOCK) + 1)).cast("int")
    written = items.withColumn("block", block).groupBy("block").applyInArrow(_write_block(folder, window), "uri string")
    # one name for each block that has items; a task that was run again leaves a file nobody refers to
    return sorted(r["uri"] for r in Tables(benchmark.sparkSession, "phrases").cut(written).collect())


@functools.lru_cache(maxsize=1)
def _block(uri: str) -> dict[str, np.ndarray]:
    f, path = opened(uri)
    with f.open_input_file(path) as src, np.load(io.BytesIO(src.read())) as z:
        return {k: z[k] for k in z.files}


def search_shard(words: np.ndarray, offsets: np.ndarray, blocks: list[str], covered: np.ndarray) -> list[tuple[int, str]]:
    """Add each occurrence to `covered` (differences); the (document, item) pairs."""
    index = FMIndex(words, offsets)
    starts = offsets[:-1] + np.arange(len(offsets) - 1)  # of documents in the index's text
    found: list[tuple[int, str]] = []
    for uri in blocks:
        p = _block(uri)
        which, lo, hi = index.search(p["rows"], p["lengths"])
        if not len(which):
            continue
        n = hi - lo
        which = np.repeat(which, n)
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = index.locate(rows)
        doc = np.searchsorted(starts, place, "right") - 1
        at = place - doc  # separators before it
        np.add.at(covered, at, 1)
        np.add.at(covered, at + p["lengths"][which], -1)
        for d, w in np.unique(np.column_stack((doc, which)), axis=0):
            found += [(int(d), str(p["names"][i])) for i in p["items"][p["items_at"][w] : p["items_at"][w + 1]] if i >= 0]
    return found


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _scan(blocks: list[str], window: int):
    def results(ids: list, words: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        covered = np.zeros(len(words) + 1, np.int64)
        items: list[set[str]] = [set() for _ in ids]
        if len(words) > SHARD:  # one long document: pieces that overlap by a phrase
            for lo in range(0, len(words), SHARD):
                part = words[lo : lo + SHARD + window - 1]
                own = np.zeros(len(part) + 1, np.int64)
                for _, item in search_shard(part, np.array([0, len(part)]), blocks, own):
                    items[0].add(item)
                # a phrase that starts in the overlap is the next piece's too: a cover counts once or twice
                covered[lo : lo + len(own)] += own
        elif len(words):
            for d, item in search_shard(words, at, blocks, covered):
                items[d].add(item)
        hit = np.cumsum(covered[:-1]) > 0
        spans = [_spans(hit[at[d] : at[d + 1]]) for d in range(len(ids))]
        n_hit = [sum(s["end"] - s["first"] for s in x) for x in spans]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(at)),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(map(len, items), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, ends = [], [], [0]

        def flush():
            nonlocal ids, parts, ends
            if ids:
                yield results(ids, np.concatenate(parts), np.array(ends))
            ids, parts, ends = [], [], [0]

        for batch in batches:
            names = batch.column(0).to_pylist()
            buf, off = utf8(batch.column(1))
            for lo, hi in groups(off):
                words, at, _, _ = placed_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM)
                for d in range(hi - lo):
                    own = words[at[d] : at[d + 1]]
                    if ids and (ends[-1] + len(own) > SHARD or len(ids) >= SHARD_DOCS):
                        yield from flush()
                    ids.append(names[lo + d])
                    parts.append(own)
                    ends.append(ends[-1] + len(own))
        yield from flush()

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What of every document is in the benchmark, a row per row of `docs`.

    (doc_id, n_words, n_hit, n_items, items_sha256, spans, contaminated); spans
    are the merged removal spans, as word numbers. Null text has no words and
    is clean. Items without text are no phrases; an item without id hits words
    but is not counted. Repeated rows each get their row; rows of one item id
    count as one item. Empty tables: no rows, or all documents clean. Other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = write_phrases(benchmark, shared_folder(spark, "phrases"), window, item_col, item_text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(blocks, window), FOUND)
