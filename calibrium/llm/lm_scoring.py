"""Cross-entropy difference between two matched bigram models (op7).

Both models use the ids of one public tokenizer as their vocabulary, the same
order, discount and smoothing. One is counted over the target documents, the
other over all documents. A document's score is the mean over its tokens of the
target model's loss less the background model's, in bits: the lower, the more
the document is like the target.

Loss of a token w after h: -log2 of (max(c(h w) - D, 0) + D n(h) p(w)) / c(h),
where n(h) is the number of distinct tokens seen after h and p(w) the smoothed
share of w; of p(w) alone where h was never seen.

Texts are tokenised once, to a table of packed ids that counting and scoring
read. Bigrams are counted per shard of tokens in numpy, summed by a shuffle, and
written to the shared folder as blocks of bounded size, so the model may be
larger than any memory. A worker scores a bounded stretch of documents against
one block after the other. Only what the vocabulary bounds (counts of single
tokens) is sent to every worker.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import make_folder, opened
from ._kernels import utf8
from ._shared import Tables, shared_folder, small_batches
from ._word_ids import word_ids

DISCOUNT, ADDED = 0.75, 0.5
#: Tokens counted or scored together; bigrams in a block of the model.
STRETCH, BLOCK = 1_500_000, 2_000_000


def _tokens(tokenizer: str, kind: str):
    """(doc_id, text) to (doc_id, ids), the ids little-endian in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = word_ids(tokenizer).encode_all(*utf8(batch.column(1)))
            data, width = ids.astype(kind), np.dtype(kind).itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype("<i8")), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary())], names=["doc_id", "ids"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(first column, tokens, offsets) of documents of about STRETCH tokens together."""
    firsts, parts, sizes, held, width = [], [], [], 0, np.dtype(kind).itemsize
    for batch in batches:
        packed = batch.column(1).cast(pa.large_binary())
        _, offsets, data = packed.buffers()
        at = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
        own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        parts.append(np.frombuffer(own.tobytes(), kind).astype(np.int64))
        sizes.append(np.diff(at) // width)
        firsts += batch.column(0).to_pylist()
        held += len(parts[-1])
        if held >= STRETCH:
            yield firsts, np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            firsts, parts, sizes, held = [], [], [], 0
    if parts:
        yield firsts, np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def bigrams(tokens: np.ndarray, offsets: np.ndarray, vocabulary: int) -> np.ndarray:
    """history * (vocabulary + 1) + token; the history of a first token is `vocabulary`."""
    history = np.empty(len(tokens), np.int64)
    history[1:] = tokens[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    history[starts] = vocabulary
    return history * (vocabulary + 1) + tokens


def _count(kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, tokens, offsets in _stretches(batches, kind):
            keys = bigrams(tokens, offsets, vocabulary)
            of_target = np.repeat(np.array(target, bool), np.diff(offsets))
            keys = np.sort(keys * 2 + of_target)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            n = np.diff(np.concatenate((first, [len(keys)])))
            own = keys[first]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(own >> 1), "n": pa.array(n), "n_target": pa.array(np.where(own & 1, n, 0))})

    return run


def _block_writer(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("gram").to_numpy())
        data = io.BytesIO()
        np.savez(data, **{k: table.column(k).to_numpy()[order] for k in ("gram", "n", "n_target")})
        uri = f"{folder}/grams-{uuid.uuid4().hex}.npz"
        f, path = opened(uri)
        with f.open_output_stream(path) as out:
            out.write(data.getvalue())
        return pa.table({"uri": [uri]})

    return run


@functools.lru_cache(maxsize=1)
def _block(uri: str) -> dict[str, np.ndarray]:
    f, path = opened(uri)
    with f.open_input_file(path) as src, np.load(io.BytesIO(src.read())) as z:
        return {k: z[k] for k in z.files}


class Singles:
    """Counts by token of one model, from its bigram counts summed by history and by token."""

    def __init__(self, vocabulary: int):
        self.seen, self.after, self.kinds = (np.zeros(vocabulary + 1, np.int64) for _ in range(3))

    def losses(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits that each bigram's token costs."""
        side = len(self.seen)
        h, w = grams // side, grams % side
        p = (self.seen[w] + ADDED) / (self.seen.sum() + ADDED * (side - 1))
        after = self.after[h]
        p = np.where(after > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * self.kinds[h] * p) / np.maximum(after, 1), p)
        return -np.log2(p)


def _score(kind: str, vocabulary: int, blocks: list[str], target: Singles, background: Singles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, offsets in _stretches(batches, kind):
            n_docs = len(ids)
            grams = bigrams(tokens, offsets, vocabulary)
            place = np.argsort(grams)
            ordered = grams[place]
            first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
            kinds = ordered[first]
            n, n_target = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for uri in blocks:
                b = _block(uri)
                at = np.minimum(np.searchsorted(b["gram"], kinds), len(b["gram"]) - 1)
                hit = b["gram"][at] == kinds
                n[hit], n_target[hit] = b["n"][at[hit]], b["n_target"][at[hit]]
            which = np.cumsum(first) - 1
            doc = np.repeat(np.arange(n_docs), np.diff(offsets))[place]
            total = np.maximum(np.diff(offsets), 1)
            t = np.bincount(doc, target.losses(kinds, n_target)[which], n_docs) / total
            b = np.bincount(doc, background.losses(kinds, n)[which], n_docs) / total
            none = np.diff(offsets) == 0
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(np.diff(offsets)), "target_loss": pa.array(t, mask=none), "background_loss": pa.array(b, mask=none), "difference": pa.array(t - b, mask=none)})

    return run


def score(docs: DataFrame, target_ids: DataFrame, tokenizer: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference), a row per row of `docs`.

    target_ids: ids of the target documents, as doc_id. The background is all
    documents. Text that is null or without tokens: 0 tokens and null losses.
    No target documents: the target model knows the vocabulary's size alone.
    Repeated rows are counted as often as they occur and each get their row; a
    null id is in no target. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables, folder = Tables(spark, "lm"), shared_folder(spark, "lm-model")
    make_folder(folder)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = tables.written(docs, _tokens(tokenizer, kind), "doc_id long, ids binary")
    # a merge join at any size: the labels grow with the documents
    told = tokens.join(marks.hint("merge"), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "ids")
    parts = told.mapInArrow(_count(kind, vocabulary), "gram long, n long, n_target long")
    counts = tables.cut(parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")))

    side = vocabulary + 1
    target, background = Singles(vocabulary), Singles(vocabulary)
    of = lambda c: [F.sum("n").alias("n"), F.sum("n_target").alias("n_target"), F.count("*").alias("kinds"), F.count_if(F.col("n_target") > 0).alias("kinds_target")]
    # rows of single tokens: as many as the vocabulary has, at most
    by_history = counts.groupBy(F.floor(F.col("gram") / side).cast("int").alias("k")).agg(*of("k")).toArrow()
    by_token = counts.groupBy(F.pmod("gram", F.lit(side)).cast("int").alias("k")).agg(*of("k")).toArrow()
    k = by_history.column("k").to_numpy()
    background.after[k], background.kinds[k] = by_history.column("n").to_numpy(), by_history.column("kinds").to_numpy()
    target.after[k], target.kinds[k] = by_history.column("n_target").to_numpy(), by_history.column("kinds_target").to_numpy()
    k = by_token.column("k").to_numpy()
    background.seen[k], target.seen[k] = by_token.column("n").to_numpy(), by_token.column("n_target").to_numpy()

    n_blocks = int(by_history.column("kinds").to_numpy().sum() // BLOCK) + 1
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(n_blocks)).cast("int"))
    written = tables.cut(dealt.groupBy("block").applyInArrow(_block_writer(folder), "uri string"))
    blocks = sorted(r["uri"] for r in written.collect())
    return tokens.mapInArrow(_score(kind, vocabulary, blocks, target, background), "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
