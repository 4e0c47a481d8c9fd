"""Language identification by averaged hashed subword embeddings (op8).

A text's features are all byte 2-, 3- and 4-grams of its lower-cased UTF-8,
hashed to `BUCKETS` embeddings; their average feeds a linear softmax. The model
is trained by stochastic gradient descent in numpy on a bounded sample of
distinct labelled texts: of each label those of the least hashes, `PER_LANGUAGE`
at most and `SAMPLE` in all, so a text that is copied very often is one of them.
Each counts with its whole text. A fifth of the sample calibrates: it sets
the softmax temperature, and the score below which a text is rejected.

A linear layer over an average is an average of per-bucket class scores, so the
trained model is one table of BUCKETS rows of as many scores as there are
languages. Its size is fixed; it travels with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._kernels import groups, utf8
from ._shared import small_batches

BUCKETS, WIDTH = 1 << 14, 16
#: The bounds of the training sample: texts for each label, in all, and the fewest a label is learned from if it has them.
PER_LANGUAGE, SAMPLE, LEAST_SAMPLE = 600, 24_000, 20
EPOCHS, RATE, SEED = 4, 0.5, 8
UNKNOWN = "und"
#: A text is rejected under half the score that all but this share of rightly
#: classified calibration rows reach.
REJECTED = 0.001
#: 2-, 3- and 4-grams of bytes.
ORDERS = (2, 3, 4)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # (languages, BUCKETS): class scores of a bucket, by temperature
    bias: np.ndarray
    threshold: float


def _buckets(b: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, by order."""
    x = b.astype(np.uint32)
    out = []
    for n in ORDERS:
        m = max(0, len(x) - n + 1)
        g = np.zeros(m, np.uint32)
        for j in range(n):
            g = (g << np.uint32(8)) | x[j : j + m]
        out.append((((g * np.uint32(2654435761)) ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x3C6EF372)) >> np.uint32(32 - 14))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, text) to the buckets of each text and their counts."""
    for batch in batches:
        buf, off = utf8(pc.utf8_lower(batch.column(2)))
        at, ns = [], []
        for d in range(len(off) - 1):
            counts = np.zeros(BUCKETS, np.int64)
            for g in _buckets(buf[off[d] : off[d + 1]]):
                counts += np.bincount(g, minlength=BUCKETS)
            k = np.flatnonzero(counts)
            at.append(k.astype(np.int32))
            ns.append(counts[k].astype(np.int32))
        yield pa.RecordBatch.from_pydict({"key": batch.column(0), "lang": batch.column(1), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(ns, pa.list_(pa.int32()))})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Train on a bounded sample of rows with label and text.

    No labelled rows: a model without languages, which rejects all. More labels
    than SAMPLE / LEAST_SAMPLE: ValueError, as no label is left out.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text <> ''")
    # Copies draw alike; the label is no part of the hash but through its share.
    rows = rows.withColumn("key", F.xxhash64("text", F.lit(SEED)))
    most = SAMPLE // LEAST_SAMPLE
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} labels; SAMPLE bounds them")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.float32), 1.0)
    languages, each = sorted(r["lang"] for r in sizes), min(PER_LANGUAGE, SAMPLE // len(sizes))
    # a quarter more than wanted, as the counts are estimates; then exactly the least
    shares = spark.createDataFrame([(r["lang"], min(1.0, (1.25 * each + 20) / max(1, r["n"]))) for r in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.col("key"), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30))
    drawn = drawn.groupBy("lang", "key").agg(F.first("text").alias("text"))
    least = Window.partitionBy("lang").orderBy(F.pmod(F.col("key"), F.lit(1 << 30)), "key")
    drawn = drawn.withColumn("row", F.row_number().over(least)).where(F.col("row") <= each)
    got = drawn.select("key", "lang", "text").mapInArrow(_features, "key long, lang string, at array<int>, n array<int>").toArrow()
    order = np.lexsort((np.array(got.column("lang").to_pylist(), object).astype(str), np.array(got.column("key"))))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in got.column("lang").to_pylist()])[order]
    # slices of two arrays: no object is made per bucket
    lists = [got.column(c).combine_chunks() for c in ("at", "n")]
    ends = lists[0].offsets.to_numpy()
    values = [x.values.to_numpy() for x in lists]
    at = [values[0][ends[i] : ends[i + 1]] for i in order]
    n = [(x / max(1, x.sum())).astype(np.float32) for x in (values[1][ends[i] : ends[i + 1]] for i in order)]

    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 10 * len(languages):
        held[:] = False
    emb = rng.normal(0, 1 / WIDTH**0.5, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            x = n[i] @ emb[at[i]]
            g = _softmax(x @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= rate * 0.1 * g
            emb[at[i]] -= (rate * 20) * n[i][:, None] * back
    test = np.flatnonzero(held) if held.any() else train
    z = np.array([n[i] @ (emb[at[i]] @ out) + bias for i in test])
    grid = 2.0 ** np.arange(-4, 5, 0.5)
    loss = [-np.log(np.maximum(_softmax(z * t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in grid]
    scale = grid[int(np.argmin(loss))]
    p = _softmax(z * scale)
    right = p.max(axis=1)[p.argmax(axis=1) == y[test]]
    threshold = min(0.5, float(np.quantile(right, REJECTED)) / 2) if len(right) else 0.0
    return Model(languages, np.ascontiguousarray((emb @ out * scale).T.astype(np.float32)), (bias * scale).astype(np.float32), threshold)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            buf, off = utf8(pc.utf8_lower(text))
            n, k = len(off) - 1, len(model.languages)
            z = np.zeros((n, k))
            for lo, hi in groups(off, 1 << 19):
                sums, total = np.zeros((hi - lo, k)), np.zeros(hi - lo)
                for order, g in zip(ORDERS, _buckets(buf[off[lo] : off[hi]])):
                    starts = off[lo:hi] - off[lo]
                    count = np.maximum(np.diff(off[lo : hi + 1]) - order + 1, 0)
                    full = np.flatnonzero(count)
                    total += count
                    # n-grams over the end of a document fall between its range and the next
                    edges = np.column_stack((starts[full], starts[full] + count[full])).ravel()
                    edges = edges[:-1] if len(edges) and edges[-1] >= len(g) else edges
                    for c in range(k):
                        if len(full):
                            sums[full, c] += np.add.reduceat(model.table[c][g], edges, dtype=np.float64)[::2]
                z[lo:hi] = sums / np.maximum(total, 1)[:, None]
            ok = letters & (k > 0)
            if k:
                p = _softmax(z + model.bias)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score = np.zeros(n, int), np.zeros(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "lang_pred": pa.array([model.languages[b] if o else UNKNOWN for b, o in zip(best, ok)], pa.string()),
                    "score": pa.array(np.where(ok, score, 0.0)),
                    "rejected": pa.array(~ok | (score < model.threshold)),
                }
            )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row per row of `docs`.

    lang_pred is a learned label, or `und` (score 0, rejected) for text that is
    null or has no letter. A score under the calibrated threshold is rejected
    too. Other columns, labels among them, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def _accepted(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_at)], names=["doc_id", "text"])
            for told in _predict(model)(iter([two])):
                yield batch.filter(pc.invert(told.column(told.schema.names.index("rejected"))))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text is not rejected."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_accepted(model, docs.columns.index(text_col)), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all.

    (doc_id, held_out, lang_pred, score, rejected). Rows without id are not
    learned from.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    out = predict(docs, fit(known, lang_col, text_col), id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
