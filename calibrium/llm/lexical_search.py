"""Ranked lexical search over term-bucketed postings (op11).

The index is one table. Documents are taken in chunks, whatever their order; a
chunk gives a row of its documents (ids and term counts, bucket -1) and, for
each of its terms, a row of postings (places in the chunk and occurrences).
Postings are dealt by the term's bucket and lie sorted by bucket and term, so a
search reads the row groups of its own terms. A term of very many documents is
many rows, which the adaptive planner splits over tasks by size.

A search joins the postings with the distinct terms asked for, goes by chunk to
the documents' lengths, scores each match in integers, joins the items of each
term and sums by item and document where the chunk is; the first k of each item
leave their task. No hit is pruned before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._kernels import ALNUM, placed_words, utf8
from ._shared import Tables, small_batches

#: Documents and bytes of text of a chunk (one document may be longer), buckets of terms.
CHUNK_DOCS, CHUNK_BYTES, BUCKETS = 1024, 4 << 20, 1 << 16
#: Bytes of the items' terms that are sent to all tasks; more are joined by a shuffle.
MOST_BYTES = 16 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ROW = "bucket int, term string, chunk long, places array<int>, counts array<int>, ids array<long>, n long, filled long"
_ROW = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("chunk", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("filled", pa.int64())])


class Index(NamedTuple):
    rows: DataFrame
    documents: int  # with at least one term
    terms: int  # of all documents, with repeats


def _slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings buf[starts:ends], A-Z lower-cased."""
    length = ends - starts
    to = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(int(to[-1])) + np.repeat(starts - to[:-1], length)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(LOWER[buf[at]])]).cast(pa.string())


def term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, hashes, ends, places, counts, sizes) of some texts.

    The postings of term t are places[ends[t-1]:ends[t]], ascending, with their
    counts; sizes are the numbers of terms, with repeats, of the texts.
    """
    buf, off = utf8(texts)
    words, at, starts, stops = placed_words(buf, off, ALNUM)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(words, kind="stable")  # documents stay ascending within a term
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate((first, [len(w)])))
    w, d = w[first], d[first]
    head = np.ones(len(w), bool)
    head[1:] = w[1:] != w[:-1]
    heads = np.flatnonzero(head)
    one = order[first[heads]]
    ends = np.concatenate((heads[1:], [len(w)])) if len(heads) else heads
    return _slices(buf, starts[one], stops[one]), w[heads], ends, d, counts, sizes


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values, kind))


def _blocks(chunk_docs: int, chunk_bytes: int):
    """A function of (id, text) to the rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        docs = size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            table = pa.Table.from_batches(held)
            terms, hashes, ends, places, counts, sizes = term_counts(table.column(1).combine_chunks())
            nothing = lambda n, kind: pa.nulls(n, kind)
            ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), pa.concat_arrays(table.column(0).chunks))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), nothing(1, pa.string()), pa.array([chunk]), nothing(1, _ROW.types[3]), _lists(np.array([docs]), sizes, pa.int32()), ids, pa.array([int(sizes.sum())]), pa.array([int((sizes > 0).sum())])], schema=_ROW)
            buckets = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
            n = np.diff(np.concatenate(([0], ends)))
            for lo in range(0, len(terms), 20_000):
                hi, base = min(lo + 20_000, len(terms)), int(ends[lo - 1]) if lo else 0
                own = slice(base, int(ends[hi - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(buckets[lo:hi]), terms[lo:hi], pa.array(np.full(hi - lo, chunk)), _lists(ends[lo:hi] - base, places[own], pa.int32()), _lists(ends[lo:hi] - base, counts[own], pa.int32()), nothing(hi - lo, _ROW.types[5]), pa.array(n[lo:hi]), nothing(hi - lo, pa.int64())], schema=_ROW)
            chunk += 1

        for batch in batches:
            if batch.num_rows:
                if held and (docs + batch.num_rows > chunk_docs or size + batch.nbytes > chunk_bytes):
                    yield from rows()
                    held, docs, size = [], 0, 0
                held.append(batch)
                docs, size = docs + batch.num_rows, size + batch.nbytes
        if held:
            yield from rows()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK_DOCS, chunk_bytes: int = CHUNK_BYTES) -> Index:
    """The index of all rows of `docs`, written to the shared folder.

    Each row is a document, rows of one id too; null or empty text has no term.
    `docs` is to be a table read from files (or written before), so that a task
    that is run again meets the same rows. Other columns are not read; an empty
    table gives an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark, min(256, chunk_docs))
    tables = Tables(spark, "postings")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks(chunk_docs, chunk_bytes), ROW)
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    written = tables.written(dealt, iter, ROW)
    n, terms = written.where("bucket = -1").agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(written, n, terms)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, hashes, ends, places, *_ = term_counts(batch.column(1))
        of = np.repeat(np.arange(len(terms)), np.diff(np.concatenate(([0], ends))))
        buckets = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"item_id": batch.column(0).take(pa.array(places)), "bucket": pa.array(buckets[of]), "term": terms.take(pa.array(of))})


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above 0.

    Equal scores go by ascending id, null ids last; rows of one id are ranked
    each by itself. Rows of one item id are one item of all their terms, once
    each; so are all rows without id. Items without a term, or without a match,
    have no row. Integers are of 64 bits; one that doesn't fit is an error.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[item_col]
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    tables = Tables(spark, "search")
    asked = tables.cut(asked.mapInArrow(_item_terms, f"item_id {kind}, bucket int, term string").distinct())
    terms = asked.select("bucket", "term").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    few = F.broadcast if size <= MOST_BYTES else (lambda df: df)
    postings = index.rows.where("bucket >= 0")
    # df needs the counts of rows alone, not their postings
    held = postings.select("bucket", "term", "n").join(few(terms), ["bucket", "term"]).groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)))
    held = tables.cut(held.select("term", weight.alias("weight")))
    found = postings.select("term", "chunk", F.arrays_zip("places", "counts").alias("hits")).join(few(held), "term")
    texts = index.rows.where("bucket = -1").select("chunk", "ids", F.col("counts").alias("sizes"))
    # by chunk once: lengths, sums of an item and document, and the first k meet there
    met = found.join(texts.hint("shuffle_merge"), "chunk").select("term", "weight", "chunk", "ids", "sizes", F.explode("hits").alias("hit"))
    met = met.select("term", "chunk", "weight", F.col("hit.places").alias("place"), F.get("ids", F.col("hit.places")).alias("doc_id"), F.col("hit.counts").cast("long").alias("tf"), F.get("sizes", F.col("hit.places")).cast("long").alias("n"))
    half = F.expr(f"100 - 50 + ((50 * n * {index.documents}L) div {max(1, index.terms)}L)")
    met = met.withColumn("m", half).select("term", "chunk", "place", "doc_id", F.expr("weight * ((1000000000 * tf) div (1000 * tf + 20 * m))").alias("part"))
    scored = met.join(few(asked.select("item_id", "term")), "term").groupBy("chunk", "item_id", "place", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "chunk", "place")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
