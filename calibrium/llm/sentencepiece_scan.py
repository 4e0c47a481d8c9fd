"""SentencePiece encoding and decoding as a max-plus parallel scan (op6).

The ids are those of the library for a vocabulary file of merges, whatever a
text's length. A giant document is cut into chunks of characters; the state at
a cut is the piece that ends there or goes over it. Each chunk yields its matrix
of scores from entry state to exit state, without knowing its neighbours; the
matrices of a document are combined (the max-plus product is associative), which
fixes the state at every cut; then every chunk is traced back by itself. See
`_merges` for why the segmentation by merges is a path. Other documents are one
chunk.

Where no piece goes over a space mark that follows another character, that
place is a certain cut: what lies between two is a word, encoded when met first
and remembered, and batches of documents are gathers in numpy. Without such
cuts every document goes through the scan.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import CASED, U64, groups, mix, placed_words, utf8
from ._merges import SPACE, Pieces, boundary_states, pieces
from ._shared import Tables, shuffle_width, small_batches
from ._word_ids import Remembered

CHUNK = 1 << 15
#: Bytes of words: all but the space.
UNSPACED = np.ones(256, bool)
UNSPACED[0x20] = False


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class PieceIds(Remembered):
    """Ids of texts by words: marks, and the characters up to the next mark."""

    def __init__(self, found: Pieces):
        super().__init__()
        self.pieces = found

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts of UTF-8 bytes without visible spaces."""
        hashes, word_at, first, end = placed_words(buf, offsets, UNSPACED, table=CASED)
        n = np.diff(word_at)
        of = np.repeat(np.arange(len(n)), n)
        before = np.concatenate(([0], end[:-1]))[: len(end)]
        marks = first - np.maximum(before, offsets[of])
        marks[word_at[:-1][n > 0]] += 1  # a text begins with one more
        text = buf.tobytes()

        def words(at: np.ndarray) -> list[list[int]]:
            # the library puts the first mark itself
            return self.pieces.library.encode([" " * (k - 1) + text[x:y].decode() for k, x, y in zip(marks[at].tolist(), first[at].tolist(), end[at].tolist())])

        ids, ends = self.gather(mix(hashes + marks.astype(U64) * U64(0x9FB21C651E98DF25)), words)
        at = ends[word_at]
        size = np.diff(offsets)
        last = np.flatnonzero((size > 0) & (buf[np.maximum(offsets[1:] - 1, 0)] == 0x20) if len(buf) else np.zeros(len(size), bool))
        if len(last):  # marks alone at a text's end
            rows = [ids[x:y] for x, y in zip(at[:-1], at[1:])]
            for d in last.tolist():
                own = text[offsets[d] : offsets[d + 1]]
                k = len(own) - len(own.rstrip(b" "))
                rows[d] = np.concatenate((rows[d], self.pieces.words(SPACE * (k + (k == len(own)))).astype(np.uint32)))
            ids, at = np.concatenate(rows), np.concatenate(([0], np.cumsum(list(map(len, rows)))))
        return ids, at


@functools.lru_cache(maxsize=2)
def _piece_ids(model: str) -> PieceIds:
    return PieceIds(pieces(model))


def _unspaced(column: pa.Array) -> pa.Array:
    """Texts, null as empty, with plain spaces for visible ones, which the library takes for the same."""
    return pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")


def _decoded(found: Pieces, ids: np.ndarray, at: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the ids of each text decode to its bytes behind one space."""
    back, ends = found.decode(ids)
    size = np.diff(offsets)
    sizes = np.diff(ends[at])
    out = sizes == size + (size > 0)
    keep = np.repeat(out, sizes)
    # the bytes wanted: a space, and the text
    own = np.insert(buf, offsets[:-1][size > 0], np.uint8(0x20))
    same = back[keep] == own[np.repeat(out, size + (size > 0))]
    rows = np.flatnonzero(out & (size > 0))
    if len(rows):
        out[rows] = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(sizes[rows])[:-1])))
    return out


def _whole(model: str, digest: bool):
    """(doc_id, text) of documents of one chunk, encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words = pieces(model), _piece_ids(model)
        for batch in batches:
            texts = _unspaced(batch.column(1))
            buf, off = utf8(texts)
            n_chars = pc.utf8_length(texts).cast(pa.int64())
            for lo, hi in groups(off):
                own, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, ends = words.encode(own, at)
                total = np.concatenate(([0.0], np.cumsum(found.scores[ids])))
                out = {"doc_id": batch.column(0).slice(lo, hi - lo), "n_chars": n_chars.slice(lo, hi - lo), "n_tokens": pa.array(np.diff(ends), pa.int64()), "score": pa.array(total[ends[1:]] - total[ends[:-1]])}
                if digest:
                    data = memoryview(ids.astype("<u4")).cast("B")
                    out["ids_crc32"] = pa.array([zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())
                    out["decoded"] = pa.array(_decoded(found, ids, ends, own, at))
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _chunked(most: int):
    """(gid, text) to chunks (gid, chunk, behind, body, ahead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = marked(text)
                n = -(-len(m) // CHUNK)
                for lo in range(0, n, 64):
                    ks = range(lo, min(n, lo + 64))
                    at = [k * CHUNK for k in ks]
                    yield pa.RecordBatch.from_pydict({"gid": pa.array([gid] * len(ks), pa.int64()), "chunk": pa.array(ks, pa.int32()), "behind": pa.array([m[max(0, x - most) : x] for x in at], pa.string()), "body": pa.array([m[x : x + CHUNK] for x in at], pa.string()), "ahead": pa.array([m[x + CHUNK : x + CHUNK + most] for x in at], pa.string())})

    return run


def _matrices(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(model)
        for batch in batches:
            rows = [found.transfer(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("behind", "body", "ahead")))]
            yield pa.RecordBatch.from_pydict({"gid": batch.column("gid"), "chunk": batch.column("chunk"), "side": pa.array([x.shape[0] for x in rows], pa.int32()), "matrix": pa.array([x.astype("<f8").tobytes() for x in rows], pa.binary())})

    return run


def _states(key: tuple, table: pa.Table) -> pa.Table:
    """All matrices of a document: a few KB for every CHUNK characters of it."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "side", "matrix"))))
    score, states = boundary_states([np.frombuffer(x, "<f8").reshape(side, -1) for _, side, x in rows])
    n = len(rows)
    return pa.table({"gid": pa.array([key[0].as_py()] * n, pa.int64()), "chunk": pa.array([r[0] for r in rows], pa.int32()), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()), "doc_score": pa.array([score] * n, pa.float64())})


def _traced(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(model)
        for batch in batches:
            ids = []
            for behind, body, ahead, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("behind", "body", "ahead", "enter", "leave"))):
                before, after = found.states(behind, body + ahead)[enter], found.states(behind + body, ahead)[leave]
                ids.append(found.trace(behind, body, ahead, before, after).astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"gid": batch.column("gid"), "chunk": batch.column("chunk"), "doc_score": batch.column("doc_score"), "ids": pa.array(ids, pa.binary())})

    return run


def _text_of(found: Pieces, ids: np.ndarray) -> str:
    """Text of ids; the space that encoding put first is taken off."""
    return found.decode(ids)[0].tobytes().decode("utf-8", "replace").removeprefix(" ")


def _joined(model: str, digest: bool):
    """Chunks of one document in order; as much memory as its ids take."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist()))
        data = b"".join(x for _, x in rows)
        ids = np.frombuffer(data, "<u4")
        out = {"gid": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "score": table.column("doc_score").slice(0, 1).combine_chunks()}
        if digest:
            out |= {"ids_crc32": pa.array([zlib.crc32(data)], pa.int64()), "text_crc32": pa.array([zlib.crc32(_text_of(pieces(model), ids).encode())], pa.int64())}
        else:
            out["ids"] = pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))
        return pa.table(out)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_tokens, score, ids array<int>), a row per row of `docs`.

    With `digest`, instead of ids: ids_crc32, of the ids as little-endian
    32-bit integers, and decoded, whether decoding the ids gives the text back
    (a literal U+2581 decodes as a space, as in the library). Null or empty
    text: no ids, score 0. Repeated rows each get their row. Other columns are
    not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "sentencepiece")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = pieces(model)
    giant = F.length("text") >= CHUNK if found.spaces_cut else F.length("text") > 0
    small_schema = "doc_id long, n_chars long, n_tokens long, score double, " + ("ids_crc32 long, decoded boolean" if digest else "ids array<int>")
    small = docs.where(~F.coalesce(giant, F.lit(False))).mapInArrow(_whole(model, digest), small_schema)

    big = tables.cut(docs.where(giant).withColumn("gid", F.xxhash64("doc_id", "text")))
    once = big.groupBy("gid").agg(F.first("text").alias("text"))
    chunks = tables.written(once, _chunked(found.most), "gid long, chunk int, behind string, body string, ahead string")
    spread = chunks.repartition(shuffle_width(spark), "gid", "chunk")
    matrices = spread.mapInArrow(_matrices(model), "gid long, chunk int, side int, matrix binary")
    states = matrices.groupBy("gid").applyInArrow(_states, "gid long, chunk int, enter int, leave int, doc_score double")
    traced = chunks.join(states, ["gid", "chunk"]).mapInArrow(_traced(model), "gid long, chunk int, doc_score double, ids binary")
    joined = traced.groupBy("gid").applyInArrow(_joined(model, digest), "gid long, n_tokens long, score double, " + ("ids_crc32 long, text_crc32 long" if digest else "ids array<int>"))
    rows = big.select("doc_id", "gid", F.length("text").cast("long").alias("n_chars"), F.crc32(F.replace(F.col("text"), F.lit(SPACE), F.lit(" ")).cast("binary")).alias("own_crc32")).join(joined, "gid")
    last = [F.col("ids_crc32"), (F.col("text_crc32") == F.col("own_crc32")).alias("decoded")] if digest else [F.col("ids")]
    return small.union(rows.select("doc_id", "n_chars", "n_tokens", "score", *last))


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(model)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([None if x is None else _text_of(found, np.array(x, np.int64)) for x in lists], pa.string())})

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give null text."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")
