"""Token-ID output in fixed-width bit-packed files (op9).

Documents are dealt to buckets of ascending id; each bucket is written as one
file. A file has the magic, blocks of `BLOCK` ids, each id in the fewest bits
the vocabulary needs (most significant bit first, a block padded to bytes), and
a footer: ids and token counts of its documents, the byte offset of each block.
The footer's place is in the last 24 bytes, so any range of ids is read with
two seeks and unpacked by numpy. Where a file's ids start in the whole corpus
is in the manifest, a running sum over files.

A task names each file anew and the manifest has the names of the attempts
that succeeded, so a lost executor leaves at most a file nobody refers to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._files import make_folder, opened
from ._kernels import utf8
from ._shared import Tables, ordered_buckets, shared_folder, shuffle_width, small_batches
from ._word_ids import word_ids

MAGIC, BLOCK, END_ID = b"CBIDS001", 1 << 16, 1


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits, most significant first; the end padded with zeros."""
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return wide[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 4 - bits // 8 :] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        each = np.zeros((n, 32), np.uint8)
        each[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
        wide = np.packbits(each, axis=1)
    return wide.view(">u4").ravel().astype(np.uint32)


class Writer:
    """Streams ids to one file, a block at a time."""

    def __init__(self, uri: str, bits: int):
        f, path = opened(uri)
        self.out, self.bits, self.at = f.open_output_stream(path), bits, len(MAGIC)
        self.out.write(MAGIC)
        self.rest, self.held, self.docs, self.counts, self.blocks, self.n = [], 0, [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], [len(ids)], ids)

    def extend(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        """Documents of `counts` ids each, their ids one after the other."""
        self.docs += doc_ids
        self.counts += counts
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= BLOCK:
            flat = np.concatenate(self.rest)
            whole = self.held // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.rest, self.held = [flat[whole:]], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.rest))
        foot = self.at
        known = np.array([x is not None for x in self.docs], np.uint8)
        for part in (np.array([x or 0 for x in self.docs], "<i8"), known, np.array(self.counts, "<u8"), np.array(self.blocks, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<QQII", foot, self.n, len(self.docs), self.bits))
        self.out.close()
        return self.n, len(self.docs)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        f, path = opened(uri)
        self.file = f.open_input_file(path)
        size = self.file.size()
        foot, self.n, docs, self.bits = struct.unpack("<QQII", self.file.read_at(24, size - 24))
        raw = self.file.read_at(size - 24 - foot, foot)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.known = np.frombuffer(raw, np.uint8, docs, docs * 8)
        self.counts = np.frombuffer(raw[docs * 9 : docs * 17], "<u8").astype(np.int64)
        self.blocks = np.frombuffer(raw[docs * 17 :], "<u8").astype(np.int64)
        self.ends = np.concatenate((self.blocks[1:], [foot]))
        self._at, self._ids = -1, np.empty(0, np.uint32)

    def _read(self, k: int) -> np.ndarray:
        if k != self._at:
            n = min(BLOCK, self.n - k * BLOCK)
            self._at, self._ids = k, unpack(self.file.read_at(int(self.ends[k] - self.blocks[k]), int(self.blocks[k])), n, self.bits)
        return self._ids

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, skip = divmod(start, BLOCK)
            part = self._read(k)[skip : skip + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _write(folder: str, tokenizer: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, writer, uri, done = None, None, "", []

        def finish():
            if writer is not None:
                done.append((bucket, uri, *writer.close()))

        for batch in batches:
            buckets, names = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ids, at = word_ids(tokenizer).encode_all(*utf8(batch.column(2)))
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(names) else np.empty(0, np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)]):
                if (b := int(buckets[lo])) != bucket or writer is None:
                    finish()
                    bucket, uri = b, f"{folder}/ids-{b + 1:06d}-{uuid.uuid4().hex}.bin"
                    writer = Writer(uri, bits)
                writer.extend(names[lo:hi], np.diff(at[lo : hi + 1]).tolist(), ids[at[lo] : at[hi]])
        finish()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in done], pa.int64()), "uri": pa.array([x[1] for x in done], pa.string()), "n_ids": pa.array([x[2] for x in done], pa.int64()), "n_docs": pa.array([x[3] for x in done], pa.int64())})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            r = Reader(uri)
            starts = np.concatenate(([0], np.cumsum(r.counts)[:-1])).astype(np.int64)
            crc = [zlib.crc32(np.ascontiguousarray(r.ids(int(s), int(n)), "<u4").tobytes()) for s, n in zip(starts, r.counts)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r.doc_ids, mask=r.known == 0), "start": pa.array(starts + base), "n_tokens": pa.array(r.counts), "ids_crc32": pa.array(crc, pa.int64())})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode `docs` and write them to `folder`; the manifest (bucket, uri, n_ids, n_docs, start).

    Files follow ascending id, rows of equal id follow their texts, and null
    ids come first. Null text is empty: its ids are the end id alone. An empty
    table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    make_folder(folder)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt, _ = ordered_buckets(docs, "doc_id")
    dealt = dealt.select("bucket", "doc_id", "text").repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "text")
    manifest = Tables(spark, "token-manifest").cut(dealt.mapInArrow(_write(folder, tokenizer, bits_for(vocabulary), end_id), "bucket long, uri string, n_ids long, n_docs long"))
    # One row per file, not per document: a running sum over it is small.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    spread = manifest.select("uri", "start").repartition(shuffle_width(manifest.sparkSession), "uri")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """Write `docs` as token files in the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, vocabulary))
