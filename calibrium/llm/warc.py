"""WARC archives, a normaliser of monolithic gzip files, and indexed reading (op4).

An archive compressed as one gzip stream can only be read from its beginning.
The normaliser inflates such a file once, as a stream, writes every record as a
gzip member of its own and, beside the archive, an index of the members'
offsets. After that any record is one ranged read.

Files live in the shared folder and are named anew by every task attempt; the
tables of files that stages hand on name those of successful attempts only.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import make_folder, opened
from ._shared import Tables, shared_folder, shuffle_width, small_batches

DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are never revisits.
LEAST = 1000
#: Bytes before compression after which a task begins another archive; bytes of an index run.
ARCHIVE, RUN, READ = 256 << 20, 4 << 20, 1 << 16
GZIP = 16 + zlib.MAX_WBITS


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # a line break in a url would end the header line
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of inflated bytes; holds one record at a time."""
    held = bytearray()
    for part in stream:
        held += part
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            stop = end + 4 + int(parse_header(bytes(held[at:end]))["content-length"]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(file) -> Iterator[bytes]:
    """Inflate all gzip members of a file, a part at a time."""
    z = zlib.decompressobj(GZIP)
    while data := file.read(READ):
        while data:
            yield z.decompress(data)
            data = b""
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(GZIP)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, z, n, size, uri = [], None, None, 0, 0, ""
        for batch in batches:
            html = pc.fill_null(batch.column("html"), "").cast(pa.binary()).to_pylist()
            c = [batch.column(k).to_pylist() for k in ("page_id", "url", "digest", "refers_to", "revisit")]
            for payload, page_id, url, digest, refers_to, revisit in zip(html, *c):
                if out is None:
                    uri = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
                    f, path = opened(uri)
                    out, z, n, size = f.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                data = record(page_id, url, payload, digest, refers_to, revisit)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE:
                    out.write(z.flush())
                    out.close()
                    done.append((uri, n))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((uri, n))
        yield pa.RecordBatch.from_pydict({"uri": pa.array([x[0] for x in done], pa.string()), "n_records": pa.array([x[1] for x in done], pa.int64())})

    return run


def normalise_file(uri: str, folder: str) -> tuple[str, str, int]:
    """Rewrite one archive with a gzip member per record; (archive, index, records).

    The index has a line `offset length type record-id` for each record.
    """
    name = f"{folder}/records-{uuid.uuid4().hex}"
    f, path = opened(uri)
    g, to = opened(f"{name}.warc.gz")
    n = at = 0
    with f.open_input_stream(path, compression=None) as src, g.open_output_stream(to, compression=None) as out, g.open_output_stream(f"{to}.idx") as index:
        for r in records(inflated(src)):
            head = parse_header(r[: r.index(b"\r\n\r\n")])
            data = member(r)
            out.write(data)
            index.write(f"{at} {len(data)} {head['warc-type']} {head['warc-record-id']}\n".encode())
            at, n = at + len(data), n + 1
    return f"{name}.warc.gz", f"{name}.warc.gz.idx", n


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                archive, index, n = normalise_file(uri, folder)
                yield pa.RecordBatch.from_pydict({"uri": [archive], "index": [index], "source": [uri], "n_records": pa.array([n], pa.int64())})

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, index) to runs of records: (uri, offset, lengths)."""
    for batch in batches:
        for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f, path = opened(index)
            starts, lengths, size = [], [], RUN
            with f.open_input_stream(path, compression=None) as src:
                for line in src.read().splitlines():
                    offset, length = map(int, line.split(b" ", 2)[:2])
                    if size + length > RUN:
                        starts.append(offset)
                        lengths.append([])
                        size = 0
                    lengths[-1].append(length)
                    size += length
            yield pa.RecordBatch.from_pydict({"uri": pa.array([uri] * len(starts), pa.string()), "offset": pa.array(starts, pa.int64()), "lengths": pa.array(lengths, pa.list_(pa.int64()))})


def read_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record's bytes."""
    end = data.index(b"\r\n\r\n")
    head = parse_header(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].partition(":")[2]
    page_id = page_of(head["warc-record-id"])
    if head["warc-type"] == "revisit":
        return page_id, int(parse_header(http)["content-length"]), digest, "revisit", page_of(head["warc-refers-to"])
    own = hashlib.sha1(payload).hexdigest()
    if own != digest:
        raise ValueError(f"record of page {page_id}: its payload has another digest")
    return page_id, len(payload), own, "response", None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uri, offset, lengths in zip(*(batch.column(k).to_pylist() for k in range(3))):
            f, path = opened(uri)
            with f.open_input_file(path) as src:
                data = src.read_at(sum(lengths), offset)
            at = 0
            for n in lengths:
                out.append(read_record(zlib.decompress(data[at : at + n], GZIP)))
                at += n
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(kinds.items())})


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of `pages` to monolithic archives; (uri, n_records).

    Of rows with equal payloads of LEAST bytes or more, those with the largest
    page id are responses (several only where rows repeat that id) and the
    others revisit it. Null html is an empty payload. A null page id is less
    than any other; where it is the largest, all are responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    make_folder(folder)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # Digests and ids meet without payloads; payloads are dealt by id and digest, so a page that is
    # repeated very often is spread.
    ids = rows.where(F.octet_length("html") >= LEAST).select("page_id", "digest")
    long = ids.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").drop("n")
    marks = ids.distinct().join(long, "digest").where(~F.col("page_id").eqNullSafe(F.col("target")))
    marks = marks.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "target")
    judged = rows.join(marks.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    judged = judged.select("page_id", "url", "html", "digest", F.col("target").alias("refers_to"), F.col("target").isNotNull().alias("revisit"))
    return Tables(spark, "warc").cut(judged.mapInArrow(_write(folder), "uri string, n_records long"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (uri) of any gzip layout; (uri, index, source, n_records)."""
    spark = archives.sparkSession
    make_folder(folder)
    spread = archives.select("uri").repartition(shuffle_width(spark), "uri")
    return Tables(spark, "warc").cut(spread.mapInArrow(_normalise(folder), "uri string, index string, source string, n_records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, by their indexes, in runs of a few MB."""
    width = shuffle_width(archives.sparkSession)
    runs = archives.select("uri", "index").repartition(width, "uri").mapInArrow(_runs, "uri string, offset long, lengths array<long>")
    return runs.repartition(width, "uri", "offset").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages`, normalise the archives and read them back: a row per row.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). Empty
    table: no archive and no rows. Other columns are not read.
    """
    folder = shared_folder(pages.sparkSession, "warc-files")
    return read_archives(normalise(write_archives(pages, f"{folder}/whole"), f"{folder}/records"))
