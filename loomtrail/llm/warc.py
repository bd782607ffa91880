"""WARC archives through a chunked record table.

Payloads become rows (record, chunk number, bytes) of bounded size, each with the digest and length of the payload so far.
A writer takes these rows as a stream: it opens a record at chunk 0, compresses and digests chunk after chunk, compares
each running digest with the row's, and the last one with that which the header announced, so it never holds a record.
Reading gives chunk rows again. Each record is a gzip member of its own.

Equal payloads of at least MIN_REVISIT bytes are stored once, with the smallest identifier; the others revisit it. Revisits
are found on narrow rows (identifier, digest). Chunk rows stay where they are as long as there are no more than
BROADCAST_REVISITS revisits, which are then sent to all tasks; beyond that, chunk rows are dealt by record.

Defined cases: a null payload is empty; an empty or short payload is always a response; rows that repeat the smallest
identifier of their payload are responses too; a row without identifier is a response and refers to nothing; a null
URL is empty; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, prepare, stored

CHUNK, MIN_REVISIT, ARCHIVE_BYTES = 1 << 16, 100, 1 << 30
BROADCAST_REVISITS, ROWS = 500_000, 256  # at about 100 bytes a revisit; chunk rows in a batch
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


CHUNK_ROWS = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.binary()), ("chunk", pa.int32()), ("last", pa.int32()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.binary()), ("data", pa.binary())])
CHUNK_ROWS_DDL = "record long, page_id long, url string, payload_bytes long, payload_digest binary, chunk int, last int, bytes_so_far long, digest_so_far binary, data binary"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunks(size: int, with_data: bool):
    """Chunk rows of (page_id, url, html). Slices of the batch's own memory: no payload is copied as a whole."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        record = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page, url, payload in zip(ids, urls, batch.column(2).cast(pa.binary()), strict=True):
                held = payload.as_buffer() if payload.is_valid else None
                view = memoryview(held if held is not None else b"")
                n = len(view)
                last = max(-(-n // size), 1) - 1
                sha, so_far = hashlib.sha256(), []
                for k in range(last + 1):
                    sha.update(view[k * size : (k + 1) * size])
                    so_far.append(sha.digest() if k == last else sha.copy().digest())
                for k in range(last + 1) if with_data else (last,):
                    yield record, page, url, n, so_far[-1], k, last, min(n, (k + 1) * size), so_far[k], bytes(view[k * size : (k + 1) * size]) if with_data else None
                record += 1

    return lambda batches: _batches(rows(batches), CHUNK_ROWS)


def chunk_records(pages: DataFrame, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all pages, in order within a record; without data only the last row of each record, with its whole digest."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_chunks(size, with_data), CHUNK_ROWS_DDL)


def revisits_of(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to of the records that revisit another."""
    seen = chunk_records(pages, with_data=False).where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= MIN_REVISIT)).select("page_id", "payload_digest")
    seen = stored(seen, "payload-digests")
    first = seen.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return stored(seen.join(first, "payload_digest").where("page_id > refers_to").distinct().select("page_id", "payload_digest", "refers_to"), "revisits")


def plan_chunks(pages: DataFrame) -> DataFrame:
    """Chunk rows with record_type and refers_to; of a revisit only the first, without data."""
    revisits, rows = revisits_of(pages), chunk_records(pages)
    if revisits.count() <= BROADCAST_REVISITS:
        met = rows.join(F.broadcast(revisits), ["page_id", "payload_digest"], "left")
    else:
        met = rows.join(revisits.hint("merge"), ["page_id", "payload_digest"], "left").sortWithinPartitions("page_id", "payload_digest", "record", "chunk")
    again = F.col("refers_to").isNotNull()
    return met.where(~again | (F.col("chunk") == 0)).select(
        "page_id",
        "url",
        "payload_bytes",
        F.lower(F.hex("payload_digest")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "refers_to",
        "chunk",
        F.when(again, 0).otherwise(F.col("last")).alias("last"),
        F.when(again, F.lit(b"")).otherwise(F.col("digest_so_far")).alias("digest_so_far"),
        F.when(again, F.lit(b"")).otherwise(F.col("data")).alias("data"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _header(page_id, url, n, digest, kind, refers_to) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {n}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(HTTP) + (n if kind == 'response' else 0)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, count, size = None, "", 0, 0
        gz = sha = None

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((f"{folder}/{name}", count, size), MANIFEST, strict=True)], schema=MANIFEST)

        for batch in batches:
            for page, url, n, digest, kind, refers, chunk, last, so_far, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                if chunk == 0:
                    gz, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
                    put(gz.compress(_header(page, url, n, digest, kind, refers) + HTTP))
                sha.update(data)
                put(gz.compress(data))
                if kind == "response" and (sha.digest() != so_far or chunk == last and so_far.hex() != digest):
                    raise ValueError(f"record {page}: the chunks do not make up the announced payload")
                if chunk == last:
                    put(gz.compress(b"\r\n\r\n") + gz.flush())
                    count += 1
                    if size >= most:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; returns the manifest (path, n_records, n_bytes). Files of failed attempts stay unlisted."""
    spark = pages.sparkSession
    prepare(spark)
    return stored(plan_chunks(pages).mapInArrow(_write(folder or fresh_path(spark, "warc"), archive_bytes), "path string, n_records long, n_bytes long"), "warc-manifest")


CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])
CHUNK_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, is_last boolean, bytes_so_far long, digest_so_far string, data binary"


def _page(urn: str) -> int | None:
    text = urn.rpartition(":")[2].rstrip(">")
    return None if text == "none" else int(text)


def records_of(file, size: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of an open .warc.gz file."""
    f = gzip.GzipFile(fileobj=file)
    while line := f.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"a record should begin here: {line[:40]!r}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        left = int(head["Content-Length"])
        while left:  # the HTTP header
            line = f.readline()
            left -= len(line)
            if line == b"\r\n":
                break
        sha, so_far, chunk = hashlib.sha256(), 0, 0
        fixed = (_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"))
        while True:
            data = f.read(min(size, left))
            if len(data) < min(size, left):
                raise ValueError("an archive ends within a record")
            left -= len(data)
            so_far += len(data)
            sha.update(data)
            yield (*fixed, chunk, not left, so_far, sha.copy().hexdigest(), data)
            chunk += 1
            if not left:
                break
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _read(with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    fs, name = filesystem(path)
                    with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as file:
                        for row in records_of(file):
                            if row[2] == "response" and row[7] and (row[8], row[9]) != (row[4], row[5]):
                                raise ValueError(f"record {row[0]}: its payload is damaged")
                            yield row if with_data else (*row[:10], None)

        return _batches(rows(), CHUNKS)

    return run


def read_chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives: chunk, is_last, bytes_so_far, digest_so_far, data. Payloads are verified."""
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(_read(with_data), CHUNK_DDL)


def read_records(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row a record, read from the archives.

    Of a response, bytes and digest are those of the chunks read; of a revisit, those its header announces."""
    own = F.col("record_type") == "response"
    return read_chunks(manifest, with_data=False).where("is_last").select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
