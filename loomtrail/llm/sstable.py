"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending order of their identifier:

    block*          key entries, prefix-compressed against the key before (a restart each RESTART entries), with
                    each document's token count, then the ids of all its documents (little-endian, 16 bit where
                    they fit, else 32), zstd-compressed
    index           one entry a block: first key, offset, length, tokens before the block in this shard
    bloom filter    bits over the keys' hashes
    footer          offsets and lengths of index and filter, counts, crc32 of index and filter, magic

Keys are 9 bytes that sort like the identifiers: a byte for null or not, then the signed number, big-endian. `get`
asks the filter, then searches the sparse index in two halves and then one block.

Documents are dealt to shards by ranges of the identifier, sorted, and encoded as they are written. Files of failed
attempts stay unlisted: only the manifest's files count, and Spark commits the manifest.

Defined cases: a null text is empty (only the end id); null ids sort first; repeated ids are all kept, in the order
of their texts; an empty table gives an empty result; other columns are ignored. One document is encoded at a time
beyond BATCH_CHARS, so memory follows the longest text, not the shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, prepare, stored, utf8_bytes
from .tokens import tokenizer_path, vocabulary

END_ID, RESTART = 2, 16
BLOCK_TOKENS, BATCH_CHARS, SHARD_BYTES = 1 << 16, 1 << 22, 32 << 20
MAGIC, FOOTER = b"LTSST1\0\0", struct.Struct("<QQQQQQII8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bits(key: bytes, size: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + i * b) % size for i in range(BLOOM_HASHES)]


class Writer:
    def __init__(self, out):
        self.out, self.at, self.tokens, self.docs = out, 0, 0, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.first = self.last = None
        self._new()

    def _new(self):
        self.entries, self.ids, self.n, self.before, self.start = [], [], 0, b"", self.tokens

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if len(self.entries) % RESTART:
            while shared < 9 and key[shared] == self.before[shared]:
                shared += 1
        self.entries.append((key, bytes([shared]) + key[shared:] + struct.pack("<I", len(ids))))
        self.before = key
        self.ids.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        self.keys.append(key)
        self.first, self.last = self.first or key, key
        if self.n >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        import zstandard

        if not self.entries:
            return
        ids = np.concatenate(self.ids)
        width = 2 if ids.max(initial=0) < 1 << 16 else 4
        head = b"".join(e for _, e in self.entries)
        body = struct.pack("<IIB", len(self.entries), len(head), width) + head + ids.astype(f"<u{width}").tobytes()
        packed = zstandard.ZstdCompressor(level=1).compress(body)
        self.index.append((self.entries[0][0], self.at, len(packed), self.start))
        self.out.write(packed)
        self.at += len(packed)
        self._new()

    def close(self) -> None:
        self.flush()
        size = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros((size + 7) // 8, np.uint8)
        for key in self.keys:
            for b in _bits(key, size):
                bloom[b >> 3] |= 1 << (b & 7)
        index = b"".join(k + struct.pack("<QQQ", a, n, t) for k, a, n, t in self.index)
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), size, self.docs, self.tokens, crc32(index), crc32(bloom.tobytes()), MAGIC))


class Reader:
    """A shard in any seekable file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - FOOTER.size)
        at, n, bloom_at, self.size, self.docs, self.tokens, index_crc, bloom_crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        raw, bloom = file.read(n), file.read((self.size + 7) // 8)
        if (crc32(raw), crc32(bloom)) != (index_crc, bloom_crc):
            raise ValueError("a shard's index or filter is damaged")
        self.bloom = np.frombuffer(bloom, np.uint8)
        self.index = [(raw[i : i + 9], *struct.unpack_from("<QQQ", raw, i + 9)) for i in range(0, n, 33)]

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in this shard, ids) of each document of block k."""
        import zstandard

        _, at, length, start = self.index[k]
        self.file.seek(at)
        body = zstandard.ZstdDecompressor().decompress(self.file.read(length))
        n, head, width = struct.unpack_from("<IIB", body)
        ids, p, used, key = np.frombuffer(body, f"<u{width}", offset=9 + head), 9, 0, b""
        for _ in range(n):
            shared = body[p]
            key = key[:shared] + body[p + 1 : p + 10 - shared]
            (count,) = struct.unpack_from("<I", body, p + 10 - shared)
            p += 14 - shared
            yield key, start + used, ids[used : used + count]
            used += count

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.size)):
            return []
        firsts = [e[0] for e in self.index]
        low, high = max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)
        return [ids for k in range(low, high) for found, _, ids in self.block(k) if found == key]


MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int64())])


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = vocabulary(path)
        fs, base = filesystem(folder)
        writer = sink = None
        end = np.array([end_id], "<u4")
        pending: list[tuple[int | None, str]] = []

        def flush():
            for (doc, _), ids in zip(pending, vocab.ids([t for _, t in pending]), strict=True):
                writer.add(key_of(doc), np.concatenate([ids, end]))
            pending.clear()

        name, chars = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst", 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink)
                pending.append((doc, text or ""))
                chars += len(text or "")
                if chars >= BATCH_CHARS:
                    flush()
                    chars = 0
        if writer is not None:
            flush()
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((f"{folder}/{name}", id_of(writer.first), writer.docs, writer.tokens, TaskContext.get().partitionId()), MANIFEST, strict=True)], schema=MANIFEST)

    return run


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents; returns the manifest (a row a shard, in order of `shard`), with `start`: the ids of all shards before."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or fresh_path(spark, "sst")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(utf8_bytes())).first()[0] or 0
    shards = int(max(spark.sparkContext.defaultParallelism, total // SHARD_BYTES, 1))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = stored(dealt.mapInArrow(_write(folder, path or tokenizer_path(), end_id), "path string, first_id long, n_docs long, n_tokens long, shard long"), "sst-manifest")
    everything = Window.partitionBy(F.lit(0)).orderBy("shard")  # as many rows as shards
    return manifest.withColumn("start", F.sum("n_tokens").over(everything) - F.col("n_tokens"))


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                reader = Reader(f)
                for k in range(len(reader.index)):
                    rows = [(id_of(key), start + before, len(ids), crc32(ids.astype("<u4").tobytes())) for key, before, ids in reader.block(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=READ)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = manifest.select("path", "start")
    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[list[int]]]:
    """Ids of a few documents, by filter, sparse index and one block each."""
    out: dict[int | None, list[list[int]]] = {d: [] for d in doc_ids}
    for row in manifest.orderBy("shard").toLocalIterator():
        fs, name = filesystem(row["path"])
        with fs.open_input_file(name) as f:
            reader = Reader(f)
            for d in doc_ids:
                out[d] += [ids.tolist() for ids in reader.get(d)]
    return out
