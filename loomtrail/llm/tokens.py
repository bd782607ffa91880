"""Pre-tokens, and token counts without token ids.

Texts are split into pre-tokens exactly as the tokenizer splits them. Each distinct pre-token is encoded once, and
its number of pieces is joined to the pre-token frequencies of each document and summed:

1. documents are read in blocks of bounded size; a block yields its documents' frequencies over a numbering of the
   block's distinct pre-tokens (packed), and these pre-tokens, dealt into hash buckets (packed);
2. by bucket, each distinct pre-token is encoded once, and each block's share of the bucket gets its counts;
3. by block, counts meet frequencies and are summed.

Blocks and buckets are rows, so work is spread evenly whatever the frequency of a word or the length of a text, and
a frequent pre-token travels once per block, not once per document.

Defined cases: a null text is empty and has no tokens; repeated rows each get a row; null ids are kept; an empty
table gives an empty result; other columns are ignored. A special token's string inside a text is the special token,
as the library reads it by default.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, utf8_bytes

BLOCK_CHARS = 8 << 20
BUCKET_BYTES = 64 << 20  # input bytes a vocabulary bucket
LIMIT = 512
CACHE_ENTRIES = 700_000

# Letters that Python's `re` and the tokenizer's engine classify alike; other texts take the library's own splitter.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ȳ"
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{_LETTERS}]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
_WORD = re.compile(rf" [{_LETTERS}]+").fullmatch
_WORDS = re.compile(rf"[ {_LETTERS}]*").fullmatch
# The same splits on the UTF-8 bytes of plain texts, where all bytes beyond ASCII are of letters.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if chr(b).isspace() else _OTHER for b in range(256)], np.uint8)
WORDS_A_CALL = 32  # the library merges short texts faster, and each text has its own cost


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def starts(raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin: raw has their UTF-8 bytes one after another, firsts where each text begins."""
    n = len(raw)
    kind, code = _KIND[raw], np.append(raw, np.zeros(2, np.uint8))
    first, begin = np.zeros(n + 3, bool), np.ones(n + 3, bool)
    first[firsts] = first[n:] = True
    begin[1:n] = kind[1:] != kind[:-1]
    begin |= first
    # the last of some white space before something else stands alone, or if it is a blank, goes with what follows
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) + 1
    begin[after - 1] = True
    begin[after[raw[after - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero((raw == 39) & begin[:n])
    mark = mark[~first[mark + 1]]
    a, b = code[mark + 1], code[mark + 2]
    short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    long = ~first[mark + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
    begin[mark[short | long] + 1] = False
    begin[mark[short] + 2] = True
    begin[mark[long] + 3] = True
    return np.flatnonzero(begin[:n])


class Vocabulary:
    """The tokenizer of a file, by pre-tokens. Holds at most CACHE_ENTRIES encoded pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, decoders, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        # Where no token reaches from a word into the next one, the library's model takes joined words without splitting them again.
        model, bare = described["model"], decoders.ByteLevel()
        pieces = model["vocab"]
        settings = "unk_token", "dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"
        other = described.get("normalizer") or "Ġ" not in pieces or any(model.get(k) for k in settings)
        reaching = (bare.decode([p]).strip("\ufffd") for p in pieces if re.search("[^Ġ]Ġ", p))  # but for characters that are cut
        self.apart = not other and not any(map(_WORDS, reaching))
        self.leads = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.leads[[i for p, i in pieces.items() if p.startswith("Ġ")]] = True
        self.joined = Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, a special token's string as one."""
        if self.cut and any(s in text for s in self.special):
            return [p for i, part in enumerate(self.cut.split(text)) if part for p in ([part] if i % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, pretokens: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens. Words with a leading space split again as they were when joined, so many go in one call."""
        out: dict[str, list[int]] = {}
        words, rest = [], []
        for p in pretokens:
            (words if _WORD(p) else rest).append(p)
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            e = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids, at = e.ids, np.array(e.word_ids)
            edge = np.searchsorted(at, np.arange(len(some) + 1)).tolist()
            for i, p in enumerate(some):
                out[p] = ids[edge[i] : edge[i + 1]]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                out[p] = e.ids
        return out

    def learn(self, pretokens: Iterable[str]) -> None:
        """Encode pre-tokens that aren't known yet: a number for each, by which `ends` bounds its ids in `pool`."""
        words, rest = [], []
        for p in pretokens:
            (words if _WORD(p) else rest).append(p)
        pools, ends = [self.pool], [self.ends]
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            if self.apart:
                calls = ["".join(some[i : i + WORDS_A_CALL]) for i in range(0, len(some), WORDS_A_CALL)]
                ids = np.array([i for e in self.joined.encode_batch_fast(calls, add_special_tokens=False) for i in e.ids], "<u4")
                edge = np.append(np.flatnonzero(self.leads[ids]), len(ids))
            else:
                e = self.tokenizer.encode("".join(some), add_special_tokens=False)
                ids, edge = np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1))
            if len(edge) != len(some) + 1 or edge[0]:
                raise ValueError("joined words don't come apart")
            pools.append(ids)
            ends.append(edge[1:] + ends[-1][-1])
        for k in range(0, len(rest), 4096):
            some = [e.ids for e in self.tokenizer.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
            pools.append(np.array([i for ids in some for i in ids], "<u4"))
            ends.append(np.cumsum([len(ids) for ids in some]) + ends[-1][-1])
        self.pool, self.ends = np.concatenate(pools), np.concatenate(ends)
        self.known.update(zip(chain(words, rest), range(len(self.known), len(self.ends) - 1)))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, unsigned 32-bit. Plain texts are split and put together as arrays, without an object a pre-token."""
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        odd = [self.split(t) for t, p in zip(texts, plain, strict=True) if not p]
        parts = [t.encode("utf-8") for t, p in zip(texts, plain, strict=True) if p]
        data, edge = b"".join(parts), np.cumsum([0, *map(len, parts)])
        begins = starts(np.frombuffer(data, np.uint8), edge)
        found = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]).dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(which < 0)
        fresh = [names[i] for i in new.tolist()]
        self.learn(set(fresh).union(*odd).difference(self.known))

        def numbers(pretokens: list[str]) -> np.ndarray:
            return np.fromiter(map(self.known.__getitem__, pretokens), np.int64, len(pretokens))

        def put(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = self.ends[which]
            count = self.ends[which + 1] - at
            ends = np.cumsum(np.append(0, count))
            return self.pool[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])], ends

        which[new] = numbers(fresh)
        ids, ends = put(which[found.indices.to_numpy()])
        edge = ends[np.searchsorted(begins, edge)].tolist()
        of_plain, of_odd = zip(edge[:-1], edge[1:], strict=True), iter(odd)
        for p in plain:
            if p:
                a, b = next(of_plain)
                yield ids[a:b]
            else:
                yield put(numbers(next(of_odd)))[0]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays, byte planes apart, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return struct.pack(f"<{len(arrays) + 1}I", len(arrays), *map(len, arrays)) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n = struct.unpack_from("<I", blob)[0]
    lengths = struct.unpack_from(f"<{n}I", blob, 4)
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + 4 * n :], max_output_size=4 * sum(lengths) + 1), np.uint8), [], 0
    for k in lengths:
        out.append(np.ascontiguousarray(raw[at : at + 4 * k].reshape(4, k).T).view("<u4").reshape(-1))
        at += 4 * k
    return out


BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])
BLOCK_DDL = "block long, bucket int, blob binary, doc_ids array<long>, n_bytes array<long>"
POSTINGS, COUNTS = -1, -2


def _strings(blob: bytes) -> list[str]:
    import zstandard

    n = struct.unpack_from("<I", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=1 << 31)
    return raw.decode("utf-8").split("\x01", n)[:n] if b"\x01\x01" not in raw else json.loads(raw.split(b"\x01\x01", 1)[1])


def _join_strings(strings: list[str]) -> bytes:
    import zstandard

    plain = not any("\x01" in s for s in strings)
    raw = ("\x01".join(strings) if plain else "\x01\x01" + json.dumps(strings)).encode("utf-8")
    return struct.pack("<I", len(strings)) + zstandard.ZstdCompressor(level=1, write_content_size=True).compress(raw)


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, part = vocabulary(path), TaskContext.get().partitionId()
        number = 0

        def close(held):
            nonlocal number
            numbers, docs, sizes, index, freq, ends = held
            block, number = (part << 32) | number, number + 1
            where = np.fromiter((crc32(p.encode("utf-8")) % buckets for p in numbers), np.int32, len(numbers))
            order = np.argsort(where, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)  # the numbering that the buckets' order gives
            names, edge = list(numbers), np.searchsorted(where[order], np.arange(buckets + 1)).tolist()
            place = rank[np.array(index, np.int64)] if index else np.zeros(0, np.uint32)
            counts, lengths = np.array(freq, np.uint32), np.diff(np.array([0, *ends]))
            by_doc = np.lexsort((place, np.repeat(np.arange(len(lengths)), lengths)))
            place, counts = place[by_doc], counts[by_doc]
            rows = [(block, POSTINGS, _pack(np.diff(place, prepend=np.uint32(0)), counts, lengths, np.diff(np.array(edge))), docs, sizes)]
            rows += [(block, b, _join_strings([names[i] for i in order[edge[b] : edge[b + 1]].tolist()]), None, None) for b in range(buckets) if edge[b + 1] > edge[b]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), BLOCKS, strict=True)], schema=BLOCKS)

        held, chars = ({}, [], [], [], [], []), 0
        for batch in batches:
            for doc, text, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                numbers, docs, sizes, index, freq, ends = held
                for p, n in Counter(vocab.split(text or "")).items():
                    index.append(numbers.setdefault(p, len(numbers)))
                    freq.append(n)
                docs.append(doc)
                sizes.append(size)
                ends.append(len(index))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(docs) >= 20_000:
                    yield close(held)
                    held, chars = ({}, [], [], [], [], []), 0
        if held[1]:
            yield close(held)

    return run


def _count_buckets(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, now, pieces = vocabulary(path), None, {}
        for batch in batches:
            for block, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    now, pieces = bucket, {}
                names = _strings(blob)
                new = [p for p in names if p not in pieces]
                pieces.update((p, len(x)) for p, x in vocab.encode(new).items())
                counts = _pack(np.fromiter(map(pieces.__getitem__, names), np.uint32, len(names)), np.array([bucket]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([COUNTS], pa.int32()), pa.array([counts], pa.binary()), pa.array([None], BLOCKS[3].type), pa.array([None], BLOCKS[4].type)], schema=BLOCKS)

    return run


TOTALS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block come together, its counts (COUNTS sorts before POSTINGS) first."""
    counts: dict[int, np.ndarray] = {}
    now = None
    for batch in batches:
        for block, kind, blob, docs, sizes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if block != now:
                now, counts = block, {}
            if kind == COUNTS:
                c, (bucket,) = _unpack(blob)
                counts[int(bucket)] = c
                continue
            steps, freq, lengths, shares = _unpack(blob)
            if [len(counts.get(b, ())) for b in range(len(shares))] != shares.tolist():
                raise ValueError(f"block {block}: a bucket's counts are missing")
            pieces = np.concatenate([counts[b] for b in sorted(counts)] or [np.zeros(0, np.uint32)]).astype(np.int64)
            place = np.cumsum(steps.view(np.int32), dtype=np.int64)  # the steps wrap where a document starts anew
            sums = np.concatenate([[0], np.cumsum(pieces[place] * freq)])
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums[ends] - sums[ends - lengths], pa.int64())], schema=TOTALS)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), utf8_bytes().alias("n_bytes"))
    total = docs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    blocks = stored(docs.mapInArrow(_blocks(path, int(buckets)), BLOCK_DDL), "token-blocks")
    shares = blocks.where(F.col("bucket") >= 0).select("block", "bucket", "blob")
    counted = shares.repartition(int(max(buckets, 8)), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_count_buckets(path), BLOCK_DDL)
    met = blocks.where(F.col("bucket") == POSTINGS).unionByName(counted)
    parts = int(max(12, total // (32 << 20)))
    return (
        met.repartition(parts, "block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
