"""N-gram Jaccard join by rare-first prefixes.

A document's set holds its distinct word shingles. If two sets of n and m shingles have a Jaccard similarity of at
least t, then in one global order of all shingles, here from rare to frequent, the first n - ceil(t n) + 1 shingles of
one have one in common with those of the other. A shingle of a single document meets none, so most documents, whose
prefixes hold only such shingles, have no candidates at all.

1. Documents are read in blocks. A block yields its distinct shingles with local counts, dealt into buckets, and, for
   each shingle, the documents that have it (packed).
2. By bucket, counts are added up; each block's share learns which of its shingles are in two documents or more.
3. By block, documents get these shingles in rare-first order. Equal sets become one class.
4. Prefix shingles are joined in rounds: each unresolved shingle has one leader, the class with the smallest share of
   shingles that nobody else has (in later rounds, one for each of 16, 256 ... hash slots of the components left), which is paired with the classes of other components, not all pairs. Length, position and suffix (counts by hash range) must allow
   enough common shingles; pairs seen before drop out; the rest are verified once. Linked classes get one label,
   leaders retire, and a shingle whose classes all have one label is resolved. Each pair of classes with a common
   prefix shingle is thus either verified or already connected, so components are whole.

A frequent shingle travels once per block; a hot one gives as many pairs as it has classes and leaders. A shingle is hot if
it has more entries than HOT and than 1 in MOST_HOT of all, so that there are at most MOST_HOT such: they are broadcast, and
their entries are dealt to parts of that size, each met by copies of the shingle's few leaders.

Shingles are compared by 48 bits of their hashes: for two sets of 300, one in 3 billion pairs would count a common shingle
that they don't have; more bits would be most of what is shuffled.

Defined cases: null and empty texts have an empty set, link with nothing and are their own component; rows with null
ids link with nothing and have a null component; rows that repeat an id are one node; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored, utf8_bytes
from .graphs import merge_labels
from .shingles import WORDS, set_digest, shingle_sets

PERCENT = 75
BITS, RANGES = 48, 16
BLOCK_BYTES, BUCKET_BYTES, SLICE_CHARS = 6 << 20, 8 << 20, 1 << 20
LEADERS_GROW, HOT, MOST_HOT = 16, 128, 50_000
POSTINGS, REPEATED = -1, -2

BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
BLOCK_DDL = "block long, bucket int, blob binary, doc_ids array<long>"


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes, compressed."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return struct.pack(f"<{len(arrays) + 1}I", len(arrays), *map(len, arrays)) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n = struct.unpack_from("<I", blob)[0]
    lengths = struct.unpack_from(f"<{n}I", blob, 4)
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + 4 * n :], max_output_size=8 * sum(lengths) + 1), np.uint8), [], 0
    for k in lengths:
        out.append(np.ascontiguousarray(raw[at : at + 8 * k].reshape(8, k).T).view("<u8").reshape(-1))
        at += 8 * k
    return out


def _batch(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), BLOCKS, strict=True)], schema=BLOCKS)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _blocks(buckets: int, words: int):
    def close(block: int, doc_ids: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        digests, seen, grams, owners = [], set(), [], []
        for i, s in enumerate(sets):
            digests.append(set_digest(s))
            if digests[-1] not in seen:
                seen.add(digests[-1])
                g = np.unique(s >> np.uint64(64 - BITS))
                grams.append(g)
                owners.append(np.full(len(g), i, np.uint32))
        g, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(g, kind="stable")
        g, owner = g[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(g)))
        g = g[first]
        edge = np.searchsorted(g, (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(BITS - 32)) if buckets > 1 else np.zeros(0, np.int64)
        edge = [0, *edge.tolist(), len(g)]
        yield _batch((block, POSTINGS, pack(owner, counts, np.diff(edge), np.array([len(s) for s in sets]), np.frombuffer(b"".join(digests), "<u8")), doc_ids))
        for b in range(buckets):
            if edge[b + 1] > edge[b]:
                yield _batch((block, b, pack(_steps(g[edge[b] : edge[b + 1]]), counts[edge[b] : edge[b + 1]]), None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, sets, size, slice_ids, texts, chars = [], [], 0, [], [], 0

        def take():
            nonlocal chars
            sets.extend(shingle_sets(texts, words))
            ids.extend(slice_ids)
            texts.clear(), slice_ids.clear()
            chars = 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slice_ids.append(doc)
                texts.append(text or "")
                chars += len(texts[-1])
                size += len(texts[-1])
                if chars >= SLICE_CHARS:
                    take()
                if size >= BLOCK_BYTES or len(ids) + len(slice_ids) >= 50_000:
                    take()
                    yield from close(block, ids, sets)
                    block, ids, sets, size = block + 1, [], [], 0
        take()
        if ids:
            yield from close(block, ids, sets)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket come together: for each block's share, places, values and counts of what two documents have."""

    def close(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        shares = [unpack(blob) for _, blob in held]
        grams = [np.cumsum(s, dtype=np.uint64) for s, _ in shares]
        g, counts = np.concatenate(grams), np.concatenate([c for _, c in shares])
        order = np.argsort(g, kind="stable")
        new = np.concatenate([[True], g[order][1:] != g[order][:-1]])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        df = np.empty(len(g), np.uint64)
        df[order] = sums[np.cumsum(new) - 1]
        at = 0
        for (block, _), own in zip(held, grams, strict=True):
            some = df[at : at + len(own)]
            places = np.flatnonzero(some >= 2)
            yield _batch((block, REPEATED, pack(np.array([bucket]), _steps(places), _steps(own[places]), some[places]), None))
            at += len(own)

    now, held = None, []
    for batch in batches:
        for block, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now:
                if held:
                    yield from close(now, held)
                now, held = bucket, []
            held.append((block, blob))
    if held:
        yield from close(now, held)


SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("grams", pa.list_(pa.int64())), ("prefix", pa.int32()), ("ranges", pa.list_(pa.int32()))])
SET_DDL = "doc_id long, n_shingles long, digest binary, grams array<long>, prefix int, ranges array<int>"


def _prefixes(percent: int):
    def close(replies: list[bytes], postings: bytes, doc_ids: list) -> Iterator[pa.RecordBatch]:
        owner, counts, shares, sizes, digests = unpack(postings)
        starts, ends = np.concatenate([[0], np.cumsum(shares)]).astype(np.int64), np.cumsum(counts).astype(np.int64)
        places, values, dfs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for (bucket,), steps, own, df in map(unpack, replies):
            places.append(starts[int(bucket)] + np.cumsum(steps).astype(np.int64))
            values.append(np.cumsum(own, dtype=np.uint64))
            dfs.append(df)
        place, value, df = map(np.concatenate, (places, values, dfs))
        many = counts[place].astype(np.int64)
        entry = np.repeat(ends[place] - many - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many, many) + np.arange(many.sum())
        doc, value, df = owner[entry].astype(np.int64), np.repeat(value, many), np.repeat(df, many)
        order = np.lexsort((value, df, doc))
        doc, value = doc[order], value[order]
        edge = np.searchsorted(doc, np.arange(len(doc_ids) + 1)).tolist()
        sizes, digest = sizes.astype(np.int64).tolist(), digests.tobytes()
        rows = []
        for i, doc_id in enumerate(doc_ids):
            n, own = sizes[i], value[edge[i] : edge[i + 1]]
            prefix = n + 1 - -(-n * percent // 100) - (n - len(own))  # of the rare-first order, where single ones come first
            grams = ranges = None
            if len(own) and prefix > 0:
                grams, ranges = own.astype(np.int64), np.bincount((own >> np.uint64(BITS - 4)).astype(int), minlength=RANGES).astype(np.int32)
            rows.append((doc_id, n, digest[16 * i : 16 * i + 16], grams, max(0, prefix) if grams is not None else 0, ranges))
            if len(rows) == 256 or i == len(doc_ids) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SETS, strict=True)], schema=SETS)
                rows = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replies = None, []
        for batch in batches:
            for block, kind, blob, doc_ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    now, replies = block, []
                if kind == REPEATED:
                    replies.append(blob)
                else:
                    yield from close(replies, blob, doc_ids)

    return run


def rare_first_sets(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and, where the prefix is not all single shingles, grams (those of two
    documents or more, rare first), prefix (how many of them are in the prefix) and ranges (their counts by range)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = int(rows.agg(F.sum(utf8_bytes())).first()[0] or 0)
    buckets = max(12, -(-total // BUCKET_BYTES))
    blocks = stored(rows.mapInArrow(_blocks(buckets, words), BLOCK_DDL), "shingle-blocks")
    replies = blocks.where(F.col("bucket") >= 0).drop("doc_ids").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_repeated, BLOCK_DDL)
    met = blocks.where(F.col("bucket") == POSTINGS).unionByName(replies)
    out = stored(met.repartition(max(12, total // BLOCK_BYTES), "block").sortWithinPartitions("block", "bucket").mapInArrow(_prefixes(percent), SET_DDL), "shingle-sets")
    discard(blocks)
    return out


def _enough(percent: int, common: str) -> str:
    return f"{common} * {100 + percent} >= {percent} * (a_n + b_n)"


def link_classes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, label: the component of each class (id, n, grams, prefix, ranges) that meets another."""
    explode = classes.select("id", F.col("n").cast("int").alias("n"), (F.col("n") - F.size("grams")).cast("int").alias("single"), F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("place", "gram"))
    # a set with few shingles of its own alone is near the middle of its copies, and so a good leader
    entries = explode.select("gram", "id", "n", (F.col("single") + F.col("place")).alias("at"), F.floor(100 * F.col("single") / F.col("n")).cast("byte").alias("lone"))
    shared = entries.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("many")).where("low < high").select("gram", "many")
    shared = stored(shared, "shared")
    most = max(HOT, (shared.agg(F.sum("many")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(shared.where(F.col("many") > most).select("gram", F.ceil(F.col("many") / most).cast("int").alias("parts")))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = entries.join(hot, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    known = salted(shared.select("gram", F.greatest(F.lit(1), F.when(F.col("many") > most, F.ceil(F.col("many") / most)).otherwise(1)).cast("int").alias("parts")))
    live = stored(dealt.join(known.select("gram", "salt"), ["gram", "salt"]), "entries")
    labels = stored(live.select("id").distinct().withColumn("label", F.col("id")), "labels")
    grams = stored(classes.join(labels.select("id"), "id").select("id", "grams", "ranges"), "grams")
    done, few, pairs_written, held = None, 1, [], live
    while not live.isEmpty():
        if done is None:
            live = live.withColumn("label", F.col("id"))
        else:
            marked = live.drop("label").join(labels, "id")
            open_ = salted(marked.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("parts").alias("parts")).where("low < high"))
            live = stored(marked.join(open_.select("gram", "salt"), ["gram", "salt"]), "live")
            discard(held)
            held = live
        leaders = live.groupBy("gram", F.pmod(F.xxhash64("label"), F.lit(few)).alias("slot")).agg(F.min(F.struct("lone", "id", "label", "n", "at")).alias("lead"), F.first("parts").alias("parts"))
        leaders = stored(leaders.select("gram", "parts", F.col("lead.id").alias("a"), F.col("lead.label").alias("a_label"), F.col("lead.n").alias("a_n"), F.col("lead.at").alias("a_at")), "leaders")
        other = live.select("gram", "salt", F.col("id").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
        met = (
            other.join(salted(leaders), ["gram", "salt"])
            .where("a <> b AND a_label <> b_label")
            .where(f"least(a_n, b_n) * 100 >= {percent} * greatest(a_n, b_n)")  # length
            .where(_enough(percent, "least(a_n - a_at, b_n - b_at)"))  # position
        )
        smaller = F.col("a") < F.col("b")
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(smaller, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.when(smaller, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        pairs_written.append(pairs)
        done = pairs.select("a", "b") if done is None else done.union(pairs.select("a", "b"))
        ranges = lambda s: grams.select(F.col("id").alias(s), F.col("ranges").alias(s + "_ranges"))
        suffix = _enough(percent, "aggregate(zip_with(a_ranges, b_ranges, (x, y) -> least(x, y)), 0, (s, x) -> s + x)")
        pairs = pairs.join(ranges("a"), "a").join(ranges("b"), "b").where(suffix).select("a", "b", "a_n", "b_n")
        side = lambda s: grams.select(F.col("id").alias(s), F.col("grams").alias(s + "_grams"))
        links = pairs.join(side("a"), "a").join(side("b"), "b").where(_enough(percent, "size(array_intersect(a_grams, b_grams))"))
        links = stored(links.select("a", "b").distinct(), "links")
        labels = merge_labels(labels, links)
        live = stored(live.join(leaders.select("gram", F.col("a").alias("id")), ["gram", "id"], "left_anti"), "live")
        discard(held, leaders, links)
        held = live
        few *= LEADERS_GROW
    discard(held, grams, shared, *pairs_written)
    return labels


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs."""
    sets = rare_first_sets(docs, percent, words)
    mine = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    by_class = mine.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("grams", True).alias("grams"), F.max("prefix").alias("prefix"), F.first("ranges", True).alias("ranges"))
    classes = stored(by_class, "classes")
    # an id in several classes joins them
    twice = mine.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id")
    own = mine.join(twice, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest")
    labels = link_classes(classes.where("grams IS NOT NULL").select("id", "n", "grams", "prefix", "ranges"), percent)
    if not own.isEmpty():
        more = own.groupBy("doc_id").agg(F.min("id").alias("low")).join(own, "doc_id").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
        labels = labels.union(classes.select("id").distinct().join(labels.select("id"), "id", "left_anti").withColumn("label", F.col("id")))
        labels = merge_labels(stored(labels, "labels"), stored(more.distinct(), "links"))
    of_class = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    known = sets.select("doc_id", "n_shingles", "digest")
    return known.join(of_class, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )
