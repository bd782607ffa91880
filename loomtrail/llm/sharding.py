"""Sharding by fixed virtual slots.

Records are hashed into a few thousand slots that never change. Bytes are added up per slot, and a small versioned
table says which shard holds each slot; rebalancing adds a version to that table and never changes the hash. The newest
version counts. The first one puts the largest slot first into the shard with the fewest bytes, so shard sizes are near
equal (law `bytes`). A map has a row for every slot, also for those without records yet, so no record is lost later.

The hash takes id and text, so a group of equal texts, however large, is spread over the slots; the law binds sizes only and
doesn't keep groups together. Rows that repeat both id and text are counted before they are ranked, so they are no hot key.

Defined cases: a null text has no bytes, and every record counts one byte more; null ids hash like the text alone;
repeated rows are all kept and get slots of their own; ties are ordered by id, then checksum; an empty table gives
an empty result; other columns are carried along by assign_shards, but for columns named like its own (`names`), in any case,
which its own replace, and ignored elsewhere.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8_bytes, without

N_SLOTS, REPEATS = 4096, 1 << 16
MAP = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def slot_of(n_slots: int) -> Column:
    """The text takes part in the hash, so that one id with many texts is spread."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int")


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """docs and virtual_slot, size."""
    return docs.withColumns({"virtual_slot": slot_of(n_slots), "size": utf8_bytes() + 1})


def slot_bytes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(slots: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """slots: (slot, bytes, rows). Largest first, into the shard with the fewest bytes and, among these, slots."""
    heap = [(0, 0, s) for s in range(n_shards)]
    out = []
    for slot, size, rows in sorted(slots, key=lambda x: (-x[1], x[0])):
        held, many, shard = heapq.heappop(heap)
        out.append((1, slot, shard, size, rows))
        heapq.heappush(heap, (held + size, many + 1, shard))
    return sorted(out)


def rebalance(slot_map: list[tuple[int, int, int, int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """The next version of a map for a new number of shards, moving few slots: those of dropped shards, and, from
    the fullest shards, whole slots that fit under the mean into the emptiest."""
    version = max((m[0] for m in slot_map), default=0) + 1
    held = {s: 0 for s in range(n_shards)}
    own: dict[int, list[tuple[int, int, int]]] = {s: [] for s in range(n_shards)}
    loose = []
    for _, slot, shard, size, rows in slot_map:
        if shard < n_shards:
            own[shard].append((size, slot, rows))
            held[shard] += size
        else:
            loose.append((size, slot, rows))
    mean = sum(m[3] for m in slot_map) / max(1, n_shards)
    for shard in range(n_shards):
        for item in sorted(own[shard], reverse=True):
            if held[shard] - item[0] >= mean:
                own[shard].remove(item)
                held[shard] -= item[0]
                loose.append(item)
    for item in sorted(loose, key=lambda x: (-x[0], x[1])):
        shard = min(held, key=lambda s: (held[s], s))
        own[shard].append(item)
        held[shard] += item[0]
    return sorted((version, slot, shard, size, rows) for shard, items in own.items() for size, slot, rows in items)


def _measured(docs: DataFrame, n_slots: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most n_slots rows come to the driver."""
    own = dict.fromkeys(range(n_slots), (0, 0))
    return own | {slot: (size, rows) for slot, size, rows in slot_bytes(with_slots(docs.select("doc_id", "text"), n_slots)).collect()}


def _stored_map(docs_or_map: DataFrame, rows: list[tuple]) -> DataFrame:
    return stored(docs_or_map.sparkSession.createDataFrame(rows, MAP).coalesce(1), "slot-map")


def build_map(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The first slot-to-shard map of docs, with a row for each slot, written to the shared folder."""
    return _stored_map(docs, first_map([(s, *x) for s, x in _measured(docs, n_slots).items()], n_shards))


def newest(slot_map: DataFrame) -> DataFrame:
    """The rows of the map's newest version."""
    return slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version")


def edit_map(slot_map: DataFrame, n_shards: int, docs: DataFrame | None = None) -> DataFrame:
    """All versions of the map and a new one, rebalanced for n_shards, written to the shared folder. With docs, slots are measured anew."""
    rows = [tuple(r) for r in newest(slot_map).select("version", "virtual_slot", "shard", "bytes", "n_rows").collect()]
    if docs is not None:
        now = _measured(docs, len(rows))
        rows = [(v, slot, shard, *now[slot]) for v, slot, shard, _, _ in rows]
    older = [tuple(r) for r in slot_map.select("version", "virtual_slot", "shard", "bytes", "n_rows").collect()]
    return _stored_map(slot_map, older + rebalance(rows, n_shards))


def assign_shards(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS, names: tuple[str, str, str] = ("virtual_slot", "size", "shard")) -> DataFrame:
    """docs, virtual_slot, size and shard, under these names, without a shuffle: a version of the map has n_slots rows."""
    own = newest(slot_map).select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = [F.col(f"`{c}`") for c in without(docs, *names).columns]
    slotted = docs.select(*kept, slot_of(n_slots).alias("__slot"), (utf8_bytes() + 1).alias("__size"))
    return slotted.join(F.broadcast(own), "__slot").select(*kept, *[F.col(c).alias(n) for c, n in zip(("__slot", "__size", "__shard"), names, strict=True)])


def place(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, and `slot`: the record's place in its shard, gapless from 0.

    Places are counted within virtual slots, and each virtual slot starts after those before it in its shard, so
    no task sees a whole shard. Equal rows are one until their places are known, and then are dealt out in blocks of REPEATS.
    """
    rows = with_slots(docs.select("doc_id", "text"), n_slots).select("virtual_slot", "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("many"))
    filled = newest(slot_map).select("virtual_slot", "shard").join(F.broadcast(slot_bytes(with_slots(docs.select("doc_id", "text"), n_slots))), "virtual_slot")
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")
    starts = filled.select("virtual_slot", "shard", before.alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    first = counted.withColumn("place", F.sum("many").over(within) - F.col("many")).join(F.broadcast(starts), "virtual_slot")
    blocks = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / REPEATS))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(REPEATS), F.col("many") - F.col("block") * REPEATS) - 1)))
    slot = F.col("start") + F.col("place") + F.col("block") * REPEATS + F.col("k")
    return each.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot.cast("long").alias("slot"))
