"""Benchmark decontamination: CGK embedding, bit sampling and exact edit distance.

The CGK walk reads a string with a pointer that, at step j, writes the character under it and then moves on or stays,
as a random function of (j, character) says. Strings at a small edit distance fall into step again after each edit, so
their walks agree in most places: edit distance becomes Hamming distance. A repetition of the LSH draws its own walk
and its own sample of places; the sampled characters are a key.

An item is looked for in windows of its own size. Walks start at each word, or, for items of few words, at each
character, of texts and items alike; an item is met where a walk of its own and one of a text have the same key, and is
lost only if edits fall into the sampled places of all its walks. CLASSES sets steps and repetitions so that at least
TARGET_RECALL of the items with MAX_EDITS of their characters edited at random are met; the tests measure it by length.
A met window is verified in two steps, both by Myers' bit vectors: a part of PART characters of the item around the met
place may have at most PART_EDITS of its characters edited (and no more than the item; items of up to PART characters
are looked at as a whole), then the edit distance of the item to the best stretch of the window must be at most MAX_EDITS
of its length. Edits that crowd in one part leave the other parts, which are met by their own walks.

Texts and items are lower-cased and their white space is collapsed. Documents are read once per block of items and
nothing is shuffled; blocks have at most ITEM_BYTES, so what is sent to the executors is bounded.

The whole item isn't walked: with a fifth of its characters edited, walks over all of an item of 200 characters agree in
0.37 of their places (0.43 at 60; unrelated texts of the same letters in 0.16, 0.15), so that a selective sample of places would need very many
repetitions. Windows of a walk are therefore stretches of the item, and every stretch of it has its own walk.

An item of fewer than SHORT characters has no room for a walk. It is held against all runs of whole words of about its
own length, by the same share of edits and without loss: an edit distance of k leaves a common string after at most k
deletions on both sides, so runs and items meet in a table of such strings before Myers' distance is taken.

Defined cases: null and empty texts and items match nothing; items of fewer than SHORT characters must begin and end with
words (else `cat` would be met in `concatenate`); repeated rows each give rows; ties go to the first place; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

MAX_EDITS = 0.2
TARGET_RECALL = 0.95  # of items with MAX_EDITS, in each class
CLASSES = ((24, 1, False, 24, 24, 3), (10, 1, False, 16, 16, 3), (1, 40, True, 12, 12, 3), (0, 0, True, 10, 10, 3))  # words and characters of an item at least; walks from each character; steps, places sampled, repetitions
STEPS = max(c[3] for c in CLASSES)
SHORT, SHORT_RUNS = 14, 200_000
PART, PART_STEP, PART_EDITS, PLACE_STEP = 64, 16, 0.35, 8  # parts begin at multiples of PART_STEP, or end with their item
PART_TABLES, LANES, MET = 4096, 8192, 1 << 20
ITEM_BYTES, SLICE_CHARS, RUN = 16 << 20, 1 << 20, 1 << 15
TABLE_BITS = 22
SEED = 97


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    """A byte for each character; those beyond Latin-1 are hashed to 128 and more."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 256, c, c * np.uint32(0x9E3779B1) >> np.uint32(25) | np.uint32(128)).astype(np.uint8)


def walks(level: int, repetition: int) -> tuple[np.ndarray, list[int]]:
    """Moves (steps x 256, of 0 and 1) and sampled places."""
    steps, places = CLASSES[level][3:5]
    r = np.random.Generator(np.random.PCG64([SEED, level, repetition]))
    return r.integers(0, 2, (steps, 256), np.int32), sorted(r.choice(steps, places, replace=False).tolist())


def keys(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of the walk from each start, and where it ends. data: codes with as many zeros at the end as there are steps."""
    out, ends = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int32)
    sampled, factor = set(places), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(0, len(starts), RUN):
            at = starts[k : k + RUN].astype(np.int32)
            key = np.zeros(len(at), np.uint64)
            for j in range(len(moves)):
                c = data[at]
                if j in sampled:
                    key *= factor
                    key += c
                    key ^= key >> np.uint64(29)
                at += moves[j][c]
            key *= factor
            out[k : k + RUN], ends[k : k + RUN] = key, at
    return out, ends


def word_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data[1:] > 32) & (data[:-1] <= 32)).astype(np.int32) + 1


def shorter(text: str, most: int) -> set[str]:
    """The text and all that at most `most` deletions leave of it."""
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return row[-1]


class ShortItems:
    """Items of fewer than SHORT characters, met in runs of whole words."""

    def __init__(self, items: dict[str, list[int]], max_edits: float):
        self.items, self.max_edits, self.met = items, max_edits, {}
        self.reach = int(max_edits * (SHORT - 1))
        self.sizes = {n + k for n in map(len, items) for k in range(-int(max_edits * n), int(max_edits * n) + 1)}
        self.most = max(self.sizes, default=0)
        self.strings: dict[str, list[str]] = {}
        for item in items:
            for t in shorter(item, int(max_edits * len(item))):
                self.strings.setdefault(t, []).append(item)

    def alike(self, run: str) -> list[tuple[str, int]]:
        if (found := self.met.get(run)) is None:
            if len(self.met) >= SHORT_RUNS:
                self.met.clear()
            near = {item for t in shorter(run, self.reach) for item in self.strings.get(t, ())}
            found = self.met[run] = [(item, n) for item in sorted(near) if (n := edit_distance(item, run)) <= int(self.max_edits * len(item))]
        return found

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end in the text), the smallest distance and its first place for each item met."""
        words = [m.span() for m in re.finditer(r"\S+", text)] if self.items else []
        best: dict[str, tuple[int, int]] = {}
        for k, (start, _) in enumerate(words):
            for _, end in words[k:]:
                if end - start > self.most:
                    break
                if end - start in self.sizes:
                    for item, n in self.alike(text[start:end]):
                        best[item] = min(best.get(item, (n, end)), (n, end))
        for item, (n, end) in sorted(best.items()):
            for i in self.items[item]:
                yield i, n, end


def edit_distance_within(item: str, window: str) -> tuple[int, int]:
    """The smallest edit distance of item to any stretch of window, and where the first such stretch ends (Myers 1999)."""
    m, where = len(item), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _part_distance(masks: np.ndarray, own: np.ndarray, m: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The smallest distance of each part to a stretch of its window, all windows at once. own: where a part's 256 masks of m bits begin."""
    one, top = np.uint64(1), (m - 1).astype(np.uint64)
    pv, mv = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64)
    score = m.astype(np.int64)
    best = score.copy()
    for j in range(length):
        eq = masks[own + data[np.clip(at + j, 0, len(data) - 1)]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += (ph >> top & one).astype(np.int64)
        score -= (mh >> top & one).astype(np.int64)
        np.minimum(best, score, out=best)
        ph <<= one
        mh <<= one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    return best


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return [c[new] for c in columns]


class Items:
    """Keys of a block of items: (item_id, normal text)."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, repetitions: int | None = None):
        """repetitions: those of CLASSES if None."""
        self.items, self.max_edits, self.tables = items, max_edits, []
        self.sizes = np.array([len(text) for _, text in items], np.int64)
        self.most = np.array([int(max_edits * len(text)) for _, text in items], np.int64)
        by_class: list[list[int]] = [[] for _ in CLASSES]
        short: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(items):
            if len(text) < SHORT:
                short.setdefault(text, []).append(i)
            else:
                words = text.count(" ") + 1
                by_class[next(k for k, c in enumerate(CLASSES) if words >= c[0] and len(text) >= c[1])].append(i)
        for level, own in enumerate(by_class):
            every, usual = CLASSES[level][2], CLASSES[level][5]
            for repetition in range((repetitions or usual) if own else 0):
                moves, places = walks(level, repetition)
                all_keys, who, offset = [], [], []
                for i in own:
                    data = np.concatenate([[32], codes(items[i][1]), np.zeros(STEPS)]).astype(np.uint8)
                    starts = np.arange(1, self.sizes[i] + 1, dtype=np.int32) if every else word_starts(data)
                    own_keys, ends = keys(data, starts, moves, places)
                    inside = ends <= self.sizes[i] + 1
                    all_keys.append(own_keys[inside])
                    who += [i] * int(inside.sum())
                    offset += (starts[inside] - 1).tolist()
                k = np.concatenate(all_keys)
                order = np.argsort(k, kind="stable")
                table = np.zeros(1 << TABLE_BITS, bool)
                table[(k >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
                self.tables.append((every, moves, places, k[order], np.array(who, np.int64)[order], np.array(offset, np.int64)[order], table))
        self.short = ShortItems(short, max_edits)

    def met(self, data: np.ndarray, words: np.ndarray, begins: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Distinct (text, item, part's begin in the item and in the texts) around shared keys, in bounded lots."""
        for every, moves, places, known, who, offset, table in self.tables:
            starts = np.arange(1, len(data) - STEPS, dtype=np.int32) if every else words
            for first in range(0, len(starts), MET):
                run = starts[first : first + MET]
                own, _ = keys(data, run, moves, places)
                some = np.flatnonzero(table[(own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                low, high = np.searchsorted(known, own[some]), np.searchsorted(known, own[some], "right")
                some, low, high = some[high > low], low[high > low], high[high > low]
                up_to = np.cumsum(high - low)
                a = 0
                while a < len(some):
                    b = max(a + 1, int(np.searchsorted(up_to, (up_to[a - 1] if a else 0) + MET, "right")))
                    n = (high - low)[a:b]
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
                    s = np.repeat(run[some[a:b]].astype(np.int64), n)
                    item = who[k]
                    part = np.minimum(np.maximum(offset[k] // PART_STEP - 1, 0) * PART_STEP, np.maximum(self.sizes[item] - PART, 0))
                    at = s - offset[k] + part
                    # The matched place's own text is the window's, even if the window begins before it.
                    yield _distinct(item, part, np.searchsorted(begins, s, "right") - 1, at - at % PLACE_STEP)
                    a = b

    def alike(self, data: np.ndarray, item: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the part of the item is near what lies at `at`; rows sorted by item and part."""
        reach = int(PART * max(PART_EDITS, 2 * self.max_edits))
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        number, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        keep = np.zeros(len(item), bool)
        for a in range(0, len(firsts), PART_TABLES):
            own = firsts[a : a + PART_TABLES]
            masks = np.zeros((len(own), 256), np.uint64)
            for k, f in enumerate(own.tolist()):
                c = codes(self.items[item[f]][1][part[f] : part[f] + PART])
                np.bitwise_or.at(masks[k], c, np.uint64(1) << np.arange(len(c), dtype=np.uint64))
            masks = masks.ravel()
            first, last = own[0], firsts[a + PART_TABLES] if a + PART_TABLES < len(firsts) else len(item)
            for k in range(first, last, LANES):
                rows = slice(k, min(last, k + LANES))
                m = np.minimum(self.sizes[item[rows]], PART)
                within = np.minimum(self.most[item[rows]], np.where(self.sizes[item[rows]] > PART, reach, PART))
                keep[rows] = _part_distance(masks, (number[rows] - a) * 256, m, data, at[rows] - reach, PART + 2 * reach + PLACE_STEP) <= within
        return keep

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(place of the text, item, distance, end in the normal text) for each text and item within the distance."""
        raw = [normal(t) for t in texts]
        data = np.concatenate([codes(" " + " ".join(raw)), np.zeros(STEPS, np.uint8)])
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        by_pair: dict[tuple[int, int], list[int]] = {}
        for item, part, text, at in self.met(data, word_starts(data), begins):
            some = self.alike(data, item, part, at)
            for d, i, k in zip(text[some].tolist(), item[some].tolist(), (at - part - begins[text])[some].tolist(), strict=True):
                by_pair.setdefault((d, i), []).append(k)
        for (d, item), places in sorted(by_pair.items()):
            text = self.items[item][1]
            size, most = len(text), int(self.max_edits * len(text))
            slack, best, end, done = 3 * most + PLACE_STEP, most + 1, 0, None
            for at in sorted(set(places)):
                if done is not None and at - done <= most and best > most:
                    continue  # the window looked at reaches over this one
                done = at
                low, high = max(0, at - slack), max(0, at + size + slack)
                window = raw[d][low:high]
                found = window.find(text)
                distance, stop = (0, found + len(text)) if found >= 0 else edit_distance_within(text, window)
                if distance < best:
                    best, end = distance, low + stop
                if not best:
                    break
            if best <= most:
                yield d, item, best, end
        if self.short.items:
            for d, text in enumerate(raw):
                for item, distance, stop in self.short.find(text):
                    yield d, item, distance, stop


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edit_distance", pa.int32()), ("item_chars", pa.int32()), ("end_char", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, edit_distance int, item_chars int, end_char long"


def _slices(batches: Iterator[pa.RecordBatch], column: int = 1):
    """(batch, places, texts) of bounded size within each batch."""
    for batch in batches:
        texts, low, chars = batch.column(column).to_pylist(), 0, 0
        for k, t in enumerate(texts):
            chars += len(t or "")
            if chars >= SLICE_CHARS or k == len(texts) - 1:
                yield batch, range(low, k + 1), texts[low : k + 1]
                low, chars = k + 1, 0


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch, places, texts in _slices(batches):
            ids = batch.column(0).slice(places.start, len(places)).to_pylist()
            rows = [(ids[d], items.items[i][0], n, len(items.items[i][1]), end) for d, i, n, end in items.find(texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        text = normal(row["text"])
        if text:
            block.append((row["item_id"], text))
            size += len(text)
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, repetitions: int | None = None) -> DataFrame:
    """doc_id, item_id, edit_distance, item_chars, end_char: a row for each document and item it contains."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        found = rows.mapInArrow(_find(spark.sparkContext.broadcast((block, max_edits, repetitions))), FOUND_DDL)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND_DDL) if out is None else out


def _clean(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, at = Items(*sent.value), None
        for batch, places, texts in _slices(batches, -1):
            at = set(range(len(places))) - {d for d, *_ in items.find(texts)}
            yield batch.slice(places.start, len(places)).take(pa.array(sorted(at), pa.int64())).select(range(batch.num_columns - 1))

    return run


def remove_leaked(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for block in item_blocks(benchmark):
        last = docs.select(*docs.columns, F.col("text").cast("string").alias("__text"))
        docs = last.mapInArrow(_clean(spark.sparkContext.broadcast((block, max_edits))), ddl)
    return docs
