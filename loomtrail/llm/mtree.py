"""Exact top-k inner products by best-first search of M-trees.

Vectors are turned into integers, floor(scale * x). With M the largest squared norm in a tree, the point
(x, sqrt(M - |x|^2)) lies at squared distance |q|^2 + M - 2 q.x from (q, 0): the largest inner products are the
nearest points of a metric space. A tree is a table of pages. A page's entries keep their distance to the page's
routing point; an inner entry also keeps the covering radius of its page. A search takes pages by their smallest
possible distance; an entry whose stored bounds already lie beyond the k-th result,
|d(q, parent) - d(entry, parent)| - radius > d_k, is passed over without computing its distance.

Vectors are dealt to buckets by a hash, a tree each. Queries are packed into blocks, each block visits each bucket,
and the k best of each bucket meet in a window by query. A task holds one tree and one block.

Defined cases: null vectors and those with null or non-finite components take no part; only vectors of one dimension
are compared; null ids take no part; ties go to the smaller id; repeated rows are all candidates, and a query id that
is repeated asks once, with its smallest vector; a candidate with the query's own id is passed over; an empty table
gives an empty result; other columns are ignored. Scores must fit in a long.
"""

from __future__ import annotations

import heapq
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

SCALE, K = 1024, 10
PAGE, FANOUT = 256, 32
EXACT = float(1 << 52)  # sums of products up to here are exact in doubles
BUCKET_VECTORS, BLOCK_QUERIES = 1 << 14, 256
SLACK = 1e-6


class Tree:
    """pages: (is_leaf, vectors, ids or child pages, distances to the page's routing point, radii)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.top = norms.max(initial=0.0)
        self.points = np.concatenate([vectors.astype(np.float64), np.sqrt(np.maximum(self.top - norms, 0))[:, None]], 1)
        self.ids, self.pages = ids, []
        self.vectors = vectors.astype(np.float64) if self.top < EXACT else vectors
        self.build(np.arange(len(ids)), None)
        del self.points

    def far(self, rows: np.ndarray, point: np.ndarray | None) -> np.ndarray:
        return np.zeros(len(rows)) if point is None else np.sqrt(((self.points[rows] - point) ** 2).sum(1))

    def build(self, rows: np.ndarray, point: np.ndarray | None) -> int:
        """Adds the page of these rows, with distances to `point`, and returns its number."""
        number = len(self.pages)
        self.pages.append(None)
        if len(rows) <= PAGE:
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            self.pages[number] = (True, self.vectors[rows], self.ids[rows], self.far(rows, point), None)
            return number
        wide = max(2, min(FANOUT, -(-len(rows) // PAGE)))
        chosen = rows[np.linspace(0, len(rows) - 1, wide).astype(int)]
        chosen = chosen[np.sort(np.unique(self.points[chosen], axis=0, return_index=True)[1])]
        if len(chosen) == 1:  # all alike, as far as can be seen: cut by place
            groups = [(chosen[0], g) for g in np.array_split(rows, wide)]
        else:
            best, own = np.full(len(rows), np.inf), np.zeros(len(rows), int)
            for k, c in enumerate(chosen):
                d = self.far(rows, self.points[c])
                own, best = np.where(d < best, k, own), np.minimum(d, best)
            groups = [(c, rows[own == k]) for k, c in enumerate(chosen) if (own == k).any()]
            if max(len(g) for _, g in groups) > 0.9 * len(rows):  # a mass of equal points: no deep recursion
                groups = [(c, part) for c, g in groups for part in np.array_split(g, max(1, len(g) * wide // len(rows)))]
        routing = np.array([c for c, _ in groups])
        radii = np.array([self.far(g, self.points[c]).max() for c, g in groups])
        children = np.array([self.build(g, self.points[c]) for c, g in groups])
        self.pages[number] = (False, self.vectors[routing], children, self.far(routing, point), radii)
        return number

    def search(self, query: np.ndarray, own_id: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """(score, id) of the k best, best first, ties by id; and how many distances were computed."""
        norm = float(query.astype(np.float64) @ query.astype(np.float64))
        exact = self.pages[0][1].dtype == np.float64 and norm * self.top < EXACT * EXACT
        base, q = norm + self.top, query.astype(np.float64) if exact else query
        heap, best, computed = [(0.0, 0, 0.0)], [], 0  # smallest distance, page, distance of the page's routing point
        limit = np.inf
        while heap and heap[0][0] <= limit:
            _, number, parent = heapq.heappop(heap)
            leaf, vectors, names, to_parent, radii = self.pages[number]
            if number and limit < np.inf:
                bound = np.abs(parent - to_parent) - (0 if leaf else radii)
                keep = np.flatnonzero(bound <= limit)
                if not len(keep):
                    continue
                vectors, names = vectors[keep], names[keep]
                radii = None if leaf else radii[keep]
            scores = vectors @ q if exact else vectors.astype(np.int64) @ q
            computed += len(scores)
            if leaf:
                other = names != own_id
                scores, names = scores[other], names[other]
                if len(best) == k:
                    near = scores >= best[-1][0]
                    scores, names = scores[near], names[near]
                if len(scores) > k:
                    first = np.lexsort((names, -scores))[:k]
                    scores, names = scores[first], names[first]
                best = sorted([*best, *((int(s), i) for s, i in zip(scores.tolist(), names.tolist(), strict=True))], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    limit = np.sqrt(max(0.0, base - 2.0 * best[-1][0])) * (1 + SLACK) + SLACK
            else:
                d = np.sqrt(np.maximum(base - 2.0 * scores, 0))
                for low, child, far in zip((np.maximum(d - radii, 0) * (1 - SLACK)).tolist(), names.tolist(), d.tolist(), strict=True):
                    if low <= limit:
                        heapq.heappush(heap, (low, child, far))
        return best, computed


def _bytes(pages: list) -> Iterator[bytes]:
    return (pickle.dumps(p, protocol=5) for p in pages)


TABLE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("number", pa.int64()), ("blob", pa.binary())])
DDL = "bucket int, kind int, dim int, number long, blob binary"
PAGES, QUERIES = 0, 1


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, TABLE, strict=True)], schema=TABLE)


def _matrix(lists: list, dim: int) -> np.ndarray:
    return np.array(lists, np.int64).reshape(len(lists), dim)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: pages of each bucket's tree, one tree a dimension."""

    def close(bucket, held):
        for dim, (ids, rows) in sorted(held.items()):
            tree = Tree(np.concatenate(ids), np.concatenate(rows))
            for number, blob in enumerate(_bytes(tree.pages)):
                yield _row(bucket, PAGES, dim, number, struct.pack("<d", tree.top) + blob)

    now, held = None, {}
    for batch in batches:
        buckets, ids, vectors = (c.to_pylist() for c in batch.columns)
        start = 0
        while start < len(ids):
            end = start
            while end < len(ids) and buckets[end] == buckets[start] and len(vectors[end]) == len(vectors[start]):
                end += 1
            if buckets[start] != now:
                yield from close(now, held)
                now, held = buckets[start], {}
            own = held.setdefault(len(vectors[start]), ([], []))
            own[0].append(np.array(ids[start:end], np.int64))
            own[1].append(_matrix(vectors[start:end], len(vectors[start])))
            start = end
    yield from close(now, held)


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[int, list] = {}
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault(len(v), [])
            own.append((vec_id, v))
            if len(own) >= BLOCK_QUERIES:
                yield _row(0, QUERIES, len(v), number, pickle.dumps(([i for i, _ in own], _matrix([x for _, x in own], len(v)))))
                number += 1
                own.clear()
    for dim, own in sorted(held.items()):
        if own:
            yield _row(0, QUERIES, dim, number, pickle.dumps(([i for i, _ in own], _matrix([x for _, x in own], dim))))
            number += 1


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("computed", pa.int64())])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, {}
        for batch in batches:
            for bucket, kind, dim, _, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, trees = bucket, {}
                if kind == PAGES:
                    if dim not in trees:
                        trees[dim] = Tree.__new__(Tree)
                        trees[dim].top, trees[dim].pages = struct.unpack_from("<d", blob)[0], []
                    trees[dim].pages.append(pickle.loads(blob[8:]))
                elif dim in trees:
                    ids, vectors = pickle.loads(blob)
                    rows = []
                    for i, q in zip(ids, vectors, strict=True):
                        best, computed = trees[dim].search(q, i, k)
                        rows += [(i, v, s, computed) for s, v in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FOUND)

    return run


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of the vectors that take part."""
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    doubles = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    return doubles.where(F.forall("e", finite)).select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The page table of all vectors (vec_id, v), in the shared folder, and the number of buckets."""
    prepare(vectors.sparkSession)
    n = vectors.count()
    buckets = int(max(8, -(-n // BUCKET_VECTORS)))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int").alias("bucket"), "vec_id", "v")
    pages = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.size("v"), "vec_id").mapInArrow(_build, DDL)
    return stored(pages, "mtree"), buckets


def top_k(queries: DataFrame, pages: DataFrame, buckets: int, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v)."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = asked.mapInArrow(_pack_queries, DDL).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = pages.unionByName(blocks).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "dim", "number")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long, computed long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(n: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(n)) == 0
