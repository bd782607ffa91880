"""A stated set of queries against all vectors, in blocks of Arrow batches: exact neighbours, and histograms of distances.

Vectors and queries (id, label, v) are packed into blobs. Each block of vectors meets each block of queries once, as a
matrix product, and only the k nearest of a block, or counts by distance, leave the task: pairs are never rows. A task holds
two blocks. Null vectors and those of another dimension than a query's aren't compared; zero vectors are at distance 1.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 1 << 13, 1 << 10
PACKED = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
PACKED_DDL = "block int, kind int, blob binary"


def _dump(ids: list, labels: list, vectors: list) -> bytes:
    m = np.array(vectors, np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    out = io.BytesIO()
    np.savez(out, i=np.array(ids, np.int64), l=np.array(labels, np.int64), v=np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
    return out.getvalue()


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = np.load(io.BytesIO(blob))
    return held["i"], held["l"], held["v"]


def _pack(kind: int, most: int, blocks: int):
    """Blobs of up to `most` vectors of one dimension; those of queries go to every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId(), {}

        def close(own) -> pa.RecordBatch:
            nonlocal number
            targets = range(blocks) if kind else [number * 7919 % blocks]
            number += 1
            blob = _dump(*own)
            return pa.RecordBatch.from_arrays([pa.array(list(targets), pa.int32()), pa.array([kind] * len(targets), pa.int32()), pa.array([blob] * len(targets), pa.binary())], schema=PACKED)

        for batch in batches:
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not v or None in v:
                    continue
                own = held.setdefault(len(v), ([], [], []))
                own[0].append(i), own[1].append(-1 if label is None else label), own[2].append(v)
                if len(own[0]) >= most:
                    yield close(own)
                    del held[len(v)]
        for own in held.values():
            yield close(own)

    return run


def _met(queries: DataFrame, rows: DataFrame, step, ddl: str) -> DataFrame:
    """step(query blob, row blob) -> record batch, for each two blocks."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cast = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL")
    packed = cast(rows).mapInArrow(_pack(0, ROWS, blocks), PACKED_DDL).unionByName(cast(queries).mapInArrow(_pack(1, QUERIES, blocks), PACKED_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, held = block, []
                if not kind:
                    held.append(_load(blob))
                else:
                    q = _load(blob)
                    for r in held:
                        if q[2].shape[1] == r[2].shape[1]:
                            yield step(q, r)

    return packed.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, ddl)


NEAR = pa.schema([("i", pa.int64()), ("li", pa.int64()), ("j", pa.int64()), ("lj", pa.int64()), ("d", pa.float64())])


def nearest(queries: DataFrame, rows: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """i, li, j, lj, d, rank: the k nearest other rows of each query by cosine distance, rounded, ties to the smaller id."""

    def step(q, r):
        out = []
        d = np.round(1 - q[2] @ r[2].T, digits)
        d[q[0][:, None] == r[0][None, :]] = np.inf
        for a in range(len(q[0])):
            some = np.flatnonzero(d[a] <= np.partition(d[a], min(k, len(r[0])) - 1)[min(k, len(r[0])) - 1])
            some = some[np.isfinite(d[a][some])]
            some = some[np.lexsort((r[0][some], d[a][some]))[:k]]
            out += [(q[0][a], q[1][a], r[0][b], r[1][b], d[a][b]) for b in some]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, NEAR, strict=True)], schema=NEAR)

    found = _met(queries, rows, step, "i long, li long, j long, lj long, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def within(queries: DataFrame, rows: DataFrame, distance: float, digits: int = 9) -> DataFrame:
    """i, j: each query and the rows at less than the distance, itself included."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64())])

    def step(q, r):
        a, b = np.nonzero(np.round(1 - q[2] @ r[2].T, digits) < distance)
        return pa.RecordBatch.from_arrays([pa.array(q[0][a]), pa.array(r[0][b])], schema=schema)

    return _met(queries, rows, step, "i long, j long")


def profile_distances(queries: DataFrame, rows: DataFrame, mean: list[float]) -> DataFrame:
    """i, distance: the mean over all rows, the query's own included, of how far the query's distance to a row lies from that of `mean`, a mean of unit vectors."""
    schema = pa.schema([("i", pa.int64()), ("s", pa.float64()), ("n", pa.int64())])
    centre = np.array(mean, np.float64)

    def step(q, r):
        if r[2].shape[1] != len(centre):
            return pa.RecordBatch.from_arrays([pa.array([], t.type) for t in schema], schema=schema)
        s = np.abs(r[2] @ centre - q[2] @ r[2].T).sum(1)
        return pa.RecordBatch.from_arrays([pa.array(q[0]), pa.array(s), pa.array(np.full(len(s), len(r[0])))], schema=schema)

    return _met(queries, rows, step, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("distance"))


COUNTS = pa.schema([("d", pa.float64()), ("gap", pa.int64()), ("n", pa.int64())])


def distance_counts(queries: DataFrame, rows: DataFrame, digits: int = 4) -> DataFrame:
    """d, gap, n: how many pairs (query, other row) lie at each rounded distance with each difference of labels."""

    def step(q, r):
        d = np.rint((1 - q[2] @ r[2].T) * 10**digits).astype(np.int64)
        gap = np.abs(q[1][:, None] - r[1][None, :])
        other = q[0][:, None] != r[0][None, :]
        width = int(gap.max()) + 1 if gap.size else 1
        values, n = np.unique(d[other] * width + gap[other], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((values // width) / 10**digits, pa.float64()), pa.array(values % width, pa.int64()), pa.array(n, pa.int64())], schema=COUNTS)

    return _met(queries, rows, step, "d double, gap long, n long").groupBy("d", "gap").agg(F.sum("n").alias("n"))


def weighted_auc(counts: DataFrame, value: str, inside) -> DataFrame:
    """auc: the share of pairs (inside, outside) in which the inside one is larger, ties half; from counts (value, n), a row a value."""
    by = counts.groupBy(value).agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("b"))
    below = F.sum("b").over(Window.orderBy(value)) - F.col("b") / 2  # as many rows as distinct rounded distances
    return by.withColumn("below", below).agg((F.sum(F.col("a").cast("double") * F.col("below")) / (F.sum("a").cast("double") * F.sum("b"))).alias("auc"))


def weighted_rank_correlation(counts: DataFrame, x: str, y: str) -> DataFrame:
    """rho: Spearman's correlation of x and y from counts (x, y, n), ties get mean ranks."""

    def ranks(c: str) -> DataFrame:
        by = counts.groupBy(c).agg(F.sum("n").alias("m"))  # a row a value
        return by.select(c, (F.sum("m").over(Window.orderBy(c)) - (F.col("m") - 1) / 2).alias(f"r_{c}"))

    r = counts.join(ranks(x), x).join(ranks(y), y)
    n, a, b = F.col("n").cast("double"), F.col(f"r_{x}"), F.col(f"r_{y}")
    s = r.agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b")).select((F.col("a") / F.col("n")).alias("ma"), (F.col("b") / F.col("n")).alias("mb"))
    u, v = a - F.col("ma"), b - F.col("mb")
    return r.join(F.broadcast(s)).agg((F.sum(n * u * v) / F.sqrt(F.sum(n * u * u) * F.sum(n * v * v))).alias("rho"))  # s is one row


def label_sums(vectors: DataFrame) -> DataFrame:
    """label, n, s: how many vectors of unit length a label has, and their sum; without pairs, this gives all mean cosine distances of a label.

    vectors: (id, label, v) with v of unit length and one dimension."""
    parts = vectors.select("label", F.posexplode("v").alias("place", "x")).groupBy("label", "place").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("s"))
