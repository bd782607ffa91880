"""Distances between sequences, sets and vectors, pairs of records, neighbours and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.store import stored
from .statistics import with_total


def jaccard_distance(a: Column, b: Column) -> Column:
    """Two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def dice_distance(a: Column, b: Column) -> Column:
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, 0.0).otherwise((F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) / both)


def token_distance(a: Column, b: Column, code: Column) -> Column:
    """Normalised edit distance of token arrays; `code` maps a token to one character, so that the built-in applies."""
    text = lambda x: F.array_join(F.transform(x, lambda t: F.element_at(code, t)), "")
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(text(a), text(b)) / longest)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or empty."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cross_pairs(asked: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row of a stated set with each row of a table: key_a, key_b, and each column twice.

    Rows are dealt to blocks, and each asked one goes to each block once, so a task holds one block."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda of, s, block: of.select(block.alias("_block"), *[F.col(c).alias(f"{c}_{s}") for c in (key, *columns)])
    left = side(asked, "a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(side(rows, "b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "_block").drop("_block")


def stated_pairs(rows: DataFrame, key: str, columns: list[str], every: int) -> DataFrame:
    """Pairs of a query, a row whose key is divisible by `every`, and any other row: key_a, key_b, and each column twice."""
    return cross_pairs(rows.where(F.pmod(F.col(key), F.lit(every)) == 0), rows, key, columns).where(F.col(f"{key}_a") != F.col(f"{key}_b"))


def dtw_similarity(a: list, b: list) -> float:
    """1 - warping cost (0 for equal, 1 for different items) over the longer length, not below 0."""
    if not a or not b:
        return 0.0
    row = [0.0] + [float("inf")] * len(b)
    for x in a:
        new = [float("inf")]
        for j, y in enumerate(b, 1):
            new.append((x != y) + min(row[j], row[j - 1], new[j - 1]))
        row = new
    return max(0.0, 1 - row[-1] / max(len(a), len(b)))


@F.pandas_udf(DoubleType())
def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([dtw_similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Edit distance of ordered trees with unit costs (Zhang and Shasha 1989). A tree: labels and parents in post-order, the root last with parent -1."""

    def prepare(tree):
        labels, parents = tree
        n = len(labels)
        first = list(range(n))  # the first leaf under each node
        for k in range(n):
            p = parents[k]
            if p >= 0:
                first[p] = min(first[p], first[k])
        last = {}
        for k in range(n):
            last[first[k]] = k
        return labels, first, sorted(last.values())

    if not a[0] or not b[0]:
        return len(a[0]) + len(b[0])
    (la, fa, ka), (lb, fb, kb) = prepare(a), prepare(b)
    tree = np.zeros((len(la), len(lb)), int)
    for i in ka:
        for j in kb:
            x, y = fa[i], fb[j]
            forest = np.zeros((i - x + 2, j - y + 2), int)
            forest[:, 0], forest[0, :] = np.arange(i - x + 2), np.arange(j - y + 2)
            for u in range(x, i + 1):
                for v in range(y, j + 1):
                    p, q = u - x + 1, v - y + 1
                    least = min(forest[p - 1, q], forest[p, q - 1]) + 1
                    if fa[u] == x and fb[v] == y:
                        forest[p, q] = tree[u, v] = min(least, forest[p - 1, q - 1] + (la[u] != lb[v]))
                    else:
                        forest[p, q] = min(least, forest[fa[u] - x, fb[v] - y] + tree[u, v])
    return int(tree[-1, -1])


def farthest_first(vectors: DataFrame, steps: int) -> DataFrame:
    """step (from 1), chosen, distance: greedy order of (id, v), v of unit length; ties go to the smaller id. One pass over the rows for each step."""
    spark, taken, out = vectors.sparkSession, [], []
    rows = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    for step in range(1, steps + 1):
        if taken:
            near = F.least(F.lit(2.0), *[1 - dot(F.col("v"), F.array(*map(F.lit, t))) for t in taken])
            best = rows.where(~F.col("id").isin([i for _, i, _ in out])).select("id", "v", F.round(near, 9).alias("d"))
        else:
            best = rows.select("id", "v", F.lit(None).cast("double").alias("d"))
        top = best.orderBy(F.desc("d"), "id").limit(1).collect()
        if not top:
            break
        taken.append(top[0]["v"])
        out.append((step, top[0]["id"], top[0]["d"]))
    return spark.createDataFrame(out, "step int, chosen long, distance double")


def greedy_cover(covers: DataFrame, steps: int) -> DataFrame:
    """step, chosen, newly: greedy order from distinct rows (i, j) of who covers whom; ties go to the smaller i. Counts and covered rows stay distributed."""
    spark, out, left = covers.sparkSession, [], stored(covers, "covers")
    for step in range(1, steps + 1):
        top = left.groupBy("i").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "i").limit(1).collect()
        if not top:
            break
        out.append((step, top[0]["i"], top[0]["n"]))
        left = stored(left.join(left.where(F.col("i") == top[0]["i"]).select("j"), "j", "left_anti"), "covers")
    return spark.createDataFrame(out, "step int, chosen long, newly long")


def silhouette_of_means(mean: DataFrame) -> DataFrame:
    """id, silhouette: from mean distances m of each id, of some label, to each other label."""
    same = F.col("other") == F.col("label")
    own = mean.groupBy("id").agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    return own.select("id", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def cluster_metrics(rows: DataFrame, predicted: str, reference: str) -> DataFrame:
    """n, homogeneity, completeness, v_measure, ari, nmi (arithmetic), from the contingency table; rows with a null label are left out."""
    c = rows.where(F.col(predicted).isNotNull() & F.col(reference).isNotNull()).groupBy(predicted, reference).agg(F.count("*").alias("n"))
    c = with_total(c, "n", "t").withColumns({"p": F.sum("n").over(Window.partitionBy(predicted)), "r": F.sum("n").over(Window.partitionBy(reference))})
    two = lambda x: x * (x - 1) / 2
    n, t, p, r = (F.col(x).cast("double") for x in "ntpr")
    s = c.agg(
        F.max("t").cast("long").alias("n"),
        F.sum(n / t * F.log(n * t / (p * r))).alias("mi"),
        F.sum(-n / t * F.log(p / t)).alias("hp"),
        F.sum(-n / t * F.log(r / t)).alias("hr"),
        F.sum(two(n)).alias("same"),
        F.sum(n * (p - 1) / 2).alias("sp"),
        F.sum(n * (r - 1) / 2).alias("sr"),
        F.max(two(t)).alias("all"),
    )
    share = lambda h: F.when(F.col(h) > 1e-12, F.col("mi") / F.col(h)).otherwise(1.0)
    expected = F.col("sp") * F.col("sr") / F.col("all")
    top = (F.col("sp") + F.col("sr")) / 2
    return s.select(
        "n",
        share("hr").alias("homogeneity"),
        share("hp").alias("completeness"),
        F.when(F.col("hp") + F.col("hr") > 1e-12, 2 * F.col("mi") / (F.col("hp") + F.col("hr"))).otherwise(1.0).alias("v_measure"),
        F.when(top - expected != 0, (F.col("same") - expected) / (top - expected)).otherwise(1.0).alias("ari"),
    ).withColumn("nmi", F.col("v_measure"))
