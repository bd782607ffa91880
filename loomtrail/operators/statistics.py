"""Counts, distributions, divergences, tests and intervals as DataFrame aggregations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.store import stored


def distribution(counts: DataFrame, group: str, item: str, n: str = "n") -> DataFrame:
    """group, item, p: shares within each group."""
    return counts.select(group, item, (F.col(n) / F.sum(n).over(Window.partitionBy(group))).alias("p"))


def with_total(counts: DataFrame, n: str, name: str) -> DataFrame:
    """counts and the sum of n over all of them, from an aggregate of one row; counts are written first, so they are made once."""
    kept = stored(counts, "counts")
    return kept.join(F.broadcast(kept.agg(F.sum(n).alias(name))))


def jsd_matrix(dist: DataFrame, group: str, item: str, base: float = 2.0, within: str | None = None) -> DataFrame:
    """group_a < group_b, jsd: Jensen-Shannon divergence (the squared distance) of each pair of groups, with `within` of those alike in it only.

    An item of one group alone adds p/2; so only items of both are joined, and the rest follows from the sums:
    the shares of each group add up to one."""
    dist = dist.withColumn("_within", F.col(within) if within else F.lit(0))
    side = lambda s: dist.select("_within", F.col(group).alias(f"group_{s}"), F.col(item).alias("item"), F.col("p").alias(s))
    a, b = side("a"), side("b")
    m = (F.col("a") + F.col("b")) / 2
    log = lambda x: F.log(x) / math.log(base)
    both = a.join(b, ["_within", "item"]).where("group_a < group_b").groupBy("_within", "group_a", "group_b").agg(
        F.sum(0.5 * F.col("a") * log(F.col("a") / m) + 0.5 * F.col("b") * log(F.col("b") / m)).alias("s"), F.sum("a").alias("sa"), F.sum("b").alias("sb")
    )
    groups = dist.select("_within", F.col(group).alias("group_a")).distinct()
    pairs = groups.join(groups.withColumnRenamed("group_a", "group_b"), "_within").where("group_a < group_b")  # as many rows as pairs of groups: that is the result
    half = 0.5 * math.log(2) / math.log(base)
    alone = lambda c: half * (1 - F.coalesce(c, F.lit(0.0)))
    return pairs.join(both, ["_within", "group_a", "group_b"], "left").select(*([F.col("_within").alias(within)] if within else []), "group_a", "group_b", (F.coalesce("s", F.lit(0.0)) + alone(F.col("sa")) + alone(F.col("sb"))).alias("jsd"))


def entropy(dist: DataFrame, group: str) -> DataFrame:
    return dist.groupBy(group).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy_bits")).withColumn("effective_size", F.pow(F.lit(2.0), "entropy_bits"))


def width_at_coverage(counts: DataFrame, group: str, item: str, share: float, n: str = "n") -> DataFrame:
    """The smallest number of most frequent items that cover `share` of all."""
    w = Window.partitionBy(group).orderBy(F.desc(n), item)
    ranked = counts.withColumns({"rank": F.row_number().over(w), "upto": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(n).over(Window.partitionBy(group))})
    return ranked.where(F.col("upto") >= share * F.col("total")).groupBy(group).agg(F.min("rank").alias("width"))


def novelty(counts: DataFrame, group: str, item: str, eps: float = 1.0, least: int = 5, n: str = "n") -> DataFrame:
    """log2 of an item's smoothed rate in a group over its rate in the corpus, for items counted often enough there."""
    c, a_all = F.sum(n).over(Window.partitionBy(item)), F.sum(n).over(Window.partitionBy(group))
    rows = with_total(counts, n, "c_all").withColumns({"c": c, "a_all": a_all}).where(F.col("c") >= least)
    rate = lambda x, y: (x + eps) / (y + eps)
    return rows.select(group, item, F.log2(rate(F.col(n), F.col("a_all")) / rate(F.col("c"), F.col("c_all"))).alias("log_odds"))


def gini(values: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """by, n, gini: of a value over rows; one row gives 1."""
    w = Window.partitionBy(*by)
    ranked = values.withColumns({"i": F.row_number().over(w.orderBy(value, tie)), "n": F.count("*").over(w)})
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.when(F.max("n") == 1, F.lit(1.0)).otherwise(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col(value)) / (F.max("n") * F.sum(value))).alias("gini"))


def mutual_information(counts: DataFrame, x: str, y: str, strata: list[str] | None = None, n: str = "n") -> DataFrame:
    """strata, n, mi_bits and mi_share (of H(y)): from joint counts; never below 0."""
    by = strata or [F.lit(0).alias("all")]
    total = lambda *more: F.sum(n).over(Window.partitionBy(*(strata or []), *more))
    rows = (counts.withColumn("_t", total()) if strata else with_total(counts, n, "_t")).withColumns({"_x": total(x), "_y": total(y)})
    p, q = F.col(n) / F.col("_t"), F.col("_y") / F.col("_t")
    mi = F.sum(p * F.log2(F.col(n) * F.col("_t") / (F.col("_x") * F.col("_y"))))
    h = F.sum(-p * F.log2(q))
    out = rows.groupBy(*by).agg(F.sum(n).alias("n"), F.greatest(mi, F.lit(0.0)).alias("mi_bits"), h.alias("h_y"))
    out = out.withColumn("mi_share", F.coalesce(F.try_divide("mi_bits", "h_y"), F.lit(0.0)))
    return out if strata else out.drop("all")


def conditional_mutual_information(counts: DataFrame, x: str, y: str, z: str, n: str = "n") -> DataFrame:
    """The mean of the strata's information, weighed by their rows; strata of one row are left out of the sum."""
    each = mutual_information(counts, x, y, [z], n)
    return each.agg((F.sum(F.when(F.col("n") >= 2, F.col("n") * F.col("mi_bits")).otherwise(0.0)) / F.sum("n")).alias("cmi_bits"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound, clamped; (0, 0) without rows."""
    p, zz = k / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def benjamini_hochberg(rows: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """rows with q and significant: the smallest p * n / rank of this rank and all later ones, by ranges of p."""
    ranked = ranked_values(rows, p, tie, with_range=True)
    n = F.broadcast(rows.agg(F.count("*").alias("_all_rows")))  # one row
    adjusted = stored(ranked.join(n).withColumn("_raw", F.col(p) * F.col("_all_rows") / (F.col("_before") + F.col("_n"))), "adjusted")
    later = adjusted.groupBy("_range").agg(F.min("_raw").alias("_least"))
    beyond = later.select("_range", F.min("_least").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_beyond"))  # a row a range
    back = Window.partitionBy("_range").orderBy(F.desc("_before")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_raw").over(back), F.col("_beyond"))
    values = adjusted.join(F.broadcast(beyond), "_range").select(p, tie, q.alias("q"))
    return rows.join(values, [p, tie]).withColumn("significant", F.col("q") <= alpha)


def mantel_haenszel(tables: DataFrame, by: list[str]) -> DataFrame:
    """by, odds_ratio, chi2 (Yates), p: combined over strata of counts a, b, c, d; strata of fewer than 2 are left out."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    variance = (a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1))
    sums = tables.where(n >= 2).groupBy(*by).agg(F.sum(a * d / n).alias("num"), F.sum(b * c / n).alias("den"), F.sum((a + b) * (a + c) / n).alias("expected"), F.sum(a).alias("seen"), F.sum(variance).alias("var"))
    ok = (F.col("den") > 0) & (F.col("var") > 0)
    chi = F.pow(F.abs(F.col("seen") - F.col("expected")) - 0.5, F.lit(2.0)) / F.col("var")
    out = sums.select(*by, F.when(ok, F.col("num") / F.col("den")).alias("odds_ratio"), F.when(ok, chi).alias("chi2"))
    return out.withColumn("p", F.coalesce(_chi2_sf("chi2"), F.lit(1.0)))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to about 1e-12 of itself: a series below 2, a continued fraction above."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((a["t"] * x * x * 2 / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x * 2 / (2 * k + 1)).alias("s")), lambda a: a["s"])
    low = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x.cast("double"), lambda a, k: x + k / 2 / a)
    return F.when(x < 2, low).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def _chi2_sf(x: str) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.col(x) / 2))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of 2 x 2 tables: the sum of all tables no likelier than the one seen."""

    def one(a, b, c, d):
        row, column, n = a + b, a + c, a + b + c + d
        log = lambda k: sum(math.lgamma(v + 1) for v in (row, n - row, column, n - column)) - sum(math.lgamma(v + 1) for v in (n, k, row - k, column - k, n - row - column + k))
        seen = log(a)
        return min(1.0, sum(math.exp(log(k)) for k in range(max(0, row + column - n), min(row, column) + 1) if log(k) <= seen + 1e-7))

    return pd.Series([one(*map(int, t)) for t in zip(a, b, c, d, strict=True)])


def ranked_values(rows: DataFrame, *order: str, with_range: bool = False) -> DataFrame:
    """Distinct values of `order` with _n (rows) and _before (rows that sort before them), without one task for all rows.

    Values are dealt by ranges; each range counts on from the sum of those before it, a row a range."""
    counts = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    dealt = stored(counts.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_all"))
    starts = totals.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_start"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_upto", F.sum("_n").over(w)).join(F.broadcast(starts), "_range").select(*order, *(["_range"] if with_range else []), "_n", (F.col("_start") + F.col("_upto") - F.col("_n")).alias("_before"))


def average_ranks(rows: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1, ties get their mean."""
    if by:
        return rows.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)
    ranks = ranked_values(rows, value).select(value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, value)


def auc(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """Area under the ROC curve by ranks; null unless both classes occur."""
    ranked = average_ranks(rows.withColumn("_y", label), score)
    pos, n = F.sum(F.col("_y").cast("double")), F.count("*")
    return ranked.agg(pos.alias("pos"), (n - pos).alias("neg"), F.sum(F.when(F.col("_y"), F.col("rank"))).alias("s")).select(
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc")
    )


def rank_sum(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H over groups (without tie correction): n, groups, h."""
    ranked = average_ranks(rows, value)
    per = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t")).select("n", "groups", (12 / (F.col("n") * (F.col("n") + 1)) * F.col("t") - 3 * (F.col("n") + 1)).alias("h"))


def wilcoxon_signed_rank(deltas: DataFrame, key: str, delta: str) -> DataFrame:
    """key, n, w, p by the normal approximation; zeros are left out. Ranks of |delta| come from counts of distinct values by ranges, so no key is one task."""
    d = deltas.where(F.col(delta) != 0).select(F.col(key).alias("key"), F.abs(delta).alias("size"), (F.col(delta) > 0).cast("long").alias("up"))
    sizes = ranked_values(d, "key", "size")
    first = sizes.groupBy("key").agg(F.min("_before").alias("_first"), F.sum("_n").alias("n"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("ties"))
    ups = d.groupBy("key", "size").agg(F.sum("up").alias("ups"))
    rank = F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2
    sums = sizes.join(ups, ["key", "size"]).join(first.select("key", "_first"), "key").groupBy("key").agg(F.sum(F.col("ups") * rank).alias("plus")).join(first, "key")
    n = F.col("n").cast("double")
    w = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    sd = F.sqrt(F.greatest(F.lit(1e-12), n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    tested = sums.select("key", "n", w.alias("w"), erfc(F.abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)).alias("p"))
    return deltas.select(F.col(key).alias("key")).distinct().join(tested, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def bootstrap_draws(rows: DataFrame, draws: int, id_: str, seed: int = 7) -> DataFrame:
    """rows and draw, times: for each draw, how often a row is taken; Poisson(1) counts from a hash, so draws need no collecting."""
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", id_), F.lit(1 << 40)) / F.lit(float(1 << 40))
    limits, p, total = [], math.exp(-1), 0.0
    for k in range(9):
        total += p
        limits.append(total)
        p /= k + 1
    times = F.reduce(F.array(*[F.lit(x) for x in limits]), F.lit(0), lambda s, x: s + F.when(F.col("_u") >= x, 1).otherwise(0))
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", u).withColumn("times", times).drop("_u").where("times > 0")


def shuffled_labels(rows: DataFrame, label: str, id_: str, permutations: int, seed: int = 11) -> DataFrame:
    """rows once per permutation (from 1), with label moved along a hash order; permutation 0 keeps it. Places come from ranges, so no permutation is one task."""
    many = rows.select(id_, label).withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    key = F.when(F.col("permutation") > 0, F.xxhash64(F.lit(seed), "permutation", id_)).otherwise(F.lit(0))
    left = ranked_values(many, "permutation", id_).select("permutation", F.col("_before").alias("place"), id_)
    right = many.withColumn("_key", key)
    right = ranked_values(right, "permutation", "_key", id_).join(right, ["permutation", "_key", id_]).select("permutation", F.col("_before").alias("place"), label)
    return left.join(right, ["permutation", "place"]).drop("place")
