"""Queries over pairs, neighbours, coverage and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignments as L
from ..operators import blocks as B
from ..operators import distances as D
from ..operators import sequences as S
from .registry import TRACES, half_up, query, rounded, table, traces

CERTS = f"{TRACES}, cert AS (SELECT id, any_value(agent) AS agent, list_sort(list(DISTINCT k % 12)) AS ops FROM ev GROUP BY id)"


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, ops: the set of operations of each trace."""
    return traces(spark, sf_dir).groupBy("id").agg(F.first("agent").alias("agent"), F.sort_array(F.collect_set(F.pmod("k", F.lit(12)))).alias("ops"))


@query(f"""
WITH {CERTS}, p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.ops, b.ops)) AS i, len(a.ops) AS x, len(b.ops) AS y FROM cert a JOIN cert b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT id_a, id_b, round(1 - i / (x + y - i), 6) AS jaccard, round((x + y - 2 * i) / (x + y), 6) AS dice FROM p""")
def set_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("ops_a"), F.col("ops_b")
    return D.stated_pairs(certificates(spark, sf_dir), "id", ["ops"], EVERY).select("id_a", "id_b", rounded(D.jaccard_distance(a, b)).alias("jaccard"), rounded(D.dice_distance(a, b)).alias("dice"))


def letters(rows: DataFrame) -> DataFrame:
    """id, seq: the first letters of the types of each trace, in order; those without one are left out, and a trace without a type is null."""
    seq = F.col("seq")
    first = F.transform(F.filter(seq, lambda t: F.length(t) > 0), lambda t: F.substring(t, 1, 1))
    return S.sequences(rows, ["id"], "type").select("id", F.when(F.exists(seq, lambda t: t.isNotNull()), first).alias("seq"))


@query(f"WITH {TRACES}, s AS (SELECT id, string_agg(left(type, 1), '' ORDER BY pos) AS s FROM ev GROUP BY id) SELECT a.id AS id_a, b.id AS id_b, round(levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS distance FROM s a JOIN s b ON a.id % 20 = 0 AND a.id <> b.id")
def token_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stated_distances(letters(traces(spark, sf_dir)), "id", EVERY, {"distance": ("seq", "edit")}).select("id_a", "id_b", half_up(F.col("distance")).alias("distance"))


@query()
def dtw_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = S.sequences(traces(spark, sf_dir), ["id"], "type")
    return L.stated_distances(seqs, "id", EVERY, {"similarity": ("seq", "warping")}).select("id_a", "id_b", half_up(F.col("similarity")).alias("similarity"))


HALVES = f"{TRACES}, ref AS (SELECT k FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY k HAVING count(*) >= 2), new AS (SELECT id, k FROM ev WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY id, k)"


@query(f"WITH {HALVES} SELECT new.id, count(*) AS n_items, round(count(*) FILTER (ref.k IS NULL) / count(*), 6) AS ood_score FROM new LEFT JOIN ref ON new.k = ref.k GROUP BY new.id")
def ood_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    known = rows.where("ts < TIMESTAMP_NTZ '2024-01-16'").groupBy("k").agg(F.count("*").alias("known")).where("known >= 2")
    items = rows.where("ts >= TIMESTAMP_NTZ '2024-01-16'").select("id", "k").distinct()
    return items.join(known, "k", "left").groupBy("id").agg(F.count("*").alias("n_items"), rounded(F.count(F.when(F.col("known").isNull(), 1)) / F.count("*")).alias("ood_score"))


@query(f"WITH {TRACES}, n AS (SELECT k, count(DISTINCT id) AS users FROM ev GROUP BY k), i AS (SELECT DISTINCT id, k FROM ev) SELECT id, round(avg(CASE WHEN users <= 1 THEN 1.0 ELSE 0.0 END), 6) AS ood FROM i JOIN n USING (k) GROUP BY id")
def leave_one_out_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = traces(spark, sf_dir).select("id", "k").distinct()
    users = items.groupBy("k").agg(F.count("*").alias("users"))
    return items.join(users, "k").groupBy("id").agg(rounded(F.avg((F.col("users") <= 1).cast("double"))).alias("ood"))


# Neighbours and pairs of vectors: the queries are the rows whose id is divisible by 20, held against all rows.
VECTORS = "v AS (SELECT vec_id AS i, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.i, b.i AS j, a.label AS li, b.label AS lj, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.i <> b.i)"
ASKED = f"{VECTORS}, q AS (SELECT * FROM d WHERE i % 20 = 0)"
EVERY = 20


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return B.nearest(v.where(F.pmod("id", F.lit(EVERY)) == 0), v, k)


@query(f"WITH {ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rk FROM q) SELECT i, round(avg(CASE WHEN lj >= 5 THEN 1.0 ELSE 0.0 END), 6) AS predicted FROM r WHERE rk <= 5 GROUP BY i")
def knn_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 5).groupBy("i").agg(rounded(F.avg((F.col("lj") >= 5).cast("double"))).alias("predicted"))


@query(f"""WITH {ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rk FROM q), p AS (SELECT i, any_value(li) >= 5 AS truth, avg(CASE WHEN lj >= 5 THEN 1.0 ELSE 0.0 END) >= 0.5 AS guess FROM r WHERE rk <= 5 GROUP BY i),
c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM p) SELECT tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def knn_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = neighbours(spark, sf_dir, 5).groupBy("i").agg((F.first("li") >= 5).alias("truth"), (F.avg((F.col("lj") >= 5).cast("double")) >= 0.5).alias("guess"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    c = p.agg(n("truth AND guess").alias("tp"), n("NOT truth AND guess").alias("fp"), n("truth AND NOT guess").alias("fn"))
    return c.withColumn("f1", rounded(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


@query(f"WITH {ASKED}, n AS (SELECT i, min(round(d, 9)) AS d FROM q GROUP BY i), t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN d <= threshold THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM n, t GROUP BY threshold")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(spark, sf_dir, 1)
    ts = (0.2, 0.4, 0.6, 0.8, 1.0)
    one = near.agg(*[F.avg((F.col("d") <= t).cast("double")).alias(f"t{k}") for k, t in enumerate(ts)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), rounded(F.col(f"t{k}")).alias("coverage")) for k, t in enumerate(ts)])).alias("s")).select("s.*")


@query(f"WITH {VECTORS} SELECT i, round(min(d) FILTER (lj >= 5), 6) AS to_passed, round(avg(d) FILTER (lj >= 5), 6) AS mean_to_passed FROM d WHERE i % 20 = 0 GROUP BY i")
def distance_to_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of the passed side, and the mean distance to that side, which follows from the sum of its vectors."""
    v = vectors(spark, sf_dir)
    asked, passed = v.where(F.pmod("id", F.lit(EVERY)) == 0), v.where("label >= 5")
    near = B.nearest(asked, passed, 1).select("i", rounded(F.col("d")).alias("to_passed"))
    unit = v.select("id", (F.col("label") >= 5).alias("label"), D.normalised(F.col("v")).alias("v"))
    side = B.label_sums(unit.where("label"))
    own = F.col("label").cast("int")
    mean = unit.where(F.pmod("id", F.lit(EVERY)) == 0).join(F.broadcast(side.select("n", "s"))).select(F.col("id").alias("i"), rounded((F.col("n") - D.dot(F.col("v"), F.col("s"))) / (F.col("n") - own)).alias("mean_to_passed"))  # one row
    return near.join(mean, "i")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "label", D.normalised(F.col("v")).alias("v"))


@query(f"WITH {VECTORS} SELECT li AS label, round(avg(d) FILTER (li = lj) / avg(d) FILTER (li <> lj), 6) AS ratio FROM d GROUP BY li")
def stratum_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance within a label over that to all others, of all pairs: unit vectors of sums s and t have the mean 1 - s.t / (n m)."""
    sums = B.label_sums(unit_vectors(spark, sf_dir))  # a row a label
    total = sums.agg(F.sum("n").alias("all_n"), F.collect_list("s").alias("all_s")).select("all_n", F.expr("aggregate(all_s, transform(all_s[0], x -> 0D), (a, b) -> zip_with(a, b, (x, y) -> x + y))").alias("all_s"))
    r, n, m = sums.join(F.broadcast(total)), F.col("n"), F.col("all_n") - F.col("n")  # one row
    inside = (n * n - D.dot(F.col("s"), F.col("s"))) / (n * (n - 1))
    outside = (n * m - D.dot(F.col("s"), F.col("all_s")) + D.dot(F.col("s"), F.col("s"))) / (n * m)
    return r.select("label", rounded(inside / outside).alias("ratio"))


@query(f"WITH {VECTORS} SELECT li AS label, round(1 - avg(d), 6) AS convergence FROM d WHERE li = lj GROUP BY li")
def response_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs of a label, from the label's sum."""
    n = F.col("n")
    return B.label_sums(unit_vectors(spark, sf_dir)).where("n > 1").select("label", rounded((D.dot(F.col("s"), F.col("s")) - n) / (n * (n - 1))).alias("convergence"))


@query(f"""WITH {VECTORS}, m AS (SELECT i, li, lj, avg(d) AS m FROM d GROUP BY i, li, lj), s AS (SELECT i, max(m) FILTER (lj = li) AS a, min(m) FILTER (lj <> li) AS b FROM m GROUP BY i)
SELECT i, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all vectors over all pairs: the mean distance to a label follows from the label's sum. Labels are a class of the data, few rows."""
    v = unit_vectors(spark, sf_dir)
    sums = B.label_sums(v).select(F.col("label").alias("other"), "n", "s")
    same = F.col("label") == F.col("other")
    mean = v.join(F.broadcast(sums)).select("id", "label", "other", ((F.col("n") - D.dot(F.col("v"), F.col("s"))) / (F.col("n") - same.cast("int"))).alias("m"))
    return D.silhouette_of_means(mean).select(F.col("id").alias("i"), rounded(F.col("silhouette")).alias("silhouette"))


@query(f"WITH {ASKED}, p AS (SELECT li = lj AS inside, round(d, 4) AS d FROM q), r AS (SELECT inside, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS rk FROM p), s AS (SELECT sum(CASE WHEN inside THEN rk END) AS s, count(*) FILTER (inside) AS a, count(*) FILTER (NOT inside) AS b FROM r) SELECT round(1 - (s - a * (a + 1) / 2) / (a * b), 6) AS overlap FROM s")
def stratum_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a distance within a label is smaller than one between labels, over all pairs of queries and rows."""
    v = vectors(spark, sf_dir)
    return B.weighted_auc(B.distance_counts(v.where(F.pmod("id", F.lit(EVERY)) == 0), v), "d", F.col("gap") == 0).select(rounded(1 - F.col("auc")).alias("overlap"))


@query(f"WITH {ASKED}, p AS (SELECT round(d, 4) AS x, abs(li - lj) AS y FROM q), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return B.weighted_rank_correlation(B.distance_counts(v.where(F.pmod("id", F.lit(EVERY)) == 0), v), "d", "gap").select(rounded(F.col("rho")).alias("rho"))


@query("""
WITH c AS (SELECT source AS p, lang AS r, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY r) AS nr FROM c),
s AS (SELECT sum(n / t * ln(n * t / (np * nr))) AS mi, sum(-n / t * ln(np / t)) AS hp, sum(-n / t * ln(nr / t)) AS hr, sum(n * (n - 1) / 2) AS same, sum(n * (np - 1) / 2) AS sp, sum(n * (nr - 1) / 2) AS sr, max(t * (t - 1) / 2) AS al, max(t) AS n FROM m)
SELECT CAST(n AS BIGINT) AS n, round(mi / hr, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * mi / (hp + hr), 6) AS v_measure, round((same - sp * sr / al) / ((sp + sr) / 2 - sp * sr / al), 6) AS ari, round(2 * mi / (hp + hr), 6) AS nmi FROM s""")
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.cluster_metrics(table(spark, sf_dir, "documents"), "source", "lang")
    return m.select("n", *[rounded(F.col(c)).alias(c) for c in ("homogeneity", "completeness", "v_measure", "ari", "nmi")])


@query(f"WITH {CERTS}, x AS (SELECT id, agent, unnest(ops) AS op FROM cert) SELECT agent, op, count(*) AS n, round(count(*) / any_value(t), 6) AS share FROM x JOIN (SELECT agent, count(*) AS t FROM cert GROUP BY agent) USING (agent) GROUP BY agent, op")
def population_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = certificates(spark, sf_dir)
    total = certs.groupBy("agent").agg(F.count("*").alias("t"))
    ops = certs.select("agent", F.explode("ops").alias("op")).groupBy("agent", "op").agg(F.count("*").alias("n"))
    return ops.join(F.broadcast(total), "agent").select("agent", "op", "n", rounded(F.col("n") / F.col("t")).alias("share"))


STEPS = 12


@query()
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STEPS vectors that a greedy order takes first, each the farthest from those taken; the first is the smallest id. One pass over all rows a step."""
    return D.farthest_first(unit_vectors(spark, sf_dir), STEPS).withColumn("distance", rounded(F.col("distance")))


@query()
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STEPS queries (ids divisible by 20) that greedily cover most of all vectors within a cosine distance of 0.7."""
    v = vectors(spark, sf_dir)
    return D.greedy_cover(B.within(v.where(F.pmod("id", F.lit(EVERY)) == 0), v, 0.7), STEPS)


@query("SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS running FROM lineitem")
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_extendedprice").over(w), 2).alias("running"))
