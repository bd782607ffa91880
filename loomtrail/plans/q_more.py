"""More queries: comparisons of groups over shared tasks, curves, features and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators import statistics as A
from .q_sequences import trigrams
from .q_statistics import outcomes
from .registry import TRACES, query, rounded, table, traces


@query(f"""
WITH {TRACES}, c AS (SELECT k, agent, count(*) AS n FROM ev GROUP BY k, agent)
SELECT k AS item, count(*) AS agents, max(n) - min(n) AS spread, round(stddev_pop(n) / avg(n), 6) AS cv FROM c GROUP BY k HAVING count(*) >= 2""")
def task_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces(spark, sf_dir).groupBy("k", "agent").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("k").alias("item")).agg(F.count("*").alias("agents"), (F.max("n") - F.min("n")).alias("spread"), rounded(F.stddev_pop("n") / F.avg("n")).alias("cv")).where("agents >= 2")


@query(f"""
WITH {TRACES}, c AS (SELECT k, agent, count(*) AS n FROM ev GROUP BY k, agent HAVING count(*) FILTER (type = 'purchase') > 0)
SELECT a.agent AS group_a, b.agent AS group_b, count(*) AS ties, round(avg(a.n - b.n), 6) AS mean_difference FROM c a JOIN c b ON a.k = b.k AND a.agent < b.agent GROUP BY 1, 2""")
def tied_outcome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces(spark, sf_dir).groupBy("k", "agent").agg(F.count("*").alias("n"), F.max(F.col("type") == "purchase").alias("resolved")).where("resolved")
    a, b = (c.select("k", F.col("agent").alias(f"group_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    return a.join(b, "k").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("ties"), rounded(F.avg(F.col("n_a") - F.col("n_b"))).alias("mean_difference"))


@query(f"WITH {TRACES}, t AS (SELECT id, count(*) AS len, sum(value) AS v FROM ev GROUP BY id) SELECT atom, count(*) AS n, count(DISTINCT ev.id) AS traces, round(sum(v / len), 3) AS cost FROM ev JOIN t ON ev.id = t.id GROUP BY atom")
def cost_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    w = Window.partitionBy("id")
    shared = rows.withColumn("c", F.sum("value").over(w) / F.count("*").over(w))
    return shared.groupBy("atom").agg(F.count("*").alias("n"), F.countDistinct("id").alias("traces"), F.round(F.sum("c"), 3).alias("cost"))


@query(f"""
WITH {TRACES}, l AS (SELECT DISTINCT agent, k % 40 AS op FROM ev WHERE type = 'purchase'), need AS (SELECT DISTINCT id, agent, k % 40 AS op FROM ev WHERE type = 'error'),
m AS (SELECT n.id, n.agent, bool_and(l.op IS NOT NULL) AS owns FROM need n LEFT JOIN l ON l.agent = n.agent AND l.op = n.op GROUP BY n.id, n.agent)
SELECT agent, round(avg(CASE WHEN owns THEN 1.0 ELSE 0.0 END), 6) AS gap FROM m GROUP BY agent""")
def composition_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).withColumn("op", F.pmod("k", F.lit(40)))
    library = rows.where("type = 'purchase'").select("agent", "op").distinct().withColumn("known", F.lit(True))
    owns = rows.where("type = 'error'").select("id", "agent", "op").distinct().join(library, ["agent", "op"], "left").groupBy("id", "agent").agg(F.bool_and(F.col("known").isNotNull()).alias("owns"))
    return owns.groupBy("agent").agg(rounded(F.avg(F.col("owns").cast("double"))).alias("gap"))


@query(f"WITH {TRACES}, f AS (SELECT CAST(min(ts) AS DATE) AS day FROM ev GROUP BY k), n AS (SELECT day, count(*) AS n FROM f GROUP BY day) SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS seen FROM n")
def accumulation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = traces(spark, sf_dir).groupBy("k").agg(F.min("ts").cast("date").alias("day")).groupBy("day").count()  # a row a day from here
    return first.select("day", F.sum("count").over(Window.orderBy("day")).alias("seen"))


BUCKET_JSD = f"""
WITH {TRACES}, c AS (SELECT k % 5 AS bucket, agent, type, count(*) AS n FROM ev GROUP BY ALL), d AS (SELECT bucket, agent, type, n / sum(n) OVER (PARTITION BY bucket, agent) AS p FROM c),
g AS (SELECT DISTINCT bucket, agent FROM c), v AS (SELECT DISTINCT type FROM c), f AS (SELECT g.bucket, g.agent, v.type, coalesce(p, 0) AS p FROM g CROSS JOIN v LEFT JOIN d USING (bucket, agent, type)),
j AS (SELECT a.bucket, a.agent AS x, b.agent AS y, sum(CASE WHEN a.p > 0 THEN a.p / 2 * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p / 2 * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) AS jsd FROM f a JOIN f b ON a.bucket = b.bucket AND a.type = b.type AND a.agent < b.agent GROUP BY 1, 2, 3)
SELECT bucket, count(*) AS pairs, round(avg(jsd), 6) AS mean_jsd, round(min(jsd), 6) AS min_jsd, round(max(jsd), 6) AS max_jsd FROM j GROUP BY bucket"""


@query(BUCKET_JSD)
def jsd_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy(F.pmod("k", F.lit(5)).alias("bucket"), "agent", "type").agg(F.count("*").alias("n"))
    dist = A.distribution(counts.withColumn("g", F.struct("bucket", "agent")), "g", "type").withColumn("bucket", F.col("g.bucket"))
    return A.jsd_matrix(dist, "g", "type", within="bucket").groupBy("bucket").agg(F.count("*").alias("pairs"), *[rounded(f("jsd")).alias(f"{n}_jsd") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


@query(f"WITH {TRACES} SELECT agent, type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 5) AS mean FROM ev WHERE type IN (SELECT type FROM ev GROUP BY type HAVING count(*) >= 100) GROUP BY agent, type")
def coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    valid = rows.groupBy("type").count().where("count >= 100").select("type")
    return rows.join(valid, "type", "left_semi").groupBy("agent", "type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 5).alias("mean"))


SPLIT = f"{TRACES}, h AS (SELECT id, k, bool_or(pos % 2 = 0) AS stated, bool_or(pos % 2 = 1) AS observed FROM (SELECT id, k % 20 AS k, pos FROM ev) GROUP BY id, k), n AS (SELECT id, count(*) FILTER (stated) AS s, count(*) FILTER (observed) AS o, count(*) FILTER (stated AND observed) AS b FROM h GROUP BY id)"


def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, s, o, b: sizes of two sets of each trace and of what they share."""
    h = traces(spark, sf_dir).groupBy("id", F.pmod("k", F.lit(20)).alias("k")).agg(F.bool_or(F.col("pos") % 2 == 0).alias("stated"), F.bool_or(F.col("pos") % 2 == 1).alias("observed"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return h.groupBy("id").agg(n("stated").alias("s"), n("observed").alias("o"), n("stated AND observed").alias("b"))


@query(f"WITH {SPLIT} SELECT id, round(b / nullif(s + o - b, 0), 6) AS jaccard, round(b / nullif(s, 0), 6) AS forward_coverage, round(b / nullif(o, 0), 6) AS reverse_coverage FROM n")
def stated_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s, o = map(F.col, "bso")
    return split_sets(spark, sf_dir).select("id", rounded(F.try_divide(b, s + o - b)).alias("jaccard"), rounded(F.try_divide(b, s)).alias("forward_coverage"), rounded(F.try_divide(b, o)).alias("reverse_coverage"))


@query(f"WITH {SPLIT} SELECT id, round(coalesce(b / nullif(s, 0), 0), 6) AS precision, round(coalesce(b / nullif(o, 0), 0), 6) AS recall, round(coalesce(2 * b / nullif(s + o, 0), 0), 6) AS f1 FROM n")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s, o = map(F.col, "bso")
    share = lambda x, y: rounded(F.coalesce(F.try_divide(x, y), F.lit(0.0)))
    return split_sets(spark, sf_dir).select("id", share(b, s).alias("precision"), share(b, o).alias("recall"), share(2 * b, s + o).alias("f1"))


@query(f"""
WITH {TRACES}, p AS (SELECT id, string_agg(left(type, 1), '' ORDER BY pos) AS s FROM ev GROUP BY id), o AS (SELECT id, arg_max(type, pos) = 'purchase' AS passed FROM ev GROUP BY id), m AS (SELECT s AS template FROM p JOIN o USING (id) WHERE passed GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT levenshtein(s, template) AS distance, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p JOIN o USING (id), m GROUP BY 1""")
def modal_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    p = S.sequences(rows.withColumn("c", F.left("type", F.lit(1))), ["id"], "c").select("id", F.array_join("seq", "").alias("s")).join(outcomes(spark, sf_dir), "id")
    top = p.where("passed").groupBy("s").count().orderBy(F.desc("count"), "s").limit(1).select(F.col("s").alias("template"))
    return p.join(F.broadcast(top)).groupBy(F.levenshtein("s", "template").cast("long").alias("distance")).agg(F.count("*").alias("n"), rounded(F.avg(F.col("passed").cast("double"))).alias("rate"))


PATTERNS = {"look_edit_test": "SEARCH .*EDIT_SRC_PY .*RUN_PYTEST_TEST_PY ", "edit_edit": "EDIT_SRC_PY .*EDIT_SRC_PY ", "open_submit": "OPEN_SRC_PY .*SUBMIT "}


@query(f"WITH {TRACES}, s AS (SELECT id, string_agg(atom, ' ' ORDER BY pos) || ' ' AS s FROM ev GROUP BY id) SELECT id, " + ", ".join(f"CAST(regexp_matches(s, '{p}') AS INTEGER) AS {k}" for k, p in PATTERNS.items()) + " FROM s")
def subsequence_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sequences(traces(spark, sf_dir), ["id"], "atom").withColumn("s", F.concat(F.array_join("seq", " "), F.lit(" ")))
    return s.select("id", *[F.col("s").rlike(p).cast("int").alias(k) for k, p in PATTERNS.items()])


@query(f"WITH {TRACES}, f AS (SELECT * FROM ev WHERE pos <= 10) SELECT id, atom, round(count(*) / any_value(n), 6) AS share FROM f JOIN (SELECT id, count(*) AS n FROM f GROUP BY id) USING (id) GROUP BY id, atom")
def early_action_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = traces(spark, sf_dir).where("pos <= 10").groupBy("id", "atom").agg(F.count("*").alias("n"))
    return f.select("id", "atom", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("share"))


@query(f"""
WITH {TRACES}, t AS (SELECT unnest([3, 5, 10, 20]) AS steps), c AS (SELECT steps, agent, type, count(*) AS n FROM ev, t WHERE pos <= steps GROUP BY ALL), d AS (SELECT steps, agent, type, n / sum(n) OVER (PARTITION BY steps, agent) AS p FROM c),
g AS (SELECT DISTINCT steps, agent FROM c), v AS (SELECT DISTINCT type FROM c), f AS (SELECT g.steps, g.agent, v.type, coalesce(p, 0) AS p FROM g CROSS JOIN v LEFT JOIN d USING (steps, agent, type)),
j AS (SELECT a.steps, a.agent AS agent_a, b.agent AS agent_b, a.p AS a, b.p AS b FROM f a JOIN f b ON a.steps = b.steps AND a.type = b.type AND a.agent < b.agent)
SELECT steps, agent_a, agent_b, round(sum(CASE WHEN a > 0 THEN a / 2 * ln(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b / 2 * ln(2 * b / (a + b)) ELSE 0 END), 6) AS jsd FROM j GROUP BY ALL""")
def jsd_at_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    steps = rows.withColumn("steps", F.explode(F.filter(F.array(*map(F.lit, (3, 5, 10, 20))), lambda t: t >= F.col("pos"))))
    dist = A.distribution(steps.groupBy("steps", "agent", "type").agg(F.count("*").alias("n")).withColumn("g", F.struct("steps", "agent")), "g", "type")
    j = A.jsd_matrix(dist.withColumn("steps", F.col("g.steps")), "g", "type", 2.718281828459045, within="steps")
    return j.select("steps", F.col("group_a.agent").alias("agent_a"), F.col("group_b.agent").alias("agent_b"), rounded(F.col("jsd")).alias("jsd"))


@query(f"""
WITH {TRACES}, e AS (SELECT DISTINCT agent, type || '>' || nxt AS edge FROM (SELECT agent, type, k % 3 AS z, lead(type || k % 7) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM ev) WHERE nxt IS NOT NULL),
n AS (SELECT agent, count(*) AS n FROM e GROUP BY agent), b AS (SELECT x.agent AS group_a, y.agent AS group_b, count(*) AS b FROM e x JOIN e y ON x.edge = y.edge AND x.agent < y.agent GROUP BY 1, 2)
SELECT group_a, group_b, round(1 - b / (p.n + q.n - b), 6) AS distance FROM b JOIN n p ON p.agent = group_a JOIN n q ON q.agent = group_b""")
def graph_edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos")
    nxt = F.lead(F.concat("type", F.pmod("k", F.lit(7)).cast("string"))).over(w)
    e = traces(spark, sf_dir).select("agent", "type", nxt.alias("nxt")).where("nxt IS NOT NULL").select("agent", F.concat_ws(">", "type", "nxt").alias("edge")).distinct()
    n = e.groupBy("agent").agg(F.count("*").alias("n"))
    x, y = (e.select(F.col("agent").alias(f"group_{s}"), "edge") for s in "ab")
    b = x.join(y, "edge").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("b"))
    size = lambda s: F.broadcast(n.select(F.col("agent").alias(f"group_{s}"), F.col("n").alias(f"n_{s}")))  # noqa: E731  a row per agent
    return b.join(size("a"), "group_a").join(size("b"), "group_b").select("group_a", "group_b", rounded(1 - F.col("b") / (F.col("n_a") + F.col("n_b") - F.col("b"))).alias("distance"))


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM embeddings GROUP BY label")
def region_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg((F.pmod("vec_id", F.lit(3)) == 0).cast("double"))).alias("rate"))


@query(f"""
WITH {TRACES}, d AS (SELECT CAST(min(ts) AS DATE) AS day FROM ev GROUP BY k), n AS (SELECT day, count(*) AS n FROM d GROUP BY day), r AS (SELECT day, row_number() OVER (ORDER BY day) AS rank, avg(n) OVER (ORDER BY day ROWS 2 PRECEDING) AS m FROM n)
SELECT CAST(min(rank) FILTER (m < 2) AS INTEGER) AS knee FROM r""")
def saturation_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = traces(spark, sf_dir).groupBy("k").agg(F.min("ts").cast("date").alias("day")).groupBy("day").count()  # a row a day
    w = Window.orderBy("day")
    r = n.select(F.row_number().over(w).alias("rank"), F.avg("count").over(w.rowsBetween(-2, 0)).alias("m"))
    return r.agg(F.min(F.when(F.col("m") < 2, F.col("rank"))).alias("knee"))


@query(f"WITH {TRACES} SELECT k AS file, count(*) FILTER (type = 'view') AS opened, count(*) FILTER (type = 'purchase') AS edited, count(DISTINCT id) AS sessions FROM ev GROUP BY k")
def file_action_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count(F.when(F.col("type") == t, 1))
    return traces(spark, sf_dir).groupBy(F.col("k").alias("file")).agg(n("view").alias("opened"), n("purchase").alias("edited"), F.countDistinct("id").alias("sessions"))


@query("""
SELECT r_name, n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderpriority)""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    return rows.rollup("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH e AS (SELECT *, epoch(ts) AS sec FROM events), g AS (SELECT user_id, event_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) < 86400 THEN 0 ELSE 1 END AS opens FROM e), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    s = e.withColumn("opens", F.when(F.col("at") - F.lag("at").over(w) < 86400, 0).otherwise(1)).withColumn("session", F.sum("opens").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query()
def outcome_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of predicting a trace's outcome from its n-gram counts; folds keep an id together."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer

    grams = trigrams(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    rows = grams.join(outcomes(spark, sf_dir), "id").select("id", "grams", F.col("passed").cast("double").alias("label"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("fold"))
    counts = CountVectorizer(inputCol="grams", outputCol="counts", minDF=2.0).fit(rows).transform(rows)
    data = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counts).select("label", "features", "fold").persist()
    out = []
    for fold in range(3):
        model = LogisticRegression(regParam=0.01, maxIter=30).fit(data.where(F.col("fold") != fold))
        hit = model.transform(data.where(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count("*")).first()
        out.append((fold, hit[1], hit[0]))
    data.unpersist()
    return spark.createDataFrame(out, "fold int, n long, accuracy double")


@query()
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means over vectors, k by silhouette: label, cluster, n."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    best = max((KMeans(k=k, seed=1, maxIter=10).fit(rows) for k in (5, 10)), key=lambda m: ClusteringEvaluator().evaluate(m.transform(rows)))
    return best.transform(rows).groupBy("label", F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))
