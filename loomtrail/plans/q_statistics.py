"""Queries over counts, distributions and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators import statistics as A
from .registry import TRACES, query, rounded, table, traces

PAIRS = f"{TRACES}, pr AS (SELECT agent, type || '>' || lead(type) OVER (PARTITION BY id ORDER BY pos) AS pair FROM ev), c AS (SELECT agent, pair AS item, count(*) AS n FROM pr WHERE pair IS NOT NULL GROUP BY agent, pair), d AS (SELECT agent, item, n / sum(n) OVER (PARTITION BY agent) AS p FROM c)"


def pair_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.adjacent_pairs(traces(spark, sf_dir), ["id", "agent"], "type")
    return pairs.groupBy("agent", F.concat_ws(">", "a", "b").alias("item")).agg(F.count("*").alias("n"))


def pair_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(pair_items(spark, sf_dir), "agent", "item")


def jsd_sql(log: str) -> str:
    return f"""
WITH {PAIRS}, v AS (SELECT DISTINCT item FROM d), g AS (SELECT DISTINCT agent FROM d), f AS (SELECT g.agent, v.item, coalesce(d.p, 0) AS p FROM g CROSS JOIN v LEFT JOIN d ON d.agent = g.agent AND d.item = v.item)
SELECT a.agent AS group_a, b.agent AS group_b, round(sum(CASE WHEN a.p > 0 THEN a.p / 2 * {log}(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p / 2 * {log}(2 * b.p / (a.p + b.p)) ELSE 0 END), 6) AS jsd
FROM f a JOIN f b ON a.item = b.item AND a.agent < b.agent GROUP BY a.agent, b.agent"""


@query(jsd_sql("log2"))
def jsd_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.jsd_matrix(pair_shares(spark, sf_dir), "agent", "item").select("group_a", "group_b", rounded(F.col("jsd")).alias("jsd"))


@query(jsd_sql("ln"))
def jsd_pair_matrix_nats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.jsd_matrix(pair_shares(spark, sf_dir), "agent", "item", 2.718281828459045).select("group_a", "group_b", rounded(F.col("jsd")).alias("jsd"))


@query(f"WITH {PAIRS} SELECT agent, item, n, round(p, 6) AS share FROM c JOIN d USING (agent, item)")
def token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_items(spark, sf_dir).withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("agent"))))


@query(f"WITH {PAIRS} SELECT agent, round(-sum(p * log2(p)), 6) AS entropy_bits, round(pow(2, -sum(p * log2(p))), 6) AS effective_size FROM d GROUP BY agent")
def entropy_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entropy(pair_shares(spark, sf_dir), "agent").select("agent", rounded(F.col("entropy_bits")).alias("entropy_bits"), rounded(F.col("effective_size")).alias("effective_size"))


@query(f"WITH {PAIRS}, r AS (SELECT agent, row_number() OVER w AS rank, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY agent) AS total FROM c WINDOW w AS (PARTITION BY agent ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING)) SELECT agent, CAST(min(rank) AS INTEGER) AS width FROM r WHERE upto >= 0.8 * total GROUP BY agent")
def repertoire_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.width_at_coverage(pair_items(spark, sf_dir), "agent", "item", 0.8)


@query(f"WITH {PAIRS}, t AS (SELECT agent, item, n, sum(n) OVER (PARTITION BY item) AS c, sum(n) OVER (PARTITION BY agent) AS aa, sum(n) OVER () AS cc FROM c) SELECT agent, item, round(log2(((n + 1) / (aa + 1)) / ((c + 1) / (cc + 1))), 6) AS log_odds FROM t WHERE c >= 5")
def novelty_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.novelty(pair_items(spark, sf_dir), "agent", "item").withColumn("log_odds", rounded(F.col("log_odds")))


@query("""
SELECT count(*) AS records, count(*) FILTER (text IS NOT NULL AND text <> '') AS with_text, count(DISTINCT source) AS sources, min(n_chars) AS n_min, list_sort(list(n_chars))[count(*) // 2 + 1] AS n_median, max(n_chars) AS n_max, CAST(sum(n_chars) AS BIGINT) AS n_total FROM documents""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("n_chars").agg(F.count("*").alias("many"))
    upto = sizes.withColumns({"upto": F.sum("many").over(Window.orderBy("n_chars")), "all": F.sum("many").over(Window.partitionBy())})
    median = upto.agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n_chars"))).alias("n_median"))
    return docs.agg(
        F.count("*").alias("records"), F.count(F.when(F.col("text") != "", 1)).alias("with_text"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("n_min"), F.max("n_chars").alias("n_max"), F.sum("n_chars").alias("n_total")
    ).join(F.broadcast(median))  # one row each


@query(f"WITH {TRACES} SELECT agent, type, count(*) AS n, round(avg(value), 4) AS mean_value FROM ev GROUP BY GROUPING SETS ((agent, type), (agent), ())")
def type_counts_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    return rows.groupingSets([["agent", "type"], ["agent"], []], "agent", "type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


OUTCOME = f"{TRACES}, o AS (SELECT id, any_value(agent) AS agent, arg_max(type, pos) = 'purchase' AS passed, count(*) AS n_steps FROM ev GROUP BY id)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("id").agg(F.first("agent").alias("agent"), (F.max_by("type", "pos") == "purchase").alias("passed"), F.count("*").alias("n_steps"))


@query(f"WITH {TRACES} SELECT k AS item, round(avg(CASE WHEN type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS ease, count(DISTINCT agent) AS agents FROM ev GROUP BY k")
def ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy(F.col("k").alias("item")).agg(rounded(F.avg((F.col("type") == "purchase").cast("double"))).alias("ease"), F.countDistinct("agent").alias("agents"))


MI = "c AS (SELECT {x} AS x, {y} AS y{z}, count(*) AS n FROM {t} GROUP BY ALL)"


@query(f"""
WITH {TRACES}, c AS (SELECT agent AS x, type AS y, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, round(greatest(sum(n / t * log2(n * t / (nx * ny))), 0), 6) AS mi_bits, round(greatest(sum(n / t * log2(n * t / (nx * ny))), 0) / sum(-n / t * log2(ny / t)), 6) AS mi_share FROM m""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy("agent", "type").agg(F.count("*").alias("n"))
    return A.mutual_information(counts, "agent", "type").select("n", rounded(F.col("mi_bits")).alias("mi_bits"), rounded(F.col("mi_share")).alias("mi_share"))


@query(f"""
WITH {TRACES}, c AS (SELECT agent AS x, type AS y, k % 5 AS z, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY z) AS t, sum(n) OVER (PARTITION BY x, z) AS nx, sum(n) OVER (PARTITION BY y, z) AS ny FROM c),
s AS (SELECT z, sum(n) AS nz, greatest(sum(n / t * log2(n * t / (nx * ny))), 0) AS mi FROM m GROUP BY z)
SELECT round(sum(CASE WHEN nz >= 2 THEN nz * mi ELSE 0 END) / sum(nz), 6) AS cmi_bits FROM s""")
def conditional_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy("agent", "type", F.pmod("k", F.lit(5)).alias("z")).agg(F.count("*").alias("n"))
    return A.conditional_mutual_information(counts, "agent", "type", "z").select(rounded(F.col("cmi_bits")).alias("cmi_bits"))


@query("""
WITH g AS (SELECT o_orderpriority AS grp, avg(o_totalprice) AS m FROM orders GROUP BY 1), a AS (SELECT o_orderstatus AS ag, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT round((SELECT stddev_samp(m) FROM g) / (SELECT stddev_samp(m) FROM a), 6) AS ratio, round((SELECT var_pop(m) FROM g), 3) AS group_variance""")
def variance_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    means = lambda c, s: orders.groupBy(c).agg(F.avg("o_totalprice").alias("m")).agg(F.stddev_samp("m").alias(f"sd_{s}"), F.var_pop("m").alias(f"var_{s}"))
    return means("o_orderpriority", "g").join(F.broadcast(means("o_orderstatus", "a"))).select(rounded(F.try_divide("sd_g", "sd_a")).alias("ratio"), F.round("var_g", 3).alias("group_variance"))


@query(f"""
WITH {OUTCOME}, f AS (SELECT agent, count(*) AS n, count(*) FILTER (passed) AS k FROM o GROUP BY agent), w AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM f)
SELECT agent, n, k, round(p, 6) AS rate, round(greatest(0, ((p + zz / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 6) AS low, round(least(1, ((p + zz / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 6) AS high FROM w""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).groupBy("agent").agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("k"))
    low, high = A.wilson(F.col("k"), F.col("n"))
    return rows.select("agent", "n", "k", rounded(F.col("k") / F.col("n")).alias("rate"), rounded(low).alias("low"), rounded(high).alias("high"))


LIFT = f"""{OUTCOME}, has AS (SELECT DISTINCT id, k % 10 AS motif FROM ev), m AS (SELECT DISTINCT motif FROM has),
t AS (SELECT m.motif, o.agent, count(*) FILTER (h.id IS NOT NULL AND passed) AS a, count(*) FILTER (h.id IS NOT NULL AND NOT passed) AS b, count(*) FILTER (h.id IS NULL AND passed) AS c, count(*) FILTER (h.id IS NULL AND NOT passed) AS d
FROM o CROSS JOIN m LEFT JOIN has h ON h.id = o.id AND h.motif = m.motif GROUP BY m.motif, o.agent)"""


def motif_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """motif, agent, a, b, c, d: outcomes with and without the motif. The cells without follow from each agent's totals."""
    o = outcomes(spark, sf_dir)
    has = traces(spark, sf_dir).select("id", F.pmod("k", F.lit(10)).alias("motif")).distinct().join(o, "id")
    n = lambda c: F.count(F.when(c, 1))
    passed = F.col("passed")
    total = o.groupBy("agent").agg(n(passed).alias("all_passed"), n(~passed).alias("all_failed"))
    cells = has.groupBy("motif", "agent").agg(n(passed).alias("a"), n(~passed).alias("b"))
    grid = has.select("motif").distinct().join(total)  # motifs times agents
    return grid.join(cells, ["motif", "agent"], "left").fillna(0, ["a", "b"]).select("motif", "agent", "a", "b", (F.col("all_passed") - F.col("a")).alias("c"), (F.col("all_failed") - F.col("b")).alias("d"))


@query(f"""
WITH {LIFT}, s AS (SELECT motif, sum(a * d / (a + b + c + d)) AS num, sum(b * c / (a + b + c + d)) AS den, sum((a + b) * (a + c) / (a + b + c + d)) AS ex, sum(a) AS seen,
  sum((a + b) * (a + c) * (b + d) * (c + d) / (pow(a + b + c + d, 2) * (a + b + c + d - 1))) AS var FROM t WHERE a + b + c + d >= 2 GROUP BY motif)
SELECT motif, CASE WHEN den > 0 AND var > 0 THEN round(num / den, 6) END AS odds_ratio, CASE WHEN den > 0 AND var > 0 THEN round(pow(abs(seen - ex) - 0.5, 2) / var, 6) END AS chi2 FROM s""")
def mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.mantel_haenszel(motif_tables(spark, sf_dir), ["motif"])
    return out.select("motif", rounded(F.col("odds_ratio")).alias("odds_ratio"), rounded(F.col("chi2")).alias("chi2"))


@query()
def mantel_haenszel_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.benjamini_hochberg(A.mantel_haenszel(motif_tables(spark, sf_dir), ["motif"]), "p", "motif")


@query()
def fisher_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif_tables(spark, sf_dir).withColumn("p", F.round(A.fisher_exact("a", "b", "c", "d"), 9))


@query(f"""
WITH {LIFT}, p AS (SELECT motif, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM t GROUP BY motif)
SELECT motif, round(a / nullif(a + b, 0), 6) AS rate_with, round(c / nullif(c + d, 0), 6) AS rate_without, round(log2(((a + 0.5) / (a + b + 1)) / ((c + 0.5) / (c + d + 1))), 6) AS log_odds FROM p""")
def atom_presence_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = motif_tables(spark, sf_dir).groupBy("motif").agg(*[F.sum(x).alias(x) for x in "abcd"])
    a, b, c, d = map(F.col, "abcd")
    return p.select("motif", rounded(F.try_divide(a, a + b)).alias("rate_with"), rounded(F.try_divide(c, c + d)).alias("rate_without"), rounded(F.log2(((a + 0.5) / (a + b + 1)) / ((c + 0.5) / (c + d + 1)))).alias("log_odds"))


@query("""
WITH p AS (SELECT l_suppkey AS id, 1.0 / (1 + count(*)) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p)
SELECT id, round(least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((1 / (1 + F.count("*"))).alias("p"))
    return A.benjamini_hochberg(p, "p", "id").select("id", rounded(F.col("q")).alias("q"))


@query(f"""
WITH {OUTCOME} SELECT agent, count(*) AS tasks, round(avg(n_steps), 6) AS mean_cost, median(n_steps) AS median_cost, CAST(sum(n_steps) AS BIGINT) AS total_cost, round(sum(n_steps) / nullif(count(*) FILTER (passed), 0), 6) AS cost_per_resolved FROM o GROUP BY agent""")
def efficiency_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("agent").agg(
        F.count("*").alias("tasks"), rounded(F.avg("n_steps")).alias("mean_cost"), F.percentile("n_steps", F.lit(0.5)).alias("median_cost"), F.sum("n_steps").alias("total_cost"), rounded(F.try_divide(F.sum("n_steps"), F.count(F.when(F.col("passed"), 1)))).alias("cost_per_resolved")
    )


@query(f"WITH {TRACES}, c AS (SELECT id, count(*) AS n, sum(value) AS v FROM ev GROUP BY id) SELECT round(corr(v, n), 6) AS r, round(regr_slope(v, n), 4) AS slope, round(regr_intercept(v, n), 3) AS intercept FROM c")
def length_cost_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return c.agg(rounded(F.corr("v", "n")).alias("r"), F.round(F.regr_slope("v", "n"), 4).alias("slope"), F.round(F.regr_intercept("v", "n"), 3).alias("intercept"))


@query("""
WITH n AS (SELECT l_orderkey AS id, l_shipmode AS item FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2), o AS (SELECT o_orderkey AS id, o_orderpriority AS cls FROM orders),
t AS (SELECT count(*) AS total FROM o), c AS (SELECT cls, count(*) AS nc FROM o GROUP BY cls), s AS (SELECT item, count(*) AS support FROM n JOIN o USING (id) GROUP BY item), b AS (SELECT item, cls, count(*) AS both_n FROM n JOIN o USING (id) GROUP BY item, cls)
SELECT item, cls, support, round(both_n / support / (nc / total), 6) AS lift FROM b JOIN s USING (item) JOIN c USING (cls), t WHERE support >= 5""")
def class_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("item")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cls"))
    both = items.join(orders, "id").groupBy("item", "cls").agg(F.count("*").alias("both")).withColumn("support", F.sum("both").over(Window.partitionBy("item")))
    share = orders.groupBy("cls").agg(F.count("*").alias("nc")).withColumn("share", F.col("nc") / F.sum("nc").over(Window.partitionBy()))  # a row a class
    return both.where("support >= 5").join(F.broadcast(share), "cls").select("item", "cls", "support", rounded(F.col("both") / F.col("support") / F.col("share")).alias("lift"))


@query(f"""
WITH {TRACES}, g AS (SELECT DISTINCT id, type || '>' || lead(type) OVER (PARTITION BY id ORDER BY pos) AS gram FROM ev), h AS (SELECT * FROM g WHERE gram IS NOT NULL), r AS (SELECT gram, row_number() OVER (ORDER BY count(*) DESC, gram) AS rk FROM h GROUP BY gram),
ks AS (SELECT unnest([1, 2, 5, 10, 20]) AS top_k), s AS (SELECT id, top_k, avg(CASE WHEN rk <= top_k THEN 1.0 ELSE 0.0 END) AS share FROM h JOIN r USING (gram), ks GROUP BY id, top_k) SELECT top_k, round(avg(share), 6) AS mean_share FROM s GROUP BY top_k""")
def reuse_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = S.adjacent_pairs(traces(spark, sf_dir), ["id"], "type").select("id", F.concat_ws(">", "a", "b").alias("gram")).distinct()
    ranked = have.groupBy("gram").agg(F.count("*").alias("df")).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("df"), "gram")))
    ks = (1, 2, 5, 10, 20)
    per = have.join(ranked, "gram").groupBy("id").agg(*[F.avg((F.col("rk") <= k).cast("double")).alias(str(k)) for k in ks])
    means = per.agg(*[F.avg(F.col(f"`{k}`")).alias(str(k)) for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("top_k"), rounded(F.col(f"`{k}`")).alias("mean_share")) for k in ks])).alias("s")).select("s.*")


@query(f"""
WITH {PAIRS}, r AS (SELECT agent, item, row_number() OVER (PARTITION BY agent ORDER BY n DESC, item) AS rk FROM c), t AS (SELECT * FROM r WHERE rk <= 10),
s AS (SELECT a.agent AS group_a, b.agent AS group_b, count(*) AS both_n FROM t a JOIN t b ON a.item = b.item AND a.agent < b.agent GROUP BY 1, 2) SELECT group_a, group_b, round(both_n / (20 - both_n), 6) AS jaccard FROM s""")
def top_vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = pair_items(spark, sf_dir).withColumn("rk", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "item"))).where("rk <= 10")
    a, b = (top.select(F.col("agent").alias(f"group_{s}"), "item") for s in "ab")
    return a.join(b, "item").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("both")).select("group_a", "group_b", rounded(F.col("both") / (20 - F.col("both"))).alias("jaccard"))


@query(f"""
WITH {PAIRS}, pos AS (SELECT agent, id, pair FROM (SELECT agent, id, type || '>' || lead(type) OVER (PARTITION BY id ORDER BY pos) AS pair FROM ev) WHERE pair IS NOT NULL), u AS (SELECT item, sum(n) / sum(sum(n)) OVER () AS q FROM c GROUP BY item)
SELECT id, round(avg(-log2(q)), 6) AS surprise FROM pos JOIN u ON u.item = pos.pair GROUP BY id""")
def motif_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.adjacent_pairs(traces(spark, sf_dir), ["id", "agent"], "type").select("id", F.concat_ws(">", "a", "b").alias("item"))
    q = A.with_total(pairs.groupBy("item").agg(F.count("*").alias("n")), "n", "total").select("item", (F.col("n") / F.col("total")).alias("q"))
    return pairs.join(q, "item").groupBy("id").agg(rounded(F.avg(-F.log2("q"))).alias("surprise"))


@query(f"""
WITH {TRACES}, g AS (SELECT id, type AS c, lag(type) OVER w AS b, lag(type, 2) OVER w AS a FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos)), t AS (SELECT * FROM g WHERE a IS NOT NULL), n AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY a, b, c), h AS (SELECT a, b, sum(n) AS h FROM n GROUP BY a, b), v AS (SELECT count(DISTINCT type) AS v FROM ev)
SELECT id, round(pow(2, avg(-log2((n + 0.5) / (h + 0.5 * v)))), 5) AS perplexity FROM t JOIN n USING (a, b, c) JOIN h USING (a, b), v GROUP BY id""")
def trigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos")
    rows = traces(spark, sf_dir)
    t = rows.select("id", F.col("type").alias("c"), F.lag("type").over(w).alias("b"), F.lag("type", 2).over(w).alias("a")).where("a IS NOT NULL")
    model = t.groupBy("a", "b", "c").agg(F.count("*").alias("n")).withColumn("h", F.sum("n").over(Window.partitionBy("a", "b"))).join(F.broadcast(rows.agg(F.countDistinct("type").alias("v"))))
    return t.join(model, ["a", "b", "c"]).groupBy("id").agg(F.round(F.pow(F.lit(2.0), F.avg(-F.log2((F.col("n") + 0.5) / (F.col("h") + 0.5 * F.col("v"))))), 5).alias("perplexity"))


@query(f"""
WITH {TRACES}, l AS (SELECT DISTINCT agent, k % 40 AS op FROM ev WHERE type = 'purchase'), need AS (SELECT DISTINCT id, agent, k % 40 AS op FROM ev WHERE type = 'error'), m AS (SELECT n.id, n.agent, count(*) AS ops, count(l.op) AS known FROM need n LEFT JOIN l ON l.agent = n.agent AND l.op = n.op GROUP BY n.id, n.agent)
SELECT agent, CASE WHEN known < ops THEN 'novel_primitive' ELSE 'novel_composition' END AS failure, count(*) AS n FROM m GROUP BY ALL""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).withColumn("op", F.pmod("k", F.lit(40)))
    library = rows.where("type = 'purchase'").select("agent", "op").distinct().withColumn("known", F.lit(1))
    need = rows.where("type = 'error'").select("id", "agent", "op").distinct().join(library, ["agent", "op"], "left")
    per = need.groupBy("id", "agent").agg(F.count("*").alias("ops"), F.count("known").alias("known"))
    return per.groupBy("agent", F.when(F.col("known") < F.col("ops"), "novel_primitive").otherwise("novel_composition").alias("failure")).agg(F.count("*").alias("n"))


@query(f"WITH {OUTCOME}, r AS (SELECT passed, rank() OVER (ORDER BY n_steps) + (count(*) OVER (PARTITION BY n_steps) - 1) / 2 AS rk FROM o), s AS (SELECT sum(CASE WHEN passed THEN rk END) AS s, count(*) FILTER (passed) AS p, count(*) FILTER (NOT passed) AS q FROM r) SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s")
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.auc(outcomes(spark, sf_dir), "n_steps", F.col("passed")).select(rounded(F.col("auc")).alias("auc"))


@query(f"WITH {OUTCOME}, r AS (SELECT agent, rank() OVER (ORDER BY n_steps) + (count(*) OVER (PARTITION BY n_steps) - 1) / 2 AS rk FROM o), g AS (SELECT agent, count(*) AS n, sum(rk) AS s FROM r GROUP BY agent) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, round(12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1), 5) AS h FROM g")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rank_sum(outcomes(spark, sf_dir), "n_steps", "agent").select("n", "groups", F.round("h", 5).alias("h"))


@query(f"WITH {TRACES}, b AS (SELECT *, ntile(3) OVER (ORDER BY value, event_id) AS tertile FROM ev) SELECT tertile, CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' ELSE '3+' END AS bucket, count(*) AS n, round(avg(CASE WHEN type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM b GROUP BY ALL")
def bucket_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ntile from global places: the first n % 3 tiles hold one row more
    rows = traces(spark, sf_dir)
    places = A.ranked_values(rows, "value", "event_id").drop("_n")
    size = rows.agg(F.count("*").alias("all_rows"))
    least, more = F.floor(F.col("all_rows") / 3), F.col("all_rows") % 3
    tile = F.when(F.col("_before") < more * (least + 1), F.floor(F.col("_before") / (least + 1))).otherwise(more + F.floor((F.col("_before") - more * (least + 1)) / F.greatest(least, F.lit(1)))) + 1
    rows = rows.join(places, ["value", "event_id"]).join(F.broadcast(size)).withColumn("tertile", tile)  # size is one row
    bucket = F.when(F.col("k") == 0, "0").when(F.col("k") <= 2, "1-2").otherwise("3+")
    return rows.groupBy("tertile", bucket.alias("bucket")).agg(F.count("*").alias("n"), rounded(F.avg((F.col("type") == "purchase").cast("double"))).alias("rate"))


@query()
def bootstrap_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces(spark, sf_dir).groupBy("id").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    ranked = A.average_ranks(A.average_ranks(c, "n", name="rn"), "v", name="rv")
    draws = A.bootstrap_draws(ranked, 200, "id").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return draws.groupBy("draw").agg(F.corr("rn", "rv").alias("rho")).agg(F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.5)).alias("middle"), F.percentile("rho", F.lit(0.975)).alias("high"))


@query()
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often shuffled outcomes differ in mean length by as much as the real ones: (at least as large + 1) / (n + 1)."""
    o = outcomes(spark, sf_dir)
    labels = A.shuffled_labels(o, "passed", "id", 199).join(o.select("id", "n_steps"), "id")
    gap = labels.groupBy("permutation").agg(F.abs(F.avg(F.when(F.col("passed"), F.col("n_steps"))) - F.avg(F.when(~F.col("passed"), F.col("n_steps")))).alias("gap"))
    real = gap.where("permutation = 0").select(F.col("gap").alias("observed"))
    return gap.where("permutation > 0").join(F.broadcast(real)).groupBy("observed").agg(F.count("*").alias("n"), ((F.count(F.when(F.col("gap") >= F.col("observed"), 1)) + 1) / (F.count("*") + 1)).alias("p"))


@query()
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy("agent", "k", "type").agg(F.count("*").alias("n"))
    a, b = (counts.where(F.col("agent") == g).select("k", "type", F.col("n").alias(f"n{g}")) for g in (0, 1))
    deltas = a.join(b, ["k", "type"]).select("type", (F.col("n0") - F.col("n1")).cast("double").alias("delta"))
    return A.benjamini_hochberg(A.wilcoxon_signed_rank(deltas, "type", "delta"), "p", "key")
