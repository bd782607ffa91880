"""Queries over ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import TRACES, query, rounded, table, traces


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)
SELECT conv_id, turn_no, count(*) AS n_events, CAST(sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_actions,
  max(CASE WHEN role = 'user' THEN left(text, 80) END) AS prompt
FROM t GROUP BY conv_id, turn_no""")
def turn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.split_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    user = F.col("role") == "user"
    return rows.groupBy("conv_id", "turn_no").agg(F.count("*").alias("n_events"), F.count(F.when(~user, 1)).alias("n_actions"), F.max(F.when(user, F.left("text", F.lit(80)))).alias("prompt"))


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
n AS (SELECT conv_id, turn_no, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) AS n FROM t WHERE turn_no > 0 GROUP BY conv_id, turn_no),
l AS (SELECT count(DISTINCT conv_id) AS traces, count(*) AS turns, list_sort(list(n)) AS v FROM n)
SELECT traces, turns, CAST(v[1] AS BIGINT) AS actions_min, CAST(v[len(v) // 2 + 1] AS BIGINT) AS actions_median, CAST(v[len(v)] AS BIGINT) AS actions_max FROM l""")
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = turn_split(spark, sf_dir).where("turn_no > 0")
    # the order statistic over counts of counts, not over all turns
    sizes = n.groupBy("n_actions").agg(F.count("*").alias("many"))
    upto = sizes.withColumns({"upto": F.sum("many").over(Window.orderBy("n_actions")), "total": F.sum("many").over(Window.partitionBy())})
    shape = upto.agg(F.min("n_actions").alias("actions_min"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n_actions"))).alias("actions_median"), F.max("n_actions").alias("actions_max"))
    return n.agg(F.countDistinct("conv_id").alias("traces"), F.count("*").alias("turns")).join(F.broadcast(shape))  # one row each


@query(f"""
WITH {TRACES}, c AS (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY id ORDER BY pos) = type THEN 0 ELSE 1 END AS ch FROM ev),
r AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY pos) AS run FROM c)
SELECT id, CAST(run AS BIGINT) AS run, type, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY id, run, type""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(traces(spark, sf_dir), "id", "type")


@query(f"""
WITH {TRACES}, c AS (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY pos) AS p FROM ev)
SELECT id, string_agg(type, ' ' ORDER BY pos) AS sequence FROM c WHERE p IS NULL OR p <> type GROUP BY id""")
def run_length_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequences(traces(spark, sf_dir), ["id"], "type").select("id", F.array_join(S.without_repeats(F.col("seq")), " ").alias("sequence"))


@query(f"""
WITH {TRACES}, e AS (SELECT id, min(pos) FILTER (atom = 'EDIT_SRC_PY') AS first_edit FROM ev GROUP BY id)
SELECT ev.id, count(*) AS n_events, min(ts) AS started, max(ts) AS ended,
  count(*) FILTER (atom = 'OPEN_SRC_PY' AND (first_edit IS NULL OR pos < first_edit)) AS reads_before_first_edit,
  count(*) FILTER (atom = 'RUN_PYTEST_TEST_PY') AS test_runs, count(DISTINCT atom) AS distinct_verbs,
  string_agg(atom, ' ' ORDER BY pos) AS skeleton
FROM ev JOIN e ON ev.id = e.id GROUP BY ev.id""")
def compiled_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("atom")
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = traces(spark, sf_dir).withColumn("edited", F.coalesce(F.max(a == "EDIT_SRC_PY").over(w), F.lit(False)))
    return rows.groupBy("id").agg(
        F.count("*").alias("n_events"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count(F.when((a == "OPEN_SRC_PY") & ~F.col("edited"), 1)).alias("reads_before_first_edit"),
        F.count(F.when(a == "RUN_PYTEST_TEST_PY", 1)).alias("test_runs"),
        F.countDistinct("atom").alias("distinct_verbs"),
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "atom")))["atom"], " ").alias("skeleton"),
    )


@query(f"""
WITH {TRACES}, c AS (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY pos) AS p FROM ev)
SELECT id, count(*) AS n_steps, count(*) FILTER (type = 'purchase') AS n_edits, count(*) FILTER (type = 'click') AS n_searches, count(*) FILTER (type = 'view') AS n_opens,
  count(*) FILTER (type = 'purchase' AND p = 'purchase') AS edit_retries,
  round(count(*) FILTER (type = 'purchase' AND p = 'purchase') / greatest(count(*) FILTER (type = 'purchase'), 1), 6) AS edit_retry_rate,
  count(*) FILTER (type = 'error') > 0 AS submitted
FROM c GROUP BY id""")
def trajectory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("type"), lambda c: F.count(F.when(c, 1))
    rows = traces(spark, sf_dir).withColumn("p", F.lag("type").over(Window.partitionBy("id").orderBy("pos")))
    retry = (t == "purchase") & (F.col("p") == "purchase")
    return rows.groupBy("id").agg(
        F.count("*").alias("n_steps"),
        n(t == "purchase").alias("n_edits"),
        n(t == "click").alias("n_searches"),
        n(t == "view").alias("n_opens"),
        n(retry).alias("edit_retries"),
        rounded(n(retry) / F.greatest(n(t == "purchase"), F.lit(1))).alias("edit_retry_rate"),
        (n(t == "error") > 0).alias("submitted"),
    )


PHASED = f"""{TRACES}, f AS (SELECT *, coalesce(max(CASE WHEN atom LIKE 'OPEN!_%' ESCAPE '!' THEN 1 ELSE 0 END) OVER w, 0) AS so, coalesce(max(CASE WHEN atom LIKE 'EDIT!_%' ESCAPE '!' THEN 1 ELSE 0 END) OVER w, 0) AS se
  FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ph AS (SELECT *, CASE atom WHEN 'SUBMIT' THEN 'cleanup_submit' WHEN 'RUN_PYTEST_TEST_PY' THEN 'verification' WHEN 'EDIT_SRC_PY' THEN 'editing'
  WHEN 'OPEN_SRC_PY' THEN CASE WHEN se = 1 THEN 'editing' ELSE 'localization' END
  WHEN 'SEARCH' THEN CASE WHEN se = 1 THEN 'editing' WHEN so = 1 THEN 'localization' ELSE 'exploration' END END AS phase FROM f)"""


@query(f"""
WITH {PHASED}, c AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY id ORDER BY pos) = phase THEN 0 ELSE 1 END AS ch FROM ph),
r AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY pos) AS seg FROM c)
SELECT id, CAST(seg AS BIGINT) AS segment, phase, min(pos) - 1 AS start_at, max(pos) AS end_at FROM r GROUP BY id, seg, phase""")
def phase_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.runs(S.with_phases(traces(spark, sf_dir), "id"), "id", "phase")
    return rows.select("id", F.col("run").alias("segment"), "phase", (F.col("first_pos") - 1).cast("long").alias("start_at"), (F.col("first_pos") + F.col("n") - 1).cast("long").alias("end_at"))


@query(f"WITH {PHASED} SELECT id, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases FROM ph GROUP BY id")
def phase_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_phases(traces(spark, sf_dir), "id").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("phase")), ",").alias("phases"))


@query(f"""
WITH {TRACES}, l AS (SELECT *, max(CASE WHEN atom = 'OPEN_SRC_PY' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS a FROM ev),
c AS (SELECT id, count(*) AS n_atoms, CAST(sum(a) AS BIGINT) AS postloc_steps, count(*) FILTER (a = 1 AND atom = 'EDIT_SRC_PY') AS e, count(*) FILTER (a = 1 AND atom = 'SUBMIT') AS s FROM l GROUP BY id),
d AS (SELECT *, postloc_steps >= 14 AND e / greatest(postloc_steps, 1) >= 0.3 AND s / greatest(postloc_steps, 1) <= 0.05 AS stuck FROM c)
SELECT id, n_atoms, postloc_steps, round(e / greatest(postloc_steps, 1), 4) AS edit_src_share, round(s / greatest(postloc_steps, 1), 4) AS submit_share, CAST(stuck AS INTEGER) AS flag_stuck_edit_loop,
  CASE WHEN postloc_steps = 0 THEN 'no-localization' WHEN stuck THEN 'stuck-edit-loop' WHEN postloc_steps < 14 THEN 'short-trajectory' ELSE 'normal' END AS verdict FROM d""")
def stuck_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stuck_loop(traces(spark, sf_dir), "id", F.col("atom") == "OPEN_SRC_PY")


@query(f"""
WITH {TRACES}, w AS (SELECT *, count(*) FILTER (type = 'purchase') OVER last8 / count(*) OVER last8 AS share, count(*) FILTER (type = 'signup') OVER upto AS tests, max(CASE WHEN type <> 'purchase' THEN pos ELSE 0 END) OVER upto AS other
  FROM ev WINDOW last8 AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), upto AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, pos, share > 0.6 AND tests = 0 AS edit_flood, pos - other >= 4 AS stuck_edit FROM w WHERE pos >= 5 AND (share > 0.6 AND tests = 0 OR pos - other >= 4)""")
def path_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, t = Window.partitionBy("id").orderBy("pos"), F.col("type")
    last8, upto = base.rowsBetween(-7, 0), base.rowsBetween(Window.unboundedPreceding, 0)
    rows = traces(spark, sf_dir).withColumns({
        "share": F.count(F.when(t == "purchase", 1)).over(last8) / F.count("*").over(last8),
        "tests": F.count(F.when(t == "signup", 1)).over(upto),
        "other": F.max(F.when(t != "purchase", F.col("pos")).otherwise(0)).over(upto),
    })
    flood, stuck = (F.col("share") > 0.6) & (F.col("tests") == 0), F.col("pos") - F.col("other") >= 4
    return rows.where((F.col("pos") >= 5) & (flood | stuck)).select("id", F.col("pos").cast("long").alias("pos"), flood.alias("edit_flood"), stuck.alias("stuck_edit"))


@query(f"""
WITH {TRACES}, p AS (SELECT id, min(pos) FILTER (type = 'error') AS sub, min(pos) FILTER (type = 'purchase') AS edit, min(pos) FILTER (type = 'signup') AS test, min(pos) FILTER (type IN ('click', 'view')) AS look FROM ev GROUP BY id),
e AS (SELECT id, pos, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS last FROM ev WHERE type = 'purchase'),
r AS (SELECT id, count(*) AS n, count(*) FILTER (last = pos - 1) AS again FROM e GROUP BY id)
SELECT p.id, coalesce(test < coalesce(sub, 1000000000), false) AS test_before_submit, edit IS NULL OR coalesce(look < edit, false) AS search_before_edit, sub IS NULL AS no_exit_error, coalesce(n < 2 OR again / n < 0.5, true) AS low_edit_retry
FROM p LEFT JOIN r ON p.id = r.id""")
def ordering_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pos = F.col("type"), F.col("pos")
    rows = traces(spark, sf_dir).withColumn("p", F.lag("type").over(Window.partitionBy("id").orderBy("pos")))
    first = lambda c: F.min(F.when(c, pos))
    edits = F.count(F.when(t == "purchase", 1))
    again = F.count(F.when((t == "purchase") & (F.col("p") == "purchase"), 1))
    agg = rows.groupBy("id").agg(first(t == "error").alias("sub"), first(t == "purchase").alias("edit"), first(t == "signup").alias("test"), first(t.isin("click", "view")).alias("look"), edits.alias("n"), again.alias("again"))
    return agg.select(
        "id",
        F.coalesce(F.col("test") < F.coalesce("sub", F.lit(1_000_000_000)), F.lit(False)).alias("test_before_submit"),
        (F.col("edit").isNull() | F.coalesce(F.col("look") < F.col("edit"), F.lit(False))).alias("search_before_edit"),
        F.col("sub").isNull().alias("no_exit_error"),
        ((F.col("n") < 2) | (F.try_divide("again", "n") < 0.5)).alias("low_edit_retry"),
    )


RULES = {"search_then_edit": ("SEARCH .*EDIT_SRC_PY ", True), "submit_twice": ("SUBMIT SUBMIT ", False), "test_after_edit": ("EDIT_SRC_PY .*RUN_PYTEST_TEST_PY ", True)}


@query(f"WITH {TRACES}, s AS (SELECT id, agent, string_agg(atom, ' ' ORDER BY pos) || ' ' AS s FROM ev GROUP BY id, agent), r AS (" + " UNION ALL ".join(f"SELECT agent, '{k}' AS rule, regexp_matches(s, '{p}') = {m} AS ok FROM s" for k, (p, m) in RULES.items()) + ") SELECT agent, rule, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM r GROUP BY agent, rule")
def sequence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = S.sequences(traces(spark, sf_dir), ["id", "agent"], "atom").withColumn("s", F.concat(F.array_join("seq", " "), F.lit(" ")))
    held = F.array(*[F.struct(F.lit(k).alias("rule"), (F.col("s").rlike(p) == m).alias("ok")) for k, (p, m) in RULES.items()])
    return seqs.select("agent", F.explode(held).alias("r")).groupBy("agent", "r.rule").agg(rounded(F.avg(F.col("r.ok").cast("double"))).alias("share"), F.count("*").alias("n"))


@query(f"""
WITH {TRACES}, o AS (SELECT id, arg_max(type, pos) = 'purchase' AS passed FROM ev GROUP BY id), f AS (SELECT ev.id, passed, atom, count(*) / sum(count(*)) OVER (PARTITION BY ev.id) AS share FROM ev JOIN o ON ev.id = o.id GROUP BY ev.id, passed, atom),
n AS (SELECT passed, count(*) AS m FROM o GROUP BY passed)
SELECT f.passed, atom AS stage, round(sum(share) / any_value(m), 6) AS mean_share FROM f JOIN n ON f.passed = n.passed GROUP BY f.passed, atom""")
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    outcome = rows.groupBy("id").agg((F.max_by("type", "pos") == "purchase").alias("passed"))
    shares = rows.groupBy("id", "atom").count().withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("id"))).join(outcome, "id")
    many = outcome.groupBy("passed").agg(F.count("*").alias("m"))
    return shares.groupBy("passed", F.col("atom").alias("stage")).agg(F.sum("share").alias("s")).join(F.broadcast(many), "passed").select("passed", "stage", rounded(F.col("s") / F.col("m")).alias("mean_share"))


@query(f"""
WITH {TRACES}, f AS (SELECT *, last_value(CASE WHEN type IN ('view', 'click') THEN k END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS current_file FROM ev)
SELECT id, current_file, count(*) AS edits FROM f WHERE type = 'purchase' AND current_file IS NOT NULL GROUP BY id, current_file""")
def forward_filled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.forward_fill(traces(spark, sf_dir), "id", F.when(F.col("type").isin("view", "click"), F.col("k")), name="current_file")
    return rows.where("type = 'purchase' AND current_file IS NOT NULL").groupBy("id", "current_file").agg(F.count("*").alias("edits"))


@query(f"""
WITH {TRACES}, g AS (SELECT DISTINCT id, k FROM ev WHERE type = 'purchase')
SELECT t.id, min(t.pos) AS first_step, max(n) AS n_steps FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ev) t SEMI JOIN g ON t.id = g.id AND t.k = g.k GROUP BY t.id""")
def first_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    gold = rows.where("type = 'purchase'").select("id", "k").distinct()
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    return sized.join(gold, ["id", "k"], "left_semi").groupBy("id").agg(F.min("pos").cast("long").alias("first_step"), F.max("n").alias("n_steps"))


@query(f"""
WITH {TRACES}, c AS (SELECT id, k, count(*) AS c FROM ev WHERE type = 'purchase' GROUP BY id, k), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, k) AS i, count(*) OVER (PARTITION BY id) AS n FROM c)
SELECT id, max(n) AS files_edited, round(CASE WHEN max(n) = 1 THEN 1.0 ELSE sum((2 * i - n - 1) * c) / (max(n) * sum(c)) END, 6) AS gini FROM r GROUP BY id""")
def edit_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.statistics import gini

    return gini(traces(spark, sf_dir).where("type = 'purchase'").groupBy("id", "k").agg(F.count("*").alias("c")), ["id"], "c", "k").select("id", F.col("n").alias("files_edited"), rounded(F.col("gini")).alias("gini"))


@query(f"""
WITH {TRACES}, t AS (SELECT id, pos, k AS item, epoch(ts) AS at FROM ev WHERE type IN ('view', 'purchase')),
l AS (SELECT a.id, a.pos, a.item AS x, arg_min(b.item, b.pos) AS y FROM t a JOIN t b ON a.id = b.id AND b.pos > a.pos AND b.item <> a.item AND b.at - a.at BETWEEN 0 AND 86400 GROUP BY a.id, a.pos, a.item)
SELECT id, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM l GROUP BY ALL""")
def co_touch_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).where("type IN ('view', 'purchase')")
    return S.touches_within(rows, "id", "k", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 86400)


@query(f"WITH {TRACES}, p AS (SELECT agent, atom AS a, lead(atom) OVER (PARTITION BY id ORDER BY pos) AS b FROM ev) SELECT agent, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY agent, a, b")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_pairs(traces(spark, sf_dir), ["id", "agent"], "atom").groupBy("agent", "a", "b").agg(F.count("*").alias("n"))


GRAMS = f"{TRACES}, g AS (SELECT id, agent, atom || '>' || lead(atom) OVER w || '>' || lead(atom, 2) OVER w AS gram FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos)), g3 AS (SELECT * FROM g WHERE gram IS NOT NULL)"


def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, gram: the n-grams of each trace, by windows rather than arrays."""
    w = Window.partitionBy("id").orderBy("pos")
    gram = F.concat_ws(">", "atom", F.lead("atom").over(w), F.lead("atom", 2).over(w))
    return traces(spark, sf_dir).select("id", "agent", F.when(F.lead("atom", 2).over(w).isNotNull(), gram).alias("gram")).where("gram IS NOT NULL")


@query(f"WITH {GRAMS} SELECT gram, count(*) AS n, count(DISTINCT id) AS support FROM g3 GROUP BY gram")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("id").alias("support"))


@query(f"WITH {GRAMS} SELECT id, gram, count(*) AS n FROM g3 GROUP BY id, gram HAVING count(*) >= 2")
def repeated_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams(spark, sf_dir).groupBy("id", "gram").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""
WITH {GRAMS}, d AS (SELECT gram, count(DISTINCT id) AS df FROM g3 GROUP BY gram), n AS (SELECT count(DISTINCT id) AS n FROM ev)
SELECT DISTINCT g3.id, g3.gram, round(ln(n.n / d.df), 6) AS weight FROM g3 JOIN d ON g3.gram = d.gram, n WHERE d.df < n.n""")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = trigrams(spark, sf_dir).select("id", "gram").distinct()
    df = have.groupBy("gram").agg(F.count("*").alias("df"))
    n = traces(spark, sf_dir).agg(F.countDistinct("id").alias("n"))
    return have.join(df, "gram").join(F.broadcast(n), F.col("df") < F.col("n")).select("id", "gram", rounded(F.log(F.col("n") / F.col("df"))).alias("weight"))


@query(f"""
WITH {TRACES}, w AS (SELECT id, agent, atom, lead(atom) OVER w AS b, lead(atom, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT id, count(*) AS n, count(DISTINCT atom) AS d FROM ev GROUP BY id), h AS (SELECT id, atom FROM ev GROUP BY id, atom HAVING count(*) >= 5)
SELECT DISTINCT id, 'cycle:' || atom || '-' || b || '-' || c AS motif FROM w WHERE atom = c AND atom <> b
UNION ALL SELECT id, 'hotspot:' || atom FROM h UNION ALL SELECT id, 'diverse' FROM n WHERE d / n > 0.7""")
def structural_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir)
    w = Window.partitionBy("id").orderBy("pos")
    three = rows.select("id", "atom", F.lead("atom").over(w).alias("b"), F.lead("atom", 2).over(w).alias("c"))
    cycles = three.where("atom = c AND atom <> b").select("id", F.concat(F.lit("cycle:"), F.concat_ws("-", "atom", "b", "c")).alias("motif")).distinct()
    hot = rows.groupBy("id", "atom").count().where("count >= 5").select("id", F.concat(F.lit("hotspot:"), "atom").alias("motif"))
    mixed = rows.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("atom").alias("d")).where("d / n > 0.7").select("id", F.lit("diverse").alias("motif"))
    return cycles.unionByName(hot).unionByName(mixed)


@query(f"WITH {TRACES}, p AS (SELECT id, pos, atom || '_' || lead(atom) OVER (PARTITION BY id ORDER BY pos) AS m FROM ev), f AS (SELECT id, m, min(pos) AS p FROM p WHERE m IS NOT NULL AND pos <= 100 GROUP BY id, m) SELECT id, 'M_' || left(sha1(m), 10) AS motif_id, m AS motif FROM f")
def hashed_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = S.sequences(traces(spark, sf_dir), ["id"], "atom")
    grams = F.array_distinct(F.slice(S.ngrams(F.col("seq"), 2, "_"), 1, 100))
    return seqs.select("id", F.explode(grams).alias("motif")).select("id", F.concat(F.lit("M_"), F.left(F.sha1("motif"), F.lit(10))).alias("motif_id"), "motif")


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.motifs import train_bpe

    model, _ = train_bpe(S.sequences(traces(spark, sf_dir), ["id", "agent"], "atom"), target_size=25)
    return spark.createDataFrame([(k, a, b, new, n) for k, (a, b, new, n) in enumerate(model.merges)], "rank int, left_token string, right_token string, token string, pair_count long")


@query()
def bpe_mdl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.motifs import mdl_sweep

    return mdl_sweep(S.sequences(traces(spark, sf_dir), ["id", "agent"], "atom"), sizes=[8, 12, 16, 20])


@query()
def corpus_prefixspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.motifs import prefixspan

    return prefixspan(S.sequences(traces(spark, sf_dir), ["id"], "atom"), 0.6, 4)


ITEMSETS = f"{TRACES}, c AS (SELECT DISTINCT id, k % 9 AS op FROM ev WHERE type = 'error')"


@query(f"""
WITH RECURSIVE {ITEMSETS}, t AS (SELECT id, list_sort(list(op)) AS ops FROM c GROUP BY id), m AS (SELECT ceil(0.15 * count(*)) AS m FROM t),
ops AS (SELECT DISTINCT op FROM c), s(items) AS (SELECT [op] FROM ops UNION ALL SELECT list_append(items, op) FROM s, ops WHERE op > items[len(items)]),
f AS (SELECT items, count(*) AS freq FROM s JOIN t ON list_has_all(t.ops, s.items) GROUP BY items HAVING count(*) >= (SELECT m FROM m))
SELECT array_to_string(items, ',') AS items, freq FROM f WHERE len(items) >= 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE len(g.items) > len(f.items) AND g.freq = f.freq AND list_has_all(g.items, f.items))""")
def closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.motifs import closed_itemsets as mine

    certs = traces(spark, sf_dir).where("type = 'error'").groupBy("id").agg(F.collect_set(F.pmod("k", F.lit(9))).alias("ops"))
    return mine(certs, "ops", 0.15).select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "freq")
