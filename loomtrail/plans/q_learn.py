"""Queries over weighted words and learned forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import weights as W
from .q_statistics import outcomes
from .registry import TRACES, query, rounded, table, traces

WORD = "[a-z0-9]+"
UPTAKE = f"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM conversations), tf AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT count(*) AS docs FROM (SELECT DISTINCT conv_id, turn FROM tf)), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
x AS (SELECT conv_id, turn, w, n * (ln((1 + docs) / (1 + df)) + 1) AS v FROM tf JOIN df USING (w), s), l AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM x GROUP BY ALL)"""


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (conversation and turn), item, n."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    words = c.select(F.struct("conv_id", "turn").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("item"))
    return words.groupBy("id", "item").agg(F.count("*").alias("n"))


@query(f"""{UPTAKE}, d AS (SELECT a.conv_id, a.turn, sum(a.v * b.v) AS dot FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(dot, 0) / (p.norm * q.norm), 6) AS uptake FROM l p JOIN l q ON p.conv_id = q.conv_id AND q.turn = p.turn + 1 LEFT JOIN d ON d.conv_id = p.conv_id AND d.turn = p.turn""")
def observation_uptake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a turn's weighted words the next turn takes up."""
    x = W.tf_idf(turn_words(spark, sf_dir), "id", "item")
    pairs = x.select("id").distinct().select(F.col("id").alias("a"), F.struct(F.col("id.conv_id").alias("conv_id"), (F.col("id.turn") + 1).alias("turn")).alias("b"))
    return W.cosines(x, pairs, "id", "item").select("a.conv_id", "a.turn", rounded(F.col("cosine")).alias("uptake"))


@query(f"WITH {TRACES}, n AS (SELECT atom, count(*) AS n, count(DISTINCT id) AS traces FROM ev GROUP BY atom) SELECT atom AS item, n, traces, round(n / sum(n) OVER (), 6) AS share FROM n ORDER BY n DESC, atom LIMIT 20")
def vocabulary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent items, with their share of all."""
    return W.vocabulary(traces(spark, sf_dir), "id", "atom", 20).withColumn("share", rounded(F.col("share")))


@query()
def decision_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a decision tree over counts of event types: rows and pass rate of each."""
    counts = traces(spark, sf_dir).groupBy("id").pivot("type", ["click", "view", "signup", "error"]).count().fillna(0)
    rows = counts.join(outcomes(spark, sf_dir).select("id", "passed"), "id")
    return W.tree_forms(rows, ["click", "view", "signup", "error"], "passed", 3)


@query()
def transfer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each agent's traces predicted by a model of the other agents' ones."""
    counts = traces(spark, sf_dir).groupBy("id", "agent").pivot("type", ["click", "view", "signup", "error"]).count().fillna(0)
    rows = counts.join(outcomes(spark, sf_dir).select("id", "passed"), "id")
    return W.leave_group_out(rows, ["click", "view", "signup", "error"], "passed", "agent")


def _outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy("id", "agent").pivot("type", ["click", "view", "signup", "error"]).count().fillna(0)
    return counts.join(outcomes(spark, sf_dir).select("id", F.col("passed").cast("int").alias("passed")), "id")


@query()
def success_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether counts of event types tell the outcome of a session."""
    return W.cross_validated(_outcome_counts(spark, sf_dir), ["click", "view", "signup", "error"], "passed", "id")


@query()
def arm_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether counts of event types tell which of two agents a session comes from."""
    rows = _outcome_counts(spark, sf_dir).where("agent < 2")
    return W.cross_validated(rows, ["click", "view", "signup", "error"], "agent", "id")


@query()
def ablation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes without the one and the two event types that weigh most."""
    return W.ablation(_outcome_counts(spark, sf_dir), ["click", "view", "signup", "error"], "passed", "id", [0, 1, 2])
