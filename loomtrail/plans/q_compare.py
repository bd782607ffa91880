"""Queries over comparisons of records and groups, patterns of sessions, and searches of many parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..operators import blocks as B
from ..operators import comparisons as C
from ..operators import distances as D
from ..operators import patterns as P
from ..operators import sequences as S
from .q_distances import EVERY, VECTORS, letters, unit_vectors, vectors
from .q_statistics import pair_shares
from .registry import TRACES, half_up, query, rounded, table, traces

SETS = f"""{TRACES}, r AS (SELECT id, string_agg(left(type, 1), '' ORDER BY pos) AS tokens, list_sort(list(DISTINCT k % 12) FILTER (type = 'purchase')) AS edits, list_sort(list(DISTINCT k % 7) FILTER (type = 'view')) AS scopes, list_sort(list(DISTINCT k % 5) FILTER (type = 'error')) AS modules FROM ev GROUP BY id),
z AS (SELECT id, tokens, coalesce(edits, []) AS edits, coalesce(scopes, []) AS scopes, coalesce(modules, []) AS modules FROM r),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.tokens AS ta, b.tokens AS tb, a.edits AS ea, b.edits AS eb, a.scopes AS sa, b.scopes AS sb, a.modules AS ma, b.modules AS mb FROM z a JOIN z b ON a.id % 20 = 0 AND a.id <> b.id),
l AS (SELECT *, levenshtein(ta, tb) / greatest(length(ta), length(tb)) AS d_tokens,
  CASE WHEN len(ea) + len(eb) > 0 THEN (len(ea) + len(eb) - 2 * len(list_intersect(ea, eb))) / (len(ea) + len(eb)) END AS d_edits,
  CASE WHEN len(sa) + len(sb) > 0 THEN 1 - len(list_intersect(sa, sb)) / (len(sa) + len(sb) - len(list_intersect(sa, sb))) END AS d_scopes,
  CASE WHEN len(ma) + len(mb) > 0 THEN 1 - len(list_intersect(ma, mb)) / (len(ma) + len(mb) - len(list_intersect(ma, mb))) END AS d_modules FROM p)"""


def trace_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tokens, edits, scopes, modules of each trace."""
    rows = traces(spark, sf_dir)
    of = lambda t, m: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.pmod("k", F.lit(m)).cast("string"))))
    sets = rows.groupBy("id").agg(of("purchase", 12).alias("edits"), of("view", 7).alias("scopes"), of("error", 5).alias("modules"))
    return letters(rows).withColumnRenamed("seq", "tokens").join(sets, "id")


def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stated_levels(trace_sets(spark, sf_dir), "id", EVERY)


@query(f"WITH {SETS} SELECT id_a, id_b, round(d_tokens, 6) AS tokens, round(d_edits, 6) AS edits, round(d_scopes, 6) AS scopes, round(d_modules, 6) AS modules FROM l")
def level_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_pairs(spark, sf_dir).select("id_a", "id_b", *[half_up(F.col(f"d_{n}")).alias(n) for n in C.LEVELS])


@query(f"""WITH {SETS} SELECT id_a, id_b, round((coalesce(d_tokens * 0.5, 0) + coalesce(d_edits * 0.3, 0) + coalesce(d_scopes * 0.2, 0)) / nullif(CASE WHEN d_tokens IS NULL THEN 0 ELSE 0.5 END + CASE WHEN d_edits IS NULL THEN 0 ELSE 0.3 END + CASE WHEN d_scopes IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS weighted,
round((coalesce(d_tokens, 0) + coalesce(d_edits, 0) + coalesce(d_scopes, 0) + coalesce(d_modules, 0)) / nullif(CAST(d_tokens IS NOT NULL AS INT) + CAST(d_edits IS NOT NULL AS INT) + CAST(d_scopes IS NOT NULL AS INT) + CAST(d_modules IS NOT NULL AS INT), 0), 6) AS plain FROM l""")
def level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {n: F.col(f"d_{n}") for n in C.LEVELS}
    weighted = C.weighted_mean(values, {"tokens": 0.5, "edits": 0.3, "scopes": 0.2})
    return level_pairs(spark, sf_dir).select("id_a", "id_b", half_up(weighted).alias("weighted"), half_up(C.weighted_mean(values)).alias("plain"))


@query(f"""WITH {SETS} SELECT id_a, id_b, len(list_intersect(ma, mb)) > 0 AS file_match, round(coalesce(len(list_intersect(sa, sb)) / nullif(len(sa) + len(sb) - len(list_intersect(sa, sb)), 0), 0), 6) AS scope_jaccard,
round(coalesce(len(list_intersect(ea, eb)) / nullif(len(ea) + len(eb) - len(list_intersect(ea, eb)), 0), 0), 6) AS edit_jaccard, CAST(len(list_intersect(sa, sb)) AS INTEGER) AS scope_overlap FROM l""")
def layered_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.stated_pairs(trace_sets(spark, sf_dir), "id", ["edits", "scopes", "modules"], EVERY)
    s = C.layered_similarity(*map(F.col, ("modules_a", "modules_b", "scopes_a", "scopes_b", "edits_a", "edits_b")))
    return p.withColumn("s", s).select("id_a", "id_b", "s.file_match", rounded(F.col("s.scope_jaccard")).alias("scope_jaccard"), rounded(F.col("s.edit_jaccard")).alias("edit_jaccard"), "s.scope_overlap")


@query(f"""WITH {TRACES}, c AS (SELECT id, type, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id), d AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.type = b.type AND a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL)
SELECT x.id AS id_a, y.id AS id_b, round(1 - coalesce(dot, 0) / (x.norm * y.norm), 6) AS distance FROM s x JOIN s y ON x.id % 20 = 0 AND x.id <> y.id LEFT JOIN d ON d.id_a = x.id AND d.id_b = y.id""")
def soft_motif_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces(spark, sf_dir).groupBy("id", "type").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("m"))
    return D.stated_pairs(maps, "id", ["m"], EVERY).select("id_a", "id_b", rounded(C.soft_distance(F.col("m_a"), F.col("m_b"))).alias("distance"))


@query(f"""WITH {VECTORS}, p AS (SELECT i, avg(abs(d - c)) AS m FROM (SELECT q.i, q.j, q.d, c.c FROM (SELECT i, j, d FROM d UNION ALL SELECT i, i, 0 FROM v) q JOIN (SELECT j, avg(d) AS c FROM (SELECT i, j, d, li FROM d UNION ALL SELECT i, i, 0, label FROM v) WHERE li >= 5 GROUP BY j) c USING (j) WHERE q.i % 20 = 0) GROUP BY i)
SELECT i, round(m, 6) AS distance FROM p""")
def passed_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a query's distances to all rows lie, on average, from the mean distances of the passed side."""
    unit = unit_vectors(spark, sf_dir)
    passed = B.label_sums(unit.withColumn("label", F.col("label") >= 5).where("label")).select("n", "s").first()  # one row
    v = vectors(spark, sf_dir)
    means = [x / passed["n"] for x in passed["s"]] if passed else []
    return B.profile_distances(v.where(F.pmod("id", F.lit(EVERY)) == 0), v, means).select("i", rounded(F.col("distance")).alias("distance"))


@query(f"""WITH {VECTORS}, q AS (SELECT i, j, round(d, 6) AS x, CAST(abs(li - lj) AS DOUBLE) AS y FROM d WHERE i % 20 = 0), r AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY i ORDER BY y) + (count(*) OVER (PARTITION BY i, y) - 1) / 2 AS ry FROM q)
SELECT i, round(corr(rx, ry), 5) AS rho FROM r GROUP BY i""")
def profile_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = D.stated_pairs(unit_vectors(spark, sf_dir), "id", ["label", "v"], EVERY)
    both = pairs.select(F.col("id_a").alias("i"), F.round(1 - D.dot(F.col("v_a"), F.col("v_b")), 6).alias("x"), F.abs(F.col("label_a") - F.col("label_b")).cast("double").alias("y"))
    return C.profile_correlations(both, "i", "x", "y").select("i", F.round("rho", 5).alias("rho"))


@query(f"""WITH {TRACES}, pr AS (SELECT agent, type || '>' || lead(type) OVER (PARTITION BY id ORDER BY pos) AS item FROM ev), c AS (SELECT agent, item, count(*) AS n FROM pr WHERE item IS NOT NULL GROUP BY agent, item), d AS (SELECT agent, item, n / sum(n) OVER (PARTITION BY agent) AS p FROM c),
v AS (SELECT DISTINCT item FROM d), g AS (SELECT DISTINCT agent FROM d), f AS (SELECT g.agent, v.item, coalesce(d.p, 0) AS p FROM g CROSS JOIN v LEFT JOIN d ON d.agent = g.agent AND d.item = v.item),
j AS (SELECT a.agent AS x, b.agent AS y, sum(CASE WHEN a.p > 0 THEN a.p / 2 * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p / 2 * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) AS jsd FROM f a JOIN f b ON a.item = b.item AND a.agent < b.agent GROUP BY ALL)
SELECT round(avg(jsd) FILTER (x // 2 <> y // 2) - avg(jsd) FILTER (x // 2 = y // 2), 6) AS gap FROM j""")
def family_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of agents: 0 and 1, 2 and 3."""
    from ..operators.statistics import jsd_matrix

    shares = pair_shares(spark, sf_dir)
    families = shares.select(F.col("agent").alias("group"), F.floor(F.col("agent") / 2).alias("family")).distinct()
    return C.family_gap(jsd_matrix(shares, "agent", "item"), families).select(rounded(F.col("gap")).alias("gap"))


def _type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("agent", "id", "type").agg(F.count("*").alias("n"))


@query()
def split_half_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_half_noise(_type_counts(spark, sf_dir), "agent", "id", "type", 20)


@query()
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_arms(_type_counts(spark, sf_dir), "agent", "id", "type", 20, 2.0)


@query()
def bootstrap_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bootstrap_rand_index(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", "source", "lang", 50)


@query()
def alignment_against_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents' neighbours by id (i and i + 1 as a pair) are more alike than chance."""
    v = vectors(spark, sf_dir)
    pairs = v.select("id", F.col("v").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id")
    return C.alignment_against_shuffled(pairs, "id", "a", "b", 99)


@query(f"""WITH {TRACES}, m AS (SELECT k, bit_or(1 << CAST(agent AS INTEGER)) AS mask FROM ev WHERE type = 'purchase' GROUP BY k), s AS (SELECT unnest(range(1, 16)) AS chosen), u AS (SELECT bit_count(CAST(chosen AS INTEGER)) AS agents, chosen, (SELECT count(*) FROM m WHERE m.mask & chosen <> 0) AS solved FROM s)
SELECT CAST(agents AS INTEGER) AS agents, round(avg(solved), 6) AS mean_solved, round(stddev_pop(solved), 6) AS std_solved FROM u GROUP BY agents""")
def accumulation_by_orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = traces(spark, sf_dir).where("type = 'purchase'").select("agent", "k").distinct()
    return C.accumulation_by_orderings(solved, "agent", "k").select("agents", rounded(F.col("mean_solved")).alias("mean_solved"), rounded(F.col("std_solved")).alias("std_solved"))


@query(f"""WITH {TRACES}, f AS (SELECT id, pos, CASE WHEN type <> 'error' THEN k % 4 END AS file FROM ev), n AS (SELECT id, pos, file, lag(file) OVER (PARTITION BY id ORDER BY pos) AS last FROM f WHERE file IS NOT NULL), h AS (SELECT id, max(c) AS most FROM (SELECT id, file, count(*) AS c FROM n GROUP BY ALL) GROUP BY id), s AS (SELECT id, count(*) FILTER (last <> file) AS switches FROM n GROUP BY id), e AS (SELECT id, count(*) AS events FROM ev GROUP BY id)
SELECT e.id, array_to_string(list_filter([CASE WHEN most > 5 THEN 'HOTSPOT_' || most END, CASE WHEN switches > 3 THEN 'DEPENDENCY_CHASE' END], lambda x: x IS NOT NULL AND events >= 2), ',') AS motifs FROM e LEFT JOIN h USING (id) LEFT JOIN s USING (id)""")
def file_switch_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).withColumn("file", F.when(F.col("type") != "error", F.pmod("k", F.lit(4)).cast("string")))
    return P.file_switch_motifs(rows, "id", "pos", "file").select("id", F.array_join("motifs", ",").alias("motifs"))


@query(f"""WITH {TRACES}, x AS (SELECT id, pos, CASE WHEN type = 'signup' THEN 'INTENT_' || upper(atom[1:4]) ELSE type END AS item FROM ev), n AS (SELECT *, lead(item) OVER w AS a, lead(item, 2) OVER w AS b FROM x WINDOW w AS (PARTITION BY id ORDER BY pos)), i AS (SELECT * FROM n WHERE item LIKE 'INTENT_%'), t AS (SELECT id, item, lead(item) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM i)
SELECT id, motif, count(*) AS n FROM (SELECT id, item || '_TO_' || a AS motif FROM i WHERE a IS NOT NULL UNION ALL SELECT id, 'INTENT_PATTERN_' || item || '_' || a || '_' || b FROM i WHERE b IS NOT NULL UNION ALL SELECT id, 'INTENT_TYPE_' || replace(item, 'INTENT_', '') FROM i UNION ALL SELECT id, 'INTENT_TRANS_' || item || '_' || nxt FROM t WHERE nxt IS NOT NULL) GROUP BY id, motif""")
def intent_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("type") == "signup", F.concat(F.lit("INTENT_"), F.upper(F.left("atom", F.lit(4))))).otherwise(F.col("type"))
    seqs = S.sequences(traces(spark, sf_dir).withColumn("item", item), ["id"], "item")
    return seqs.select("id", F.explode(P.intent_motifs(F.col("seq"))).alias("motif")).groupBy("id", "motif").agg(F.count("*").alias("n"))


@query(f"WITH {SETS} SELECT id FROM z WHERE list_has_all(edits, [1, 3])")
def structural_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_sets(spark, sf_dir).where(P.has_pattern(F.col("edits"), ["1", "3"])).select("id")


@query()
def itemset_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace's largest closed set of operations."""
    from ..operators.motifs import closed_itemsets

    sets = trace_sets(spark, sf_dir).select("id", "scopes").where("size(scopes) > 0")
    closed = closed_itemsets(sets, "scopes", 0.3)
    return P.assign_itemsets(sets, "id", "scopes", closed)


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q WHERE label = 3 AND regexp_matches(CAST(vec_id AS VARCHAR), '[02468]$'))
SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def additive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, regular expression and similarity in one plan."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select("embedding").first()  # one vector
    condition = Q.matches(e, ["label=3"], F.col("vec_id").cast("string"), "[02468]$")
    found = Q.search(e, condition, [float(x) for x in probe[0]] if probe else None, key="vec_id", top_k=10)
    return found.select("vec_id", "label", rounded(F.col("score")).alias("score"))


@query("SELECT user_id AS id, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_sent FROM events GROUP BY user_id")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage objects nested in a JSON record of each user, summed at any depth."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    call = F.struct(F.struct(F.struct(F.col("k").alias("prompt_tokens")).alias("usage")).alias("response"))
    records = e.groupBy("id").agg(F.to_json(F.struct(F.collect_list(call).alias("steps"))).alias("raw"))
    return records.withColumn("u", P.nested_usage("raw")).select("id", "u.api_calls", "u.tokens_sent")
