"""Queries over text: filters, search, anonymising and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import distances as D
from .registry import TRACES, query, rounded, table, traces

PROBES = ["open src/main.py", "create tests/test_a.py", "edit 3:4\nx", "PYTHONPATH=. python manage.py test", "pytest -q tests/test_b.py", "ls -la", "find . -name x", "search_dir foo", "submit", "# note", "", "make html", "sed -i s/a/b/ f", "foo bar", "pip install x", "./bin/test all", "goto 12"]


@query("SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(left(text, 2000), '(?i)worthless|pathetic') AND (lang = 'en' OR lang IS NULL)")
def grep_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(((F.col("lang") == "en") | F.col("lang").isNull()) & F.left("text", F.lit(2000)).rlike("(?i)worthless|pathetic")).select("doc_id", "source", "n_chars")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06') GROUP BY user_id")
def interval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    inside = e.where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-06'").select("user_id").distinct()
    return e.join(inside, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {TRACES} SELECT id, pos, type, k FROM ev WHERE type IN ('purchase', 'error')")
def type_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).where(F.col("type").isin("purchase", "error")).select("id", "pos", "type", "k")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def head_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").offset(20).limit(50)


@query(f"WITH {TRACES} SELECT id, min(ts) AS started FROM ev GROUP BY id ORDER BY started, id LIMIT 100")
def earliest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("id").agg(F.min("ts").alias("started")).orderBy("started", "id").limit(100)


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 240) || '… (' || length(text) || ' chars)' ELSE text END AS view FROM documents")
def truncated_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n > 240, F.concat(F.left("text", F.lit(240)), F.lit("… ("), n.cast("string"), F.lit(" chars)"))).otherwise(F.col("text")).alias("view"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+', '<email>', 'g'), '\b(\d{1,3}\.){3}\d{1,3}\b', '<ip>', 'g') AS t FROM documents)
SELECT doc_id, (length(t) - length(replace(t, '<email>', ''))) // 7 AS emails, (length(t) - length(replace(t, '<ip>', ''))) // 4 AS ips FROM s WHERE t LIKE '%<email>%' OR t LIKE '%<ip>%'""")
def masked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where(F.col("t").contains("<email>") | F.col("t").contains("<ip>"))
    return rows.select("doc_id", F.regexp_count("t", F.lit("<email>")).cast("long").alias("emails"), F.regexp_count("t", F.lit("<ip>")).cast("long").alias("ips"))


@query()
def anonymised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", X.anonymise(F.col("text")).alias("text"))


@query("SELECT * FROM (VALUES ('home path'), ('windows home'), ('workspace slug'), ('url-encoded home'), ('email'), ('credential'), ('forge owner'), ('repos owner')) AS k(kind), (SELECT CAST(0 AS BIGINT) AS n)")
def residuals_after_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.residual_counts(anonymised_documents(spark, sf_dir).select("text"))


@query(r"SELECT 'email' AS kind, CAST(sum(len(regexp_extract_all(text, '\b[A-Za-z][\w.+-]*@[A-Za-z][\w-]*\.[A-Za-z]{2,24}\b'))) AS BIGINT) AS n FROM documents")
def email_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.residual_counts(table(spark, sf_dir, "documents").select("text")).where("kind = 'email'")


@query()
def identity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(table(spark, sf_dir, "documents"), "text")


@query()
def action_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, a) for k, a in enumerate(PROBES)], "pos int, action string").select("pos", X.action_atom(F.col("action")).alias("atom"))


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(probe)).select("vec_id", D.cosine(F.col("embedding"), F.col("q")).alias("score"))  # one probe
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", rounded(F.col("score")).alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS squared FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(D.dot(F.col("embedding"), F.col("embedding")), 5).alias("squared"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'kept' END AS state, count(*) AS n FROM documents GROUP BY 1")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.index import changes

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    return changes(docs.where("id % 3 <> 0"), docs).groupBy("state").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p')) AS paragraphs, len(string_split(html, chr(10))) AS lines FROM pages")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<a ").alias("links"), n("<p").alias("paragraphs"), (n("\n") + 1).alias("lines"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS n_bytes FROM documents")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS roles, left(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), 2000) AS view FROM conversations GROUP BY conv_id")
def record_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    view = X.record_text(F.array().cast("array<string>"), F.array(F.col("t.text")), 30)
    return rows.select("conv_id", F.array_join("t.role", ">").alias("roles"), view.alias("view"))
