"""The queries of this package: each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, mixing, mtree, sharding, sstable, tokens, toxicity, warc
from .common import prepare, table

CONTROL_CONV = -7
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"))
    pages, buckets = mtree.build_index(vectors)
    return mtree.top_k(vectors.where(mtree.every(100)), pages, buckets)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(CONTROL_CONV).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return chat.chat_digests(chat.format_chat(rows.unionByName(extra)))


OP4_SQL = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {CONTROL_CONV}, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT {CONTROL_CONV}, 1, 'assistant', '{CONTROL_TEXT}'
), seen AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS opens
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), said AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
      + CASE WHEN opens THEN 6 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + 1 + 8 ELSE 7 END AS chars
  FROM seen
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

N_SHARDS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.place(docs, sharding.build_map(docs, N_SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS x, any_value(b.n) AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (x + y - i)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.source_rates(docs))
    return mixed.select("doc_id", "source", "copy", "order_key", F.octet_length("text").cast("long").alias("n_bytes"))


OP9_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN sqrt(bytes) / sum(sqrt(bytes)) OVER () * sum(bytes) OVER () / bytes ELSE 1.0 END AS rate FROM sizes
), cdf AS (
  SELECT source, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS c
  FROM rates, generate_series(0, 400) AS g(i) WHERE rate > 0
), drawn AS (
  SELECT doc_id, source, text, CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|1'), 1, 15) AS BIGINT) / {mixing.SPAN!r} AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, any_value(strlen(d.text)) AS n_bytes, count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('{mixing.SEED}:order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 15) AS BIGINT) AS order_key, n_bytes
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return query

    return {k: ready(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


def registered_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op10_warc": OP10_SQL, "op7_jaccard_join": OP7_SQL, "op4_chat_formatting": OP4_SQL, "op9_source_mixing": OP9_SQL}
