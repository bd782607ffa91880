"""Queries over record formats, rules for records, patches and code edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as K
from ..functions import classify as R
from ..operators import code as X
from ..operators import comparisons as C
from ..operators import distances as D
from ..operators import statistics as A
from .q_distances import CERTS, EVERY, certificates, vectors
from .q_statistics import pair_shares
from .registry import TRACES, query, rounded, table, traces

#: What each event type is in each of the four formats, by agent, and the atom that it becomes.
WORDS = {
    "click": ("search_dir foo", "search_repo foo", "Localize to related elements", "x.y.FindClassArgs"),
    "view": ("open src/a.py", "open src/a.py", "Embedding retrieval files", "x.y.ViewCodeArgs"),
    "purchase": ("edit 1:2", "append x", "Repair Sample 1", "x.y.StringReplaceArgs"),
    "signup": ("str_replace_editor view /r/tests/test_a.py", "create tests/test_a.py", "Regression test selection", "x.y.RunTestsArgs"),
    "error": ("submit", "submit", "src/a.py", "x.y.Unheard"),
}
ATOMS_OF = {
    "click": ("SEARCH", "SEARCH", "SEARCH", "SEARCH"),
    "view": ("OPEN_SRC_PY", "OPEN_SRC_PY", "FIND_FILE", "OPEN_SRC_PY"),
    "purchase": ("EDIT_SRC_PY", "EDIT", "EDIT_SRC_PY", "EDIT_SRC_PY"),
    "signup": ("OPEN_TEST_PY", "CREATE_TEST_PY", "RUN_PYTHON_TEST_PY", "RUN_PYTHON_TEST_PY"),
    "error": ("SUBMIT", "SUBMIT", None, "OTHER"),
}
_ATOM_SQL = "CASE " + " ".join(f"WHEN type = '{t}' AND agent = {a} THEN '{x}'" for t, row in ATOMS_OF.items() for a, x in enumerate(row) if x) + " END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, format, content: each session written in the format of its agent; trees are chains of nodes."""
    word = F.element_at(F.create_map(*[x for t, row in WORDS.items() for x in (F.lit(t), F.array(*map(F.lit, row)))]), F.col("type"))
    rows = traces(spark, sf_dir).withColumn("w", F.element_at(word, (F.col("agent") + 1).cast("int")))
    w = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])
    of = rows.groupBy("id", "agent").agg(w.alias("w"))
    state = F.lit('{"open_file": "/r/src/a.py"}')
    steps = F.transform("w", lambda x: F.struct(x.alias("action"), state.alias("state")))
    messages = F.concat(F.array(F.struct(F.lit("user").alias("role"), F.lit("submit").alias("action"))), F.transform("w", lambda x: F.struct(F.lit("assistant").alias("role"), x.alias("action"))))
    log = F.concat(F.lit("### Problem ###\n"), F.array_join(F.transform("w", lambda x: F.concat(F.lit("### "), x, F.lit("\ntext\n"))), ""))
    node = lambda x: F.concat(F.lit('{"action_steps":[{"action":{"action_args_class":"'), x, F.lit('"}}],"children":['))
    tree = F.concat(F.lit('{"root":'), F.array_join(F.transform("w", node), ""), F.repeat(F.lit("]}"), F.size("w")), F.lit("}"))
    content = F.when(F.col("agent") == 0, F.to_json(F.struct(steps.alias("trajectory")))).when(F.col("agent") == 1, F.to_json(messages)).when(F.col("agent") == 2, log).otherwise(tree)
    kind = F.when(F.col("agent") == 1, K.MESSAGES).when(F.col("agent") == 2, K.LOG).when(F.col("agent") == 3, K.TREE)
    return of.select("id", kind.alias("format"), content.alias("content"))


@query(f"""WITH {TRACES}, a AS (SELECT id, agent, pos, {_ATOM_SQL} AS atom FROM ev), n AS (SELECT id, agent, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, atom FROM a WHERE atom IS NOT NULL)
SELECT id, CAST(pos AS INTEGER) AS pos, atom FROM n UNION ALL SELECT id, CAST(max(pos) + 1 AS INTEGER), 'SUBMIT' FROM n WHERE agent = 2 GROUP BY id""")
def canonical_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of four formats as atoms of one alphabet."""
    return K.canonical_atoms(records(spark, sf_dir))


def _any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"""WITH f AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id), p AS (SELECT DISTINCT conv_id, arg_min(text, text) OVER (PARTITION BY conv_id) AS text FROM (SELECT c.conv_id, coalesce(c.text, '') AS text FROM conversations c JOIN f USING (conv_id, turn) WHERE c.role = 'user'))
SELECT conv_id, CASE {' '.join(f"WHEN {_any_sql('lower(text)', words)} THEN '{name}'" for name, words in R.TASK_TYPES)} ELSE 'bug_fix' END AS task_type, CAST(length(text) AS INTEGER) AS prompt_length FROM p""")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of task and the length of the first prompt of each conversation; of prompts at one turn the first in order."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("text", F.coalesce("text", F.lit("")))
    first = c.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", R.task_type(F.col("text")).alias("task_type"), F.length("text").alias("prompt_length"))


PATHS = {"click": "src/a.py", "view": "docs/x.md", "purchase": "tests/test_a.py", "signup": "setup.py", "error": None}
KINDS = {"click": "search", "view": "file_open", "purchase": "code_change", "signup": "file_created", "error": "other"}
SUMMARIES = ["", "fix a crash", "add a method", "clean", "verify docs"]


def _case(values: dict[str, str | None]) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items() if v) + " END"


def _rule_sql() -> str:
    low, none = "lower(coalesce(path, ''))", "lower(summary)"
    rules = [(_any_sql(low, w), n) for n, w in R.PATH_INTENTS] + [(_any_sql(none, w), n) for n, w in R.SUMMARY_INTENTS]
    rules += [
        ("plus > 30 AND plus > minus * 1.5", "INTENT_FEATURE"), ("minus > plus * 2 AND minus > 20", "INTENT_REFACTOR"), ("plus + minus BETWEEN 1 AND 14 AND kind = 'code_change'", "INTENT_DEBUG"),
        ("plus + minus > 20 AND abs(plus - minus) < (plus + minus) * 0.3", "INTENT_REFACTOR"), ("plus BETWEEN 15 AND 30 AND plus > minus", "INTENT_FEATURE"), ("kind = 'file_created'", "INTENT_FEATURE"), ("kind IN ('file_open', 'search')", "INTENT_NAVIGATE"),
    ]
    return " UNION ALL ".join(f"SELECT event_id, {k} AS place, '{n}' AS intent FROM e WHERE {c}" for k, (c, n) in enumerate(rules))


@query(f"""WITH e AS (SELECT event_id, {_case(PATHS)} AS path, {_case(KINDS)} AS kind, [{', '.join(f"'{x}'" for x in SUMMARIES)}][event_id % 5 + 1] AS summary, user_id % 50 AS plus, (event_id % 41) AS minus FROM events), r AS ({_rule_sql()}), d AS (SELECT event_id, intent, min(place) AS place FROM r GROUP BY ALL), s AS (SELECT event_id, string_agg(intent, ',' ORDER BY place) AS intents FROM d GROUP BY event_id)
SELECT event_id, coalesce(intents, 'INTENT_OTHER') AS intents FROM e LEFT JOIN s USING (event_id)""".replace("CASE type", "CASE event_type"))
def event_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intents of each event by its file, summary, size and type."""
    e = table(spark, sf_dir, "events")
    value = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("event_type"))
    summary = F.element_at(F.array(*map(F.lit, SUMMARIES)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.array_join(R.event_intents(value(KINDS), value(PATHS), F.col("user_id") % 50, F.col("event_id") % 41, summary), ",").alias("intents"))


_FENCED = "regexp_extract_all(coalesce(text, ''), '(?s)```(?:python|py)?\\s*\\n(.*?)\\n```', 1)"


@query(f"""SELECT doc_id, CAST(len(list_filter({_FENCED}, lambda b: regexp_matches(b, '\\b(import|from|assert|raise|print|>>>)\\b'))) > 0 AS INTEGER) AS has_reproducer, CAST(regexp_matches(coalesce(text, ''), '(?i)\\bdef\\s+test_\\w+|\\btest_\\w+\\s*\\(') AS INTEGER) AS has_failing_test,
CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS INTEGER) AS issue_length_words, CAST(len({_FENCED}) AS INTEGER) AS n_code_blocks FROM documents""")
def issue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of texts as issues."""
    return table(spark, sf_dir, "documents").select("doc_id", R.issue_features(F.col("text")).alias("f")).select("doc_id", "f.*")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, patch: a hunk for each event of a session, in files by event type."""
    hunk = F.concat(F.lit("diff --git a/src/"), F.col("type"), F.lit("_x.py b/src/"), F.col("type"), F.lit("_x.py\n--- a\n+++ b\n@@ -1,2 +1,3 @@ def run_"), F.col("k").cast("string"), F.lit("(x):\n-    y = 1\n+    if x:\n+        return "), F.col("k").cast("string"), F.lit("\n z\n"))
    rows = traces(spark, sf_dir).withColumn("h", hunk)
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "").alias("patch"))


@query(f"WITH {TRACES} SELECT id, CAST(3 * count(*) AS INTEGER) AS loc_delta, CAST(count(*) AS INTEGER) AS n_hunks, CAST(count(*) AS INTEGER) AS n_files_touched, CAST(7 * count(*) AS INTEGER) AS ast_complexity, CAST(7 AS INTEGER) AS ast_distinct_types FROM ev GROUP BY id")
def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(spark, sf_dir)
    counts = p.select(F.col("id").cast("string").alias("id"), R.patch_features(F.col("patch")).alias("f"))
    tokens = p.select(F.col("id").cast("string").alias("id"), "patch").mapInPandas(X.patch_sequences, X.SEQUENCE_DDL)
    both = counts.join(tokens, "id")
    return both.select(F.col("id").cast("long").alias("id"), "f.*", F.size("tokens").alias("ast_complexity"), F.size(F.array_distinct("tokens")).alias("ast_distinct_types"))


@query(f"""WITH {TRACES}, k AS (SELECT id, k, min(pos) AS place FROM ev GROUP BY ALL), f AS (SELECT id, list('run ' || k ORDER BY place)[:3] AS f FROM k GROUP BY id), s AS (SELECT id, list('src ' || type || ' x' ORDER BY pos)[:2] AS m, least(count(*), 4) AS n FROM ev GROUP BY id)
SELECT id, 'Module: ' || array_to_string(m, '; ') || '. Function: ' || array_to_string(f, ', ') || '. Code context: ' || array_to_string(list_transform(range(n), lambda x: 'y = 1'), ' | ') AS location FROM s JOIN f USING (id)""")
def fix_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each patch changes code, in words."""
    return patches(spark, sf_dir).select("id", R.fix_location(F.col("patch")).alias("location"))


@query(f"WITH {TRACES} SELECT id, round(avg(CASE WHEN k % 5 = 0 OR k % 5 = 1 OR k % 5 = 2 THEN 0.0 ELSE 1.0 END), 6) AS grounding FROM ev GROUP BY id")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each session's notes that refer to something."""
    k = F.pmod("k", F.lit(5))
    reference = F.when(k == 0, " N/A").when(k == 1, "—").when(k == 3, "step 3").when(k == 4, "none of it")
    return traces(spark, sf_dir).groupBy("id").agg(rounded(F.avg(R.grounded(reference).cast("double"))).alias("grounding"))


NAMES = ["2024_sweagent_gpt4", "agentless-o1", "x_coder_Qwen2", "RAG_llama", "factory", "nothing"]


@query(f"""WITH s AS (SELECT s_suppkey, [{', '.join(f"'{n}'" for n in NAMES)}][s_suppkey % 6 + 1] AS n, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Org' END AS org FROM supplier)
SELECT s_suppkey, CASE {' '.join(f"WHEN {_any_sql('lower(n)', w)} THEN '{f}'" for f, w in R.FAMILIES)} ELSE 'other/unknown' END AS family, CASE {' '.join(f"WHEN contains(lower(n), '{p}') THEN '{x}'" for p, x in R.SCAFFOLDS)} WHEN org <> '' THEN org ELSE 'unknown' END AS scaffold, n || ', b' AS model, s_suppkey % 2 = 0 AS has_trajs, '?' AS os_model FROM s""")
def submission_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, scaffold and tags of submissions, from metadata in JSON."""
    s = table(spark, sf_dir, "supplier")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    org = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("Org")
    trajs = F.when(F.col("s_suppkey") % 2 == 0, "s3://x").otherwise("")
    meta = F.to_json(F.struct(F.struct(trajs.alias("trajs")).alias("assets"), F.struct(F.array(name, F.lit("b")).alias("model"), org.alias("org")).alias("tags")))
    m = s.select("s_suppkey", name.alias("n"), R.submission(meta).alias("m"))
    return m.select("s_suppkey", R.model_family(F.col("n")).alias("family"), R.scaffold(F.col("n"), F.col("m.org")).alias("scaffold"), "m.model", "m.has_trajs", "m.os_model")


#: Three changes of a source and what they are made of.
CHANGES = [
    ("def f(x):\n    return x\n", "def f(x):\n    if x:\n        g(x)\n    return x\n", ["ADD_If@FunctionDef"], ["ADD_Call", "ADD_Expr", "ADD_If", "ADD_Name"]),
    ("class A:\n    x = 1\n", "class A:\n    x = 2\n", ["ADD_Assign@ClassDef", "DEL_Assign@ClassDef"], ["ADD_Assign", "ADD_Constant", "ADD_Name", "DEL_Assign", "DEL_Constant", "DEL_Name"]),
    ("import a\n", "import a\nimport b\n", ["ADD_Import@Module"], ["ADD_Import", "ADD_alias"]),
]


@query("""WITH c AS (SELECT doc_id, doc_id % 3 AS v FROM documents) SELECT doc_id, CASE v """ + " ".join(f"WHEN {k} THEN '{','.join(c)}'" for k, (_, _, c, _) in enumerate(CHANGES)) + """ END AS contextual, CASE v """ + " ".join(f"WHEN {k} THEN '{','.join(e)}'" for k, (_, _, _, e) in enumerate(CHANGES)) + """ END AS operations,
CASE v WHEN 0 THEN 'FunctionDef:f' WHEN 1 THEN 'ClassDef:A' ELSE '' END AS scopes, 'p/q' AS module, CASE v WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS patch_size FROM c""")
def scoped_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations, scopes and size of a change of code for each document."""
    d = table(spark, sf_dir, "documents")
    at = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in CHANGES]), (F.col("doc_id") % 3 + 1).cast("int"))
    change = F.struct(F.lit("p/q/m.py").alias("file_path"), at(0).alias("before"), at(1).alias("after"))
    found = d.select(F.col("doc_id").cast("string").alias("id"), F.array(change).alias("changes")).mapInPandas(X.scoped_certificates, X.SCOPED_DDL)
    joined = lambda c: F.array_join(c, ",")
    return found.select(F.col("id").cast("long").alias("doc_id"), joined("contextual_ops").alias("contextual"), joined("edit_cert").alias("operations"), joined("scopes_touched").alias("scopes"), F.col("file_module").alias("module"), "patch_size")


@query(f"""WITH {TRACES}, f AS (SELECT id, 'f' || (k % 4) || '.py' AS file, type FROM ev), c AS (SELECT id, file, count(*) FILTER (type = 'purchase') AS e, count(*) FILTER (type = 'view') AS n, count(*) FILTER (type = 'click') AS a, count(*) FILTER (type = 'error') AS t FROM f WHERE type <> 'signup' GROUP BY ALL)
SELECT id, coalesce(max(files), 'unknown') AS files FROM (SELECT id, string_agg(file || ':e' || e || ':n' || n || ':a' || a || ':p' || a || ':t' || t, ' | ' ORDER BY file) AS files FROM c GROUP BY id UNION ALL SELECT DISTINCT id, NULL FROM ev) GROUP BY id""")
def file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session did to each file, in one line."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"purchase": "code_change", "view": "navigate", "click": "prompt", "error": "terminal_command", "signup": "other"}.items() for x in kv]), F.col("type"))
    file = F.concat(F.lit("f"), F.pmod("k", F.lit(4)).cast("string"), F.lit(".py"))
    return C.file_actions(traces(spark, sf_dir).select("id", kind.alias("kind"), file.alias("file"), F.concat(F.lit("cat "), file).alias("command")), "id").select("id", "files")


@query("""WITH v AS (SELECT vec_id AS i, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT CASE b.i - a.i WHEN 1 THEN 'behavioral' ELSE 'mechanistic' END AS procedure, a.label AS kind, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN (SELECT i - 1 AS at, i, e FROM v UNION ALL SELECT i - 2, i, e FROM v) b ON b.at = a.i)
SELECT procedure, kind, count(*) AS n, round(avg(d), 6) AS divergence FROM x GROUP BY GROUPING SETS ((procedure), (procedure, kind))""")
def baseline_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two other vectors of a record lie from its own, by procedure, and by procedure and label."""
    v = vectors(spark, sf_dir)
    later = lambda k: v.select((F.col("id") - k).alias("id"), F.col("v").alias(f"v{k}"))
    rows = v.join(later(1), "id", "left").join(later(2), "id", "left")
    return C.baseline_divergence(rows, "v", {"behavioral": "v1", "mechanistic": "v2"}, "label").withColumn("divergence", rounded(F.col("divergence")))


@query()
def signal_against_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("label", F.col("label") >= 5)
    return C.signal_against_null(v.where(F.pmod("id", F.lit(EVERY)) == 0), v, 5, 8)


_JSD = "v{n} AS (SELECT DISTINCT item FROM d{n}), f{n} AS (SELECT g.agent, v{n}.item, coalesce(d{n}.p, 0) AS p FROM (SELECT DISTINCT agent FROM d{n}) g CROSS JOIN v{n} LEFT JOIN d{n} ON d{n}.agent = g.agent AND d{n}.item = v{n}.item), j{n} AS (SELECT a.agent AS x, b.agent AS y, sum(CASE WHEN a.p > 0 THEN a.p / 2 * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p / 2 * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) AS jsd FROM f{n} a JOIN f{n} b ON a.item = b.item AND a.agent < b.agent GROUP BY ALL)"


@query(f"""WITH {TRACES}, d1 AS (SELECT agent, type AS item, count(*) / sum(count(*)) OVER (PARTITION BY agent) AS p FROM ev GROUP BY agent, type), pr AS (SELECT agent, type || '>' || lead(type) OVER (PARTITION BY id ORDER BY pos) AS item FROM ev), d2 AS (SELECT agent, item, count(*) / sum(count(*)) OVER (PARTITION BY agent) AS p FROM pr WHERE item IS NOT NULL GROUP BY agent, item),
{_JSD.replace('{n}', '1')}, {_JSD.replace('{n}', '2')} SELECT x AS group_a, y AS group_b, round(j1.jsd, 6) AS low, round(j2.jsd, 6) AS high, round((j2.jsd - j1.jsd) / j2.jsd, 5) AS share FROM j1 JOIN j2 USING (x, y)""")
def sequence_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the divergence of agents over adjacent pairs is not there over single events."""
    one = traces(spark, sf_dir).groupBy("agent", F.col("type").alias("item")).agg(F.count("*").alias("n"))
    jsd = lambda shares: A.jsd_matrix(shares, "agent", "item")
    s = C.sequence_share(jsd(A.distribution(one, "agent", "item")), jsd(pair_shares(spark, sf_dir)))
    return s.select("group_a", "group_b", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), F.round("share", 5).alias("share"))


@query(f"WITH {CERTS} SELECT a.id AS id_a, b.id AS id_b, round(1 - len(list_intersect(a.ops, b.ops)) / (len(a.ops) + len(b.ops) - len(list_intersect(a.ops, b.ops))), 6) AS distance FROM cert a JOIN cert b ON a.agent < 2 AND a.id % 20 = 0 AND b.agent >= 2")
def cross_dataset_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated sessions of the first two agents, as one data set, against all of the other two."""
    c = certificates(spark, sf_dir)
    pairs = D.cross_pairs(c.where((F.col("agent") < 2) & (F.pmod("id", F.lit(EVERY)) == 0)), c.where("agent >= 2"), "id", ["ops"])
    return pairs.select("id_a", "id_b", rounded(D.jaccard_distance(F.col("ops_a"), F.col("ops_b"))).alias("distance"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'A' ELSE '' END AS functions FROM documents")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes that a change of code for each document names."""
    after = F.element_at(F.array(*[F.lit(c[1]) for c in CHANGES]), (F.col("doc_id") % 3 + 1).cast("int"))
    event = F.struct(F.lit("edit").alias("type"), F.lit("m.py").alias("file_path"), F.lit(None).cast("string").alias("before"), after.alias("after"))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(event).alias("events")).mapInPandas(X.functions_of_events, X.FUNCTIONS_DDL)
    return found.select(F.col("id").cast("long").alias("doc_id"), F.array_join("functions", ",").alias("functions"))
