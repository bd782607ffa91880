"""Comparisons, patterns, loaders and searches on small cases worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.functions import query as Q
from loomtrail.operators import comparisons as C
from loomtrail.operators import patterns as P
from loomtrail.operators import weights as W
from loomtrail.sources import loaders as L


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return row.select(column.alias("x")).collect()[0].x


def test_levels_are_null_only_without_both(spark):
    schema = ", ".join(f"{n}_{s} array<string>" for n in C.LEVELS for s in "ab")
    rows = [(["x", "y"], ["x"], ["a"], ["a", "b"], [], [], ["m"], []), ([], [], [], [], [], [], [], [])]
    code = F.create_map(F.lit("x"), F.lit("x"), F.lit("y"), F.lit("y"))
    d = C.four_levels(spark.createDataFrame(rows, schema), code)
    values = {n: F.col(f"d_{n}") for n in C.LEVELS}
    got = d.select(*[f"d_{n}" for n in C.LEVELS], C.weighted_mean(values).alias("m"), C.weighted_mean(values, {"scopes": 1.0}).alias("w")).collect()
    assert tuple(got[0])[:4] == (0.5, pytest.approx(1 / 3), None, 1.0) and got[0].m == pytest.approx((0.5 + 1 / 3 + 1) / 3) and got[0].w is None
    assert tuple(got[1]) == (None,) * 6


def test_fields(spark):
    v = "array<double>"
    assert one(spark, C.field_distance(F.col("a"), F.col("b")), a=([1.0, 0.0], v), b=([0.0, 2.0], v)) == 1.0
    assert one(spark, C.field_distance(F.col("a"), F.col("b")), a=([], v), b=([0.0, 2.0], v)) == 1.0
    assert one(spark, C.field_distance(F.col("a"), F.col("b")), a=([2.0, 0.0], v), b=([1.0, 0.0], v)) == pytest.approx(0)
    assert tuple(one(spark, C.field_divergence(F.col("a"), F.col("b")), a=(None, v), b=([1.0], v))) == (True, 1.0)
    s = "array<string>"
    assert one(spark, C.set_overlap(F.col("a"), F.col("b")), a=([], s), b=([], s)) == 1.0
    assert one(spark, C.set_overlap(F.col("a"), F.col("b")), a=(["p"], s), b=([], s)) == 0.0
    assert tuple(one(spark, C.set_divergence(F.col("a"), F.col("b")), a=(None, s), b=(["p", "q"], s))) == (True, 1.0)
    m = "map<string,double>"
    assert one(spark, C.soft_distance(F.col("a"), F.col("b")), a=({}, m), b=({}, m)) == 0.0
    assert one(spark, C.soft_distance(F.col("a"), F.col("b")), a=({"p": 1.0}, m), b=({"q": 1.0}, m)) == 1.0
    assert one(spark, C.soft_distance(F.col("a"), F.col("b")), a=({"p": 3.0, "q": 4.0}, m), b=({"p": 3.0}, m)) == pytest.approx(1 - 0.6)
    layered = one(spark, C.layered_similarity(*map(F.col, "abcdef")), a=(["f"], s), b=(["g", "f"], s), c=([], s), d=([], s), e=(["x", "y"], s), f=(["y"], s))
    assert tuple(layered) == (True, 0.0, 0.5, 0)


def test_trees_or_sets(spark):
    t, s = "array<struct<labels:array<string>,parents:array<int>>>", "array<string>"
    column = C.tree_or_set_distance(*map(F.col, "abcd"))
    leaf, two = (["x"], [-1]), (["y", "x"], [1, -1])
    assert one(spark, column, a=([leaf], t), b=([two, (["q", "r", "s"], [2, 2, -1])], t), c=(["o"], s), d=([], s)) == pytest.approx(0.01)
    assert one(spark, column, a=([], t), b=([two], t), c=(["o"], s), d=([], s)) == 1.0


def test_procedures_families_and_arms(spark):
    rows = [(1, "p", [1.0, 0.0]), (1, "q", [0.0, 1.0]), (2, "p", [1.0, 0.0]), (2, "q", [1.0, 0.0]), (3, "p", [1.0, 1.0])]
    got = C.procedure_matrix(spark.createDataFrame(rows, "r int, proc string, e array<double>"), "r", "proc", "e").collect()
    assert [tuple(x) for x in got] == [("p", "q", 2, 0.5, 0.5)]
    pairs = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.5), ("b", "c", 0.7)], "group_a string, group_b string, jsd double")
    families = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "group string, family int")
    assert C.family_gap(pairs, families).collect()[0].gap == pytest.approx(0.6 - 0.1)
    counts = [("u", i, "xy"[(i + k) % 2], 1) for i in range(40) for k in range(2)] + [("v", i, "z", 2) for i in range(40, 60)] + [("w", 90, "z", 1)]
    df = spark.createDataFrame(counts, "arm string, id int, item string, n int")
    noise = {r.arm: r for r in C.split_half_noise(df, "arm", "id", "item", 8).collect()}
    assert noise["u"].median == pytest.approx(0, abs=1e-12) and noise["v"].records == 20 and noise["w"].median is None
    across = {(r.group_a, r.group_b): r for r in C.compare_arms(df, "arm", "id", "item", 8, 2.0).collect()}
    assert across[("u", "v")].across == pytest.approx(1.0) and across[("u", "v")].moved and across[("u", "w")].snr is None


def rand_index(p, r):
    two = lambda x: x * (x - 1) / 2
    n = {}
    for x in zip(p, r, strict=True):
        n[x] = n.get(x, 0) + 1
    side = lambda k: sum(two(sum(v for x, v in n.items() if x[k] == c)) for c in {x[k] for x in n})
    a, b, s, t = side(0), side(1), sum(map(two, n.values())), two(len(p))
    return (s - a * b / t) / ((a + b) / 2 - a * b / t)


def test_rand_index(spark):
    r = np.random.default_rng(3)
    p, q = r.integers(0, 3, 80), r.integers(0, 3, 80)
    rows = spark.createDataFrame([(0, int(a), int(b), 1) for a, b in zip(p, q, strict=True)] + [(1, 1, 1, 1)] * 3, "draw int, p int, r int, n int")
    got = {x.draw: x.ari for x in C.rand_index_by(rows, "draw", "p", "r", "n").collect()}
    assert got[0] == pytest.approx(rand_index(p.tolist(), q.tolist())) and got[1] is None
    same = spark.createDataFrame([(i, i % 3, i % 3) for i in range(60)], "id int, p int, r int")
    out = C.bootstrap_rand_index(same, "id", "p", "r", 20).collect()[0]
    assert out.draws == 20 and out.min_ari == 1.0 and out.std_ari == 0.0


def test_alignment_and_orderings(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], [math.cos(i), math.sin(i)]) for i in range(30)], "id int, a array<double>, b array<double>")
    out = C.alignment_against_shuffled(rows, "id", "a", "b", 19).collect()[0]
    assert out.real == pytest.approx(1.0) and out.p == 0.05 and out.null_mean < 0.9
    solved = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("z", 3), ("z", 2)], "agent string, form int")
    got = C.accumulation_by_orderings(solved, "agent", "form").collect()
    assert [r.mean_solved for r in got] == pytest.approx([5 / 3, (2 + 3 + 2) / 3, 3.0]) and got[2].std_solved == 0
    assert C.accumulation_by_orderings(solved.limit(0), "agent", "form").count() == 0


def test_patterns(spark):
    files = ["a"] * 6 + ["b", "a", "b", "a"]
    rows = [(1, k, f) for k, f in enumerate(files)] + [(2, 0, "a")] + [(3, k, None) for k in range(4)]
    got = {r.id: r.motifs for r in P.file_switch_motifs(spark.createDataFrame(rows, "id int, pos int, file string"), "id", "pos", "file").collect()}
    assert got == {1: ["HOTSPOT_8", "DEPENDENCY_CHASE"], 2: [], 3: []}
    items = ["INTENT_FIX", "edit", "run", "INTENT_TEST", "INTENT_FIX"]
    want = ["INTENT_FIX_TO_edit", "INTENT_PATTERN_INTENT_FIX_edit_run", "INTENT_TYPE_FIX", "INTENT_TEST_TO_INTENT_FIX", "INTENT_TYPE_TEST", "INTENT_TYPE_FIX", "INTENT_TRANS_INTENT_FIX_INTENT_TEST", "INTENT_TRANS_INTENT_TEST_INTENT_FIX"]
    assert one(spark, P.intent_motifs(F.col("s")), s=(items, "array<string>")) == want and one(spark, P.intent_motifs(F.col("s")), s=([], "array<string>")) == []
    assert one(spark, P.has_pattern(F.col("s"), ["edit", "run"]), s=(items, "array<string>")) and not one(spark, P.has_pattern(F.col("s"), ["go"]), s=(items, "array<string>"))
    closed = spark.createDataFrame([(["a", "b"], 9), (["b", "c"], 5), (["a", "b", "c"], 3)], "items array<string>, freq long")
    certs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c", "x"]), (3, ["x"]), (4, ["a", "b", "b"])], "id int, ops array<string>")
    assert {r.id: r.itemset for r in P.assign_itemsets(certs, "id", "ops", closed).collect()} == {1: ["a", "b", "c"], 2: ["b", "c"], 3: None, 4: ["a", "b"]}
    sets = spark.createDataFrame([("f", ["a", "b"]), ("f", ["a", "b", "c"]), ("g", ["a"]), ("g", ["c", "d"])], "form string, items array<string>")
    lifts = {(r.form, tuple(r["items"])): r.lift for r in P.fp_templates(spark, sets, "form", "items", (0.9,)).collect()}
    assert lifts == {("f", ("a", "b")): 2.0}
    registry = P.motif_registry(spark.createDataFrame([(1, "a>b"), (1, "a>b"), (2, "c")], "id int, m string"), "m", "id").collect()
    assert {(r.pattern, r.length, r.n, r.records) for r in registry} == {("a>b", 2, 2, 1), ("c", 1, 1, 1)} and all(r.hash.startswith("M_") and len(r.hash) == 12 for r in registry)


def test_nested_records(spark):
    node = lambda name, *children: {"action_steps": [{"action": {"action_args_class": f"x.y.{name}", "thoughts": "t"}}], "children": list(children)}
    tree = node("View", node("Edit"), {"children": [node("Run")]})
    rows = spark.createDataFrame([("a", json.dumps(tree)), ("b", None), ("c", "no json"), ("d", "[1]")], "id string, tree string")
    got = P.tree_paths(rows, "id", "tree").collect()
    assert [(r.id, r.depth, r.path) for r in got] == [("a", 0, ["View"]), ("a", 1, ["View", "Edit"]), ("a", 2, ["View", "Run"])]
    raw = json.dumps({"x": [{"usage": {"prompt_tokens": 3, "completion_tokens": None}, "response_cost": 0.5}, {"y": {"usage": {"completion_tokens": 4}}}], "usage": 1})
    use = spark.createDataFrame([(raw,), (None,), ("{",)], "raw string").select(P.nested_usage("raw").alias("u")).collect()
    assert [tuple(r.u) for r in use] == [(3, 4, 2, 0.5), (0, 0, 0, 0.0), (0, 0, 0, 0.0)]


def test_loaders(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0.5, 1.0), (1, 0, 0.5, 1.0), (2, 1, 0.25, 0.0), (1, 1, 0.0, 0.0)], "i int, j int, d_x double, d_y double").write.parquet(str(tmp_path / "m.parquet"))
    got = {(r.i, r.j, r.name): r.d for r in L.load_matrices(spark, str(tmp_path / "m.parquet")).collect()}
    assert got == {(0, 1, "x"): 0.5, (0, 1, "y"): 1.0, (1, 2, "x"): 0.25, (1, 2, "y"): 0.0}
    np.savez(tmp_path / "m.npz", D_x=np.array([[0, 0.5], [0.5, 0]]))
    assert [tuple(r) for r in L.load_matrices(spark, str(tmp_path / "m.npz")).collect()] == [(0, 1, "x", 0.5)]
    with pytest.raises(ValueError):
        L.load_matrices(spark, "m.csv")
    (tmp_path / "l.jsonl").write_text('{"instance_id": "a", "label": "p"}\n{"instance_id": "b", "label": ""}\n')
    assert sorted(r.label_value for r in L.load_labels(spark, str(tmp_path / "l.jsonl")).collect()) == ["b", "p"]
    records = spark.createDataFrame([("a", "w", [("2024-01-02T00:00:00",), (None,)]), ("b", "w", [("2024-02-02T00:00:00",)] * 3), ("c", "v", [])], "id string, workspace string, events array<struct<timestamp string>>")
    ids = lambda **k: sorted(r.id for r in L.filter_records(records, **k).collect())
    assert (ids(), ids(least_events=2), ids(workspace="v"), ids(since="2024-01-15"), ids(until="2024-01-15")) == (["a", "b", "c"], ["a", "b"], ["c"], ["b"], ["a"])
    assert L.parse_types("tools") == set(L.EVENT_TYPES) - {"prompt"} and L.parse_types("run,code_change") == {"run", "code_change"}
    with pytest.raises(ValueError):
        L.parse_types("run,fly")
    assert L.derived_name("/x/t.jsonl.gz", True, "tools", True, "2024-01-01..") == "/x/t.anon.tools.compact.2024-01-01.jsonl"
    assert L.derived_name("t.parquet") == "t.jsonl" and L.derived_name("t.jsonl", interval="..") == "t.window.jsonl"
    assert "3 rows" in L.push_report(records, "me/set") and "JSON-encoded columns: events" in L.push_report(records, "me/set")
    chat = [("user", "fix"), ("assistant", "I look.\n```bash\nls\n```"), ("tool", "a.py"), ("assistant", None)]
    events = one(spark, L.chat_events(F.col("m")), m=(chat, "array<struct<role:string,content:string>>"))
    assert [(e.type, e.text.strip()) for e in events] == [("prompt", "fix"), ("model_reasoning", "I look."), ("terminal_command", "ls"), ("observation", "a.py")]
    tasks = spark.createDataFrame([("say", "print()", 7), (None, "x", 8)], "text string, code string, task_id int")
    assert [(r.instance_id, [e.type for e in r.events]) for r in L.code_task_traces(tasks, "mbpp").collect()] == [("7", ["prompt", "edit"]), ("8", ["edit"])]
    L.export_sessions(spark.createDataFrame([("s1", [("a",), ("b",)]), ("s2", [("c",)])], "instance_id string, events array<struct<type string>>"), str(tmp_path / "sessions"))
    assert {(r.session, r.pos, r.type) for r in spark.read.json(str(tmp_path / "sessions")).collect()} == {("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "c")}


def test_search_and_transcripts(spark):
    rows = [(1, "x", "Foo bar", "2024-01-01", [1.0, 0.0]), (2, None, "foo", "2024-01-05", [0.0, 1.0]), (3, "x", "baz", None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, kind string, text string, day string, embedding array<double>")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(Q.search(df, Q.matches(df, ["kind=x"]))) == [1, 3] and ids(Q.search(df, Q.matches(df, ["kind=null"]))) == [2]
    assert ids(Q.search(df, Q.matches(df, (), F.col("text"), "^foo"))) == [1, 2]
    assert ids(Q.search(df, Q.matches(df, time=F.col("day").cast("timestamp"), since="2024-01-02"))) == [2]
    assert ids(Q.search(df, Q.matches(df), [1.0, 0.0], top_k=2)) == [1, 3] and ids(Q.search(df, Q.matches(df), [1.0, 0.0], min_score=0.5, limit=1)) == [1]
    with pytest.raises(ValueError):
        Q.matches(df, ["kind"])
    event = lambda kind, **d: {"type": kind, "details": d, "timestamp": None}
    record = {"instance_id": "i", "agent": "g", "events": [event("read", file_path="a.py"), event("prompt", text="fix\n it"), event("run", command="ls"), event("run", command="x" * 50), event("run"), event("run", tool="t")]}
    assert Q.transcript(record).split("\n") == ["i g", "6 events", "    ▪ read      a.py", "", "▸ fix it", "    $ run   ×4  ls, " + "x" * 39 + "…, +1 more"]


def test_weights_and_learned_forms(spark):
    words = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("c", "z", 3)], "id string, item string, n int")
    idf = {"x": math.log(4 / 3) + 1, "y": math.log(2) + 1, "z": math.log(2) + 1}
    v = W.tf_idf(words, "id", "item")
    assert {(r.id, r["item"]): pytest.approx(r.v) for r in v.collect()} == {("a", "x"): 2 * idf["x"], ("a", "y"): idf["y"], ("b", "x"): idf["x"], ("c", "z"): 3 * idf["z"]}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "none")], "a string, b string")
    got = {(r.a, r.b): r.cosine for r in W.cosines(v, pairs, "id", "item").collect()}
    assert got == {("a", "b"): pytest.approx(2 * idf["x"] / math.hypot(2 * idf["x"], idf["y"])), ("a", "c"): 0.0}
    assert [tuple(r) for r in W.vocabulary(words, "id", "item", 2).collect()] == [("x", 2, 2, 0.5), ("y", 1, 1, 0.25)]
    rows = spark.createDataFrame([(i, i % 10, i % 3, (i % 10) > 4, "pq"[(i // 10) % 2]) for i in range(80)], "id int, u int, w int, passed boolean, grp string")
    leaves = W.tree_forms(rows, ["u", "w"], "passed", 2).collect()
    assert sorted((r.n, r.rate) for r in leaves) == [(40, 0.0), (40, 1.0)] and leaves[0].spread == 0.25
    probe = W.leave_group_out(rows, ["u", "w"], "passed", "grp").collect()
    assert [(r.held_out, r.n) for r in probe] == [("p", 40), ("q", 40)] and all(r.accuracy >= 0.9 for r in probe)
