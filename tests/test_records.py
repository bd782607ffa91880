"""Record formats, rules and comparisons on small cases worked out by hand or by brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.functions import canonical as K
from loomtrail.functions import classify as R
from loomtrail.operators import comparisons as C
from loomtrail.operators import distances as D
from loomtrail.operators import statistics as A


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_formats(spark):
    step = lambda action, state=None: {"action": action, "state": state}
    old = {"trajectory": [step("edit 1:2", '{"open_file": "/r/a.py"}'), step("edit 1:2", '{"open_file": "n/a"}'), step("str_replace_editor view"), step("str_replace_editor insert"), step("str_replace_editor undo_edit /r/tests/test_x.py"), step("str_replace_editor fly x"), step("frobnicate"), step(None)]}
    said = [{"role": "user", "action": "ls"}, {"role": "assistant", "action": " "}, {"role": "assistant"}, {"role": "assistant", "action": " search_repo x"}, {"role": "assistant", "action": "APPEND y"}, {"role": "assistant", "action": "frobnicate"}]
    log = "### Issue ###\n### Examples:\n### REPAIR sample 2 \nx ### repair sample 1\n### Localize to edit locations\n"
    deep = {"action_steps": [{"action": {"name": "a.FinishArgs"}}]}
    for _ in range(300):
        deep = {"action_steps": [{"action": {"action_args_class": "p.q.FindClassArgs"}}, {"action": "no"}, 5], "children": [deep, None]}
    tree = {"actions": [{"action": {"action_name": "ListFilesArgs"}}, {"action": None}], "root": deep}
    rows = [(1, None, json.dumps(old)), (2, K.TRAJECTORY, json.dumps(old)), (3, K.MESSAGES, json.dumps(said)), (4, K.LOG, log), (5, K.TREE, json.dumps(tree)), (6, "other", "{}"), (7, None, None), (8, K.TREE, "["), (9, K.LOG, "### nothing"), (10, K.MESSAGES, "{"), (11, None, "{}"), (12, K.TREE, None)]
    df = spark.createDataFrame(rows, "id long, format string, content string").withColumn("pos", F.lit("own")).withColumn("atom", F.lit(1))
    got: dict = {}
    for r in K.canonical_atoms(df).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.atom)
    assert got[1] == ["EDIT_SRC_PY", "EDIT", "OPEN_UNKNOWN", "EDIT", "EDIT_TEST_PY", "OTHER", "OTHER", "EMPTY"] and got[2] == got[1]
    assert got[3] == ["SEARCH", "EDIT", "UNKNOWN_FROBNICATE"] and got[4] == ["EDIT_SRC_PY", "NAV_SRC_PY", "SUBMIT"]
    assert got[5] == ["FIND_FILE", "OTHER"] + ["SEARCH"] * 300 + ["SUBMIT"] and set(got) == {1, 2, 3, 4, 5}
    assert K.canonical_atoms(df.limit(0)).count() == 0


def test_rules(spark):
    rows = [("Please RENAME it", None), ("sort the list", ""), ("", "given"), (None, None), ("this is wrong", None)]
    assert [r[0] for r in values(spark, rows, "p string, g string", x=R.task_type(F.col("p"), F.col("g")))] == ["refactoring", "algorithmic", "given", "bug_fix", "bug_fix"]
    names = [("GPT-4", "20240402_sweagent_gpt4", ""), ("my-Mixtral", "hyperagent", "O"), (None, None, "O"), ("x", "y", None)]
    got = values(spark, names, "m string, s string, o string", f=R.model_family(F.col("m")), s=R.scaffold(F.col("s"), F.col("o")))
    assert got == [("OpenAI", "SWE-agent"), ("Mistral", "HyperAgent"), ("other/unknown", "O"), ("other/unknown", "unknown")]
    meta = [('{"tags": {"model": ["a", "b"], "org": "o", "os_model": "true"}, "assets": {"trajs": "s3"}}',), ('{"tags": {"model": " m "}, "assets": {}}',), ("{",), (None,)]
    assert [tuple(r[0]) for r in values(spark, meta, "m string", x=R.submission(F.col("m")))] == [(True, "a, b", "o", "true", "?"), (False, "m", "", "?", "?"), (False, "", "", "?", "?"), (False, "", "", "?", "?")]
    refs = [(" n/a ",), ("None",), ("—",), (".",), ("",), (None,), ("na 1",), ("step",)]
    assert [r[0] for r in values(spark, refs, "r string", x=R.grounded(F.col("r")))] == [False] * 6 + [True] * 2


def test_issues_and_patches(spark):
    texts = [("a b\n```py\nimport x\n```\nand\n```\nno\n```\n def test_a",), ("test_me (x)",), ("",), (None,)]
    assert [tuple(r[0]) for r in values(spark, texts, "t string", x=R.issue_features(F.col("t")))] == [(1, 1, 12, 2), (0, 1, 2, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    p = "diff --git a/a/b_c.py b/a/b_c.py\n--- a/a/b_c.py\n+++ b/a/b_c.py\n@@ -1,2 +1,2 @@ def run_it(x):\n-  old one\n-\n+new\r+more\n@@ -9 +9 @@\n-z\ndiff --git a/.rc b/.rc\n@@ -1 +1 @@ class K:\n+q\n"
    got = values(spark, [(p,), ("",), (None,)], "p string", x=R.patch_features(F.col("p")), y=R.fix_location(F.col("p")))
    assert tuple(got[0][0]) == (6, 2, 2) and tuple(got[1][0]) == (0, 0, 0) and tuple(got[2][0]) == (0, 0, 0)  # five marks for three hunks
    assert got[0][1] == "Module: a b c; .rc. Function: run it, K. Code context: old one | z" and got[1][1] == "" and got[2][1] == ""


def test_event_intents(spark):
    rows = [("code_change", "src/test_a.py", 3, 1, "Fix it", None), ("x", None, 40, 1, None, "please review"), ("entry_deleted", "README.md", 0, 30, "", ""), (None, None, None, None, None, None), ("x", "a", 12, 11, "", None), ("x", "a", 20, 1, "", None)]
    schema = "k string, p string, a int, r int, s string, e string"
    got = values(spark, rows, schema, x=R.event_intents(*map(F.col, "kpars"), F.col("e")))
    names = [[n.removeprefix("INTENT_") for n in r[0]] for r in got]
    assert names == [["TEST", "DEBUG"], ["EXPLAIN", "REVIEW", "FEATURE"], ["DOCUMENT", "REFACTOR"], ["OTHER"], ["REFACTOR"], ["FEATURE"]]


def test_file_actions(spark):
    rows = [(1, "Code_Change", "a/b.py", None), (1, "prompt", "a/b.py", None), (1, "terminal_command", "a/b.py", "cat b.py"), (1, "terminal_command", "a/b.py", "ls -l"), (1, "navigate", "Z", None), (1, "navigate", None, None), (1, "other", "q", None), (2, "other", "q", None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, kind string, file string, command string")
    assert {r.id: r.files for r in C.file_actions(df, "id").collect()} == {1: "Z:e0:n1:a0:p0:t0 | a/b.py:e1:n0:a1:p1:t1", 2: "unknown", 3: "unknown"}


def test_baseline_divergence(spark):
    rows = [(1, "a", [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]), (2, None, [1.0, 0.0], [1.0, 0.0], None), (3, "a", None, [1.0, 0.0], None), (4, "a", [0.0, 2.0], [], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, kind string, v array<double>, p array<double>, q array<double>")
    got = {(r.procedure, r.kind): (r.n, r.divergence) for r in C.baseline_divergence(df, "v", {"p": "p", "q": "q"}, "kind").collect()}
    assert got == {("p", None): (2, 0.5), ("p", "a"): (1, 1.0), ("p", "unknown"): (1, 0.0), ("q", None): (2, 0.5), ("q", "a"): (2, 0.5)}


def test_cross_pairs(spark):
    a = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "id long, s array<string>")
    b = spark.createDataFrame([(1, ["x"]), (5, []), (6, ["y", "z"])], "id long, s array<string>")
    got = {(r.id_a, r.id_b): r.d for r in D.cross_pairs(a, b, "id", ["s"]).select("id_a", "id_b", D.jaccard_distance(F.col("s_a"), F.col("s_b")).alias("d")).collect()}
    assert got == {(1, 1): 0.0, (1, 5): 1.0, (1, 6): 1.0, (2, 1): 1.0, (2, 5): 1.0, (2, 6): 0.5}
    assert D.cross_pairs(a.limit(0), b, "id", ["s"]).count() == 0


def test_signal_against_null_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[:30, 0] += 2
    rows = [(k, k < 30, [float(x) for x in v[k]]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label boolean, v array<double>")
    draws, k, share = 6, 3, 0.8
    got = C.signal_against_null(df.where("id % 3 = 0"), df, k, draws, share).first()
    shuffled = {(r.permutation, r.id): r.label for r in A.shuffled_labels(df.select("id", F.col("label").cast("int").alias("label")), "label", "id", draws).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]

    def f1(label, ids):
        tp = wrong = 0
        for i in (x for x in ids if x % 3 == 0):
            near = sorted((round(1 - float(unit[i] @ unit[j]), 9), j) for j in ids if j != i)[:k]
            guess = sum(label[j] for _, j in near) / k >= 0.5
            tp += label[i] and guess
            wrong += bool(label[i]) != guess
        return 2 * tp / (2 * tp + wrong) if tp else 0.0

    signal, null = [], []
    for draw in range(1, draws + 1):
        kept = F.pmod(F.xxhash64(F.lit(13), F.lit(draw), F.col("id")), F.lit(1 << 20)) < int(share * (1 << 20))
        ids = sorted(r.id for r in df.where(kept).select("id").collect())
        signal.append(f1({r[0]: int(r[1]) for r in rows}, ids))
        null.append(f1({x: shuffled[draw, x] for x in range(60)}, ids))
    diff = np.array(signal) - np.array(null)
    assert got.signal_mean == pytest.approx(np.mean(signal)) and got.null_mean == pytest.approx(np.mean(null))
    assert got.diff_low == pytest.approx(np.percentile(diff, 2.5)) and got.diff_high == pytest.approx(np.percentile(diff, 97.5))
    assert got.p_positive == pytest.approx((diff > 0).mean()) and got.signal_mean > 0.7 and got.useful == (np.percentile(diff, 2.5) > 0)


def test_probes_equal_a_plain_model(spark):
    from loomtrail.operators import weights as W

    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(80, 2)).astype(float)
    y = (x[:, 0] + rng.normal(size=80) > 2.5).astype(int)
    df = spark.createDataFrame([(k, float(x[k, 0]), float(x[k, 1]), int(y[k])) for k in range(80)] + [(99, 1.0, 1.0, None)], "id long, a double, b double, y int")
    fold = {r[0]: r[1] for r in df.select("id", F.pmod(F.xxhash64(F.lit(17), F.col("id")), F.lit(4))).collect()}
    f = np.array([fold[k] for k in range(80)])

    def predict(train, test, columns):
        z, w = np.c_[x[:, columns], np.ones(80)], np.zeros(len(columns) + 1)
        penalty = np.diag([1.0] * len(columns) + [0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= np.linalg.solve(z[train].T * (p * (1 - p)) @ z[train] + penalty, z[train].T @ (p - y[train]) + penalty @ w)
        return (z[test] @ w > 0).astype(int)

    want = {c: np.mean([(predict(f != k, f == k, c) == y[f == k]).mean() for k in range(4)]) for c in ((0, 1), (1,))}
    got = W.cross_validated(df, ["a", "b"], "y", "id", 4).first()
    base = max(y.mean(), 1 - y.mean())
    assert (got.n, got.skipped) == (80, 1) and got.accuracy == pytest.approx(want[0, 1]) and got.majority == pytest.approx(base)
    assert got.lift == pytest.approx((want[0, 1] - base) / (1 - base)) and [c for c, _ in W.ranked_columns(df, ["b", "a"], "y")] == ["a", "b"]
    dropped = {r.dropped: r.accuracy for r in W.ablation(df, ["a", "b"], "y", "id", [0, 1, 5], 4).collect()}
    assert dropped == pytest.approx({0: want[0, 1], 1: want[(1,)], 5: want[(1,)]})
    for few in (df.where("y = 1"), df.limit(3), df.limit(0)):
        assert W.cross_validated(few, ["a"], "y", "id", 4).first().accuracy is None
