import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import classify as C
from loomtrail.sources import chat_store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_intents_and_actions(spark):
    assert one(spark, C.intents(F.col("t")), t="Fix the crash and add docs") == ["INTENT_DEBUG", "INTENT_FEATURE", "INTENT_DOCUMENT"]
    assert one(spark, C.intents(F.col("t")), t=None) == ["INTENT_OTHER"]
    for action, kind in {"edit 1:2": "EDIT", "grep x": "FIND", "goto 3": "NAV", "do submit": "SUBMIT", "pytest": "RUN", "ls": "SHELL", "zzz": "OTHER", "": "OTHER"}.items():
        assert one(spark, C.action_type(F.col("a")), a=action) == kind


def test_fences(spark):
    text = "think\n```bash\nls -l\n```\nmore\n```\n\n```"
    assert one(spark, C.fenced_commands(F.col("t")), t=text) == ["ls -l"] and one(spark, C.outside_fences(F.col("t")), t=text) == "think\n\nmore"


def test_descriptor(spark):
    df = spark.createDataFrame([({"EDIT_SRC_PY": 0.4}, 20.0), ({}, 1.2), ({"RUN_PYTHON_TEST_PY": 0.1, "SEARCH": 0.06}, 5.0)], "s map<string,double>, e double")
    assert [r[0] for r in df.select(C.descriptor(F.col("s"), F.col("e"))).collect()] == ["edit-dominated, no-test", "pipeline-template, no-test", "balanced"]


def test_where_and_intervals(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "repo string, n long")
    assert C.where(df, ["repo=null"]).count() == C.where(df, ["repo=None"]).count() == C.where(df, ["n=1", "repo=a"]).count() == 1
    assert C.where(df, ["missing=null"]).count() == 2
    with pytest.raises(ValueError):
        C.where(df, ["repo"])
    now = datetime(2024, 1, 8, tzinfo=timezone.utc)
    assert C.interval_bounds("7d", now) == ("2024-01-01T00:00:00Z", None) and C.interval_bounds("2023..") == ("2023", None) and C.interval_bounds(None) == (None, None)
    with pytest.raises(ValueError):
        C.interval_bounds("7x")
    s = spark.createDataFrame([(["2023-05", None],), ([],), (["2024"],)], "t array<string>")
    assert [r[0] for r in s.select(C.any_within(F.col("t"), "2023", "2024")).collect()] == [True, False, False]


def test_variance_and_hops(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, float(k % 2)) for k in range(20)], "x double, y double, z double")
    assert C.unique_variance(df, "y", ["x"]).first()[0] < 1e-6 and C.unique_variance(df, "z", ["x"]).first()[0] > 0.9
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert C.shortest_hops(edges, ids(1), ids(3, 4)).first()[0] == 2 and C.shortest_hops(edges, ids(1), ids(1)).first()[0] == 0 and C.shortest_hops(edges, ids(1), ids(9)).first()[0] is None


def test_chat_store(spark, tmp_path):
    path = str(tmp_path / "state.vscdb")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    rows = {"composerData:c1": {"fullConversationHeadersOnly": [{"bubbleId": "b2"}, {"bubbleId": "gone"}], "text": "hi"}, "bubbleId:c1:b1": {"createdAt": "2"}, "bubbleId:c1:b0": {"createdAt": "1"}, "bubbleId:c1:b2": {}, "composerData:c2": {}, "bubbleId:c3:x": {}}
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()] + [("bubbleId:c1:bad", "{")])
    con.commit()
    con.close()
    out = chat_store.ordered_bubbles(chat_store.read_key_values(spark, path)).orderBy("composer", "pos").collect()
    assert [(r.composer, r.id) for r in out] == [("c1", "b2"), ("c1", "b0"), ("c1", "b1"), ("c2", None), ("c3", "x")]
    assert chat_store.read_key_values(spark, path, "none").count() == 0
    assert chat_store.to_json_value('{"a": 1}\n{"b": 2}') == [{"a": 1}, {"b": 2}] and chat_store.to_json_value("{") is None and chat_store.to_json_value(" ") is None


def test_patch_events(spark):
    patch = "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+b\n"
    rows = chat_store.patch_events(spark.createDataFrame([("i", patch, patch, "do it"), ("j", None, None, "")], "instance_id string, patch string, test_patch string, problem_statement string")).orderBy("pos").collect()
    assert [r.type for r in rows] == ["prompt", "code_change", "code_change"] and rows[2].details["diff_summary"] == "test +1, -1"
