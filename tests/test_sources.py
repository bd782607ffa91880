import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtrail.sources import formats, sessions


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_sessions(spark, tmp_path):
    tool = lambda name, **k: {"type": "tool_use", "name": name, "input": k}
    write(tmp_path / "p/a.jsonl", [
        {"type": "user", "sessionId": "S1", "cwd": "/w", "timestamp": "t1", "message": {"content": " fix it "}},
        "not json",
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "message": {"content": "<command-name>x"}},
        {"type": "assistant", "timestamp": "t2", "message": {"content": [{"type": "text", "text": "ok"}, tool("Read", file_path="/w/a.py"), tool("Bash", command="pytest -q"), tool("Bash", command="ls"), tool("Edit", file_path="/w/a.py", old_string="a", new_string="b" * 3000), tool("Grep", pattern="foo", path="/w"), tool("Task", q=1)]}},
        {"type": "user", "timestamp": "t3", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_result"}, {"type": "text", "text": "two"}]}},
    ])
    write(tmp_path / "p/empty.jsonl", [{"type": "assistant", "message": {"content": "plain"}}])
    rows = sessions.read_sessions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.type for r in rows] == ["prompt", "read", "test", "run", "edit", "search", "other", "prompt"]
    assert {r.instance_id for r in rows} == {"session-S1"} and {r.cwd for r in rows} == {"/w"}
    assert rows[0].details["text"] == "fix it" and rows[7].details["text"] == "one\ntwo" and rows[7].ts == "t3"
    assert len(rows[4].details["after_content"]) == 2000 and rows[5].details["query"] == "foo" and json.loads(rows[6].details["input"]) == {"q": 1}
    record = sessions.records(sessions.read_sessions(spark, str(tmp_path))).first()
    assert len(record.events) == 8 and [p.text for p in record.prompts] == ["fix it", "one\ntwo"]


def test_trajectories(spark, tmp_path):
    (tmp_path / "org__repo-12.traj").write_text(json.dumps({"history": [{"role": "system", "content": "s"}, {"role": "user", "content": "task"}, {"role": "user", "content": "later"}], "trajectory": [{"action": "open a.py"}, {"action": "str_replace_editor view /x/y.py"}, {"action": "python -m pytest"}, {"action": "submit"}, {"action": ""}], "replay_config": json.dumps({"env": {"repo": {"base_commit": "abc"}}})}))
    (tmp_path / "b.traj").write_text(json.dumps({"history": [{"role": "assistant", "action": "ls -l"}]}))
    (tmp_path / "bad.traj").write_text("{")
    rows = sessions.read_trajectories(spark, str(tmp_path)).orderBy("instance_id", "pos").collect()
    assert [(r.instance_id, r.type) for r in rows] == [("b", "search")] + [("org__repo-12", t) for t in ("prompt", "read", "read", "test", "other", "other")]
    assert rows[1].repo == "org/repo" and rows[1].base_commit == "abc" and rows[3].details["file_path"] == "/x/y.py"


def test_tool_calls(spark, tmp_path):
    call = lambda name, **k: {"function": {"name": name, "arguments": json.dumps(k)}}
    write(tmp_path / "x.jsonl", [{"instance_id": "o__r-1", "trajectory": [{"role": "user", "content": " "}, {"role": "user", "content": "go"}, {"role": "assistant", "tool_calls": [call("execute_bash", command="grep x"), call("str_replace_editor", command="create", path="/a.py"), call("finish")]}]}, {"id": "none", "history": []}])
    rows = sessions.read_tool_calls(spark, str(tmp_path / "x.jsonl")).orderBy("pos").collect()
    assert [(r.instance_id, r.repo, r.type) for r in rows] == [("o__r-1", "o/r", t) for t in ("prompt", "search", "edit", "other")]


def test_classifiers(spark):
    cases = {"": "other", "pytest x": "test", "python run_tests.py": "test", "grep a": "search", "tools x": "search", "cat f": "read", "echo hi": "run", "global y": "search"}
    df = spark.createDataFrame(list(cases.items()), "c string, want string")
    assert df.where(sessions.classify_command(F.col("c")) != F.col("want")).count() == 0
    chat = spark.createDataFrame([("edit_file", "{}", "edit"), ("run_terminal_cmd", '{"command": "cat x"}', "read"), ("bash", None, "run"), ("zzz", None, "other"), (None, None, "other")], "n string, a string, want string")
    assert chat.where(sessions.classify_chat_tool(F.col("n"), F.col("a")) != F.col("want")).count() == 0


PATCH = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@
 keep
-old
+new
+more
diff --git a/y.md b/y.md
@@ -1 +1 @@
-z
"""


def test_patches(spark):
    out = spark.createDataFrame([("p", PATCH), ("q", None)], "id string, patch string").mapInPandas(sessions.parse_patches, sessions.PATCH_DDL).orderBy("file_no").collect()
    assert [tuple(r)[2:] for r in out] == [("x.py", "keep\nold", "keep\nnew\nmore", 2, 1), ("y.md", "z", "", 0, 1)]


RECORDS = [("a", "ré", [1, 2], {"k": "v"}), ("b", None, [], None)]
SCHEMA = "id string, text string, xs array<bigint>, m map<string,string>"


@pytest.mark.parametrize("suffix", ["jsonl", "jsonl.gz", "parquet"])
def test_round_trip(spark, tmp_path, suffix):
    df, path = spark.createDataFrame(RECORDS, SCHEMA), str(tmp_path / f"out.{suffix}")
    formats.export(df, path)
    back = formats.load(spark, path, schema=None if suffix == "parquet" else SCHEMA)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_other_formats(spark, tmp_path):
    import zstandard

    objects = [{"id": "a", "n": -5, "x": [1.5, None, True], "big": 1 << 40}, {"id": "ü" * 300, "n": 200, "x": []}]
    assert [formats.unmsgpack(formats.msgpack(o))[0] for o in objects] == objects
    (tmp_path / "a.msgpack").write_bytes(b"".join(map(formats.msgpack, objects)))
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, objects)).encode()))
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, objects)).encode()))
    for name in ("a.msgpack", "a.jsonl.zst", "a.jsonl.gz"):
        assert sorted((r.id, r.n) for r in formats.load(spark, str(tmp_path / name), schema="id string, n bigint").collect()) == sorted((o["id"], o["n"]) for o in objects)
    with pytest.raises(ValueError):
        formats.infer_format("x.txt")


def test_strict_export_and_sidecar(spark, tmp_path):
    bad = spark.createDataFrame([("x", "mail a.b@example.org")], "id string, text string")
    assert formats.export_strict(bad, str(tmp_path / "no.jsonl"))["email"] == 1 and not (tmp_path / "no.jsonl").exists()
    good = bad.limit(0)
    formats.export_strict(good, str(tmp_path / "yes.jsonl"))
    assert (tmp_path / "yes.jsonl").exists()
    assert json.loads(formats.sidecar(bad, "src", {"redact": ["secret"]}))["params"] == {"redact": 1}
    assert isinstance(formats.dataset_card("n", bad)["recordSet"], list) and isinstance(pd.DataFrame(), pd.DataFrame)


@pytest.mark.parametrize("kind", ["jsonl", "jsonl.gz", "jsonl.zst", "msgpack", "parquet"])
def test_export_of_each_format_replaces_what_was_there(spark, tmp_path, kind):
    schema = "id string, n long, events array<struct<type: string, x: double>>, note string"
    rows = [("a", 1, [("run", 0.5), ("é", None)], None), ("b", -7, [], "line\\nbreak"), ("c", None, None, "")]
    path = str(tmp_path / f"out.{kind}")
    df = spark.createDataFrame(rows, schema).repartition(2)
    for many in (1, 2):
        formats.export(df if many == 2 else df.limit(1), path)
        back = formats.load(spark, path, schema=None if kind == "parquet" else schema)
        assert back.count() == (3 if many == 2 else 1)
    plain = lambda r: (r.id, r.n, [(e.type, e.x) for e in r.events] if r.events is not None else None, r.note)
    assert sorted(map(plain, back.collect()), key=str) == sorted(rows, key=str)
    bad = spark.createDataFrame([(1,)], "x int").select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        formats.export(bad, path)
    assert formats.load(spark, path, schema=None if kind == "parquet" else schema).count() == 3
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".old")] == []


def test_text_dumps_and_layouts(spark, tmp_path):
    import json
    import sqlite3

    from loomtrail.sources import chat_store as S
    from loomtrail.sources import loaders as L

    d = tmp_path / "dump"
    d.mkdir()
    (d / "conversations_raw.txt").write_text(json.dumps({"conversations": [{"id": "c1", "messages": [{"role": "user", "content": "hi"}, 7, {"role": "ai", "content": "x" * 9}]}, {"id": 2}, "no"]}))
    (d / "prompts_raw.txt").write_text('{"text": "first", "context": [1]}\n{"prompt": "second"}\n')
    (d / "workspace_w1.txt").write_text(json.dumps([{"prompt": "p", "messages": []}, {"messages": [{"content": None}]}, {"other": 1}, 3]))
    (d / "workspace_w2.txt").write_text("not json")
    (d / "workspace_w3.txt").write_text("")
    (d / "readme.txt").write_text("[]")
    got = [tuple(r) for r in S.read_store(spark, str(d)).select("session", "pos", "type", "text", "role", "conversation").orderBy("session", "pos").collect()]
    assert got == [
        ("global", 1, "prompt", "first", "user", None), ("global", 2, "prompt", "second", "user", None), ("global", 3, "prompt", "hi", "user", "c1"), ("global", 4, "other", "x" * 9, "ai", "c1"),
        ("w1", 1, "prompt", "p", "user", None), ("w1", 2, "other", "None", "unknown", ""),
    ]
    assert {r.text for r in S.read_dumps(spark, str(d), 3).where("type = 'other' AND session = 'global'").collect()} == {"xxx"}
    for place in ("user/globalStorage", "user/workspaceStorage/b", "user/workspaceStorage/a"):
        (tmp_path / place).mkdir(parents=True)
        con = sqlite3.connect(tmp_path / place / "state.vscdb")
        con.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        con.execute("INSERT INTO cursorDiskKV VALUES ('composerData:c', '{}'), ('bubbleId:c:1', '{\"text\": \"t\"}')")
        con.commit()
        con.close()
    kind, files = S.store_layout(str(tmp_path / "user"))
    assert kind == "sqlite" and [f.split("/")[-2] for f in files] == ["globalStorage", "a", "b"]
    assert S.store_layout(files[0]) == ("sqlite", [files[0]]) and S.read_store(spark, str(tmp_path / "user")).where("id = '1'").count() == 3
    with pytest.raises(FileNotFoundError):
        S.store_layout(str(tmp_path / "none"))
    assert L.loader("chat_store") is S.read_store and L.loader("mbpp")(spark.createDataFrame([("1", "t", "c")], "task_id string, text string, code string")).count() == 1
    with pytest.raises(ValueError):
        L.loader("other")
