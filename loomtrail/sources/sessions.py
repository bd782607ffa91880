"""Session stores as tables of events: instance_id, cwd, pos, type, ts, details map<string, string>."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_FIELD = 2000
EVENTS = "instance_id string, repo string, base_commit string, cwd string, pos int, type string, ts string, details map<string,string>"

# The event type of each tool of a session store, and the commands that are tests.
TOOL_TYPES = {
    "Edit": "edit", "MultiEdit": "edit", "Write": "edit", "NotebookEdit": "edit", "Read": "read", "Grep": "search", "Glob": "search",
    "ToolSearch": "search", "WebSearch": "search", "Bash": "run",
}
TEST_COMMAND = r"\b(pytest|py\.test|unittest|npm +test|yarn +test|pnpm +test|go +test|cargo +test|tox)\b"
# What makes a command a test, a search or a read, looked for in this order.
TEST_MARKERS, SEARCH_MARKERS, READ_MARKERS = ("pytest", "unittest", "tox", "nosetests"), ("grep", "find ", "rg ", "locate", "ls ", "glob"), ("cat ", "head ", "tail ", "less ")
SEARCH_VERBS, READ_VERBS = ("grep", "rg", "find", "locate", "ls", "ack", "ag"), ("cat", "head", "tail", "less", "more")
CHAT_TOOLS = [
    (r"^(edit_file|search_replace|write|apply_patch|multiedit)", "edit"),
    (r"^(read_file|open_file|read_lints)", "read"),
    (r"^(ripgrep|grep|glob_file_search|codebase_search|file_search|list_dir|search)", "search"),
    (r"^(run_terminal_cmd|run_terminal_command|terminal|bash)", "run"),
]


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def classify_command(command: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(command, F.lit(""))))
    verb = F.regexp_extract(c, r"^(\S+)", 1)
    return (
        F.when(c == "", "other")
        .when(_any(c, TEST_MARKERS) | (c.contains("python") & c.contains("test")), "test")
        .when(verb.isin(*SEARCH_VERBS) | _any(c, SEARCH_MARKERS), "search")
        .when(verb.isin(*READ_VERBS) | _any(c, READ_MARKERS), "read")
        .otherwise("run")
    )


def classify_editor(sub: Column) -> Column:
    s = F.lower(F.trim(sub))
    return F.when(s == "view", "read").when(s.isin("create", "str_replace", "insert", "edit", "undo_edit"), "edit").otherwise("other")


def classify_chat_tool(name: Column, arguments: Column) -> Column:
    n, command = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(F.get_json_object(arguments, "$.command"), F.lit(""))
    out = None
    for pattern, kind in CHAT_TOOLS:
        value = F.when(command == "", "run").otherwise(classify_command(command)) if kind == "run" else F.lit(kind)
        out = F.when(n.rlike(pattern), value) if out is None else out.when(n.rlike(pattern), value)
    return out.otherwise("other")


def action_event_type(action: Column) -> Column:
    """The event type of an action string, by its first word."""
    a = F.trim(F.coalesce(action, F.lit("")))
    head, second = F.regexp_extract(a, r"^(\S+)", 1), F.regexp_extract(a, r"^\S+\s+(\S+)", 1)
    return (
        F.when(a == "", "other")
        .when(head == "str_replace_editor", classify_editor(second))
        .when(head.isin("submit", "exit", "skip"), "other")
        .when(head.isin("edit", "insert", "create"), "edit")
        .when(head.isin("open", "goto", "scroll_up", "scroll_down"), "read")
        .when(head.isin("search_dir", "search_file", "find_file"), "search")
        .otherwise(classify_command(a))
    )


def repo_of(instance_id: Column) -> Column:
    head = F.regexp_replace(instance_id, r"-[^-]*$", "")
    return F.when(head.contains("__"), F.regexp_replace(head, r"^(.*?)__", "$1/"))


def _details(**columns: Column) -> Column:
    """A map without the null values."""
    full = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def read_sessions(spark: SparkSession, path: str, prefix: str = "session-") -> DataFrame:
    """Session files of one JSON object a line: prompts of users and tool calls of assistants, in file order.

    Lines that are not JSON objects are passed over, as are meta lines and commands; sessions without events vanish."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line").startswith("{"))
    v = lines.withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    get = lambda p, kind="string", c="v": F.try_variant_get(F.col(c) if isinstance(c, str) else c, p, kind)
    w = Window.partitionBy("path").orderBy("line_no")
    whole = Window.partitionBy("path")
    rows = v.select("path", "line_no", get("$.type").alias("kind"), get("$.timestamp").alias("ts"), get("$.isMeta", "boolean").alias("meta"), F.nullif(get("$.sessionId"), F.lit("")).alias("sid"), F.nullif(get("$.cwd"), F.lit("")).alias("dir"), get("$.message.content", "array<variant>").alias("blocks"), get("$.message.content").alias("plain"))
    rows = rows.withColumns({
        "cwd": F.first("dir", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "last_line": F.max(F.when(F.col("sid").isNotNull(), F.col("line_no"))).over(whole),
    }).withColumn("session", F.coalesce(F.max(F.when(F.col("line_no") == F.col("last_line"), F.col("sid"))).over(whole), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)))
    texts = F.filter(F.transform("blocks", lambda b: F.when(get("$.type", c=b) == "text", get("$.text", c=b))), lambda t: t.isNotNull() & (t != ""))
    said = F.trim(F.when(F.col("blocks").isNotNull(), F.array_join(texts, "\n")).otherwise(F.coalesce("plain", F.lit(""))))
    cut = lambda c: F.left(c, F.lit(MAX_FIELD))
    users = (
        rows.where("kind = 'user' AND NOT coalesce(meta, false)")
        .withColumn("text", said)
        .where((F.col("text") != "") & ~F.col("text").startswith("<command-name>") & ~F.col("text").startswith("<local-command"))
        .select("session", "line_no", F.lit(0).alias("block_no"), F.lit("prompt").alias("type"), "ts", "cwd", _details(text=cut(F.col("text")), content=cut(F.col("text")), cwd=F.col("cwd")).alias("details"))
    )
    calls = rows.where("kind = 'assistant'").select("session", "line_no", "ts", "cwd", F.posexplode("blocks").alias("block_no", "b")).where(get("$.type", c="b") == "tool_use")
    kinds = F.create_map(*[F.lit(x) for kv in TOOL_TYPES.items() for x in kv])
    name = F.coalesce(get("$.name", c="b"), F.lit(""))
    arg = lambda k: F.nullif(get(f"$.input.{k}", c="b"), F.lit(""))
    calls = calls.withColumns({"tool": name, "base": F.coalesce(F.element_at(kinds, name), F.lit("other"))})
    is_ = lambda k, c: F.when(F.col("base") == k, c)
    details = _details(
        tool=F.col("tool"), cwd=F.col("cwd"),
        file_path=F.when(F.col("base") == "edit", F.coalesce(arg("file_path"), arg("notebook_path"))).when(F.col("base") == "read", arg("file_path")),
        before_content=is_("edit", cut(arg("old_string"))), after_content=is_("edit", cut(F.coalesce(arg("new_string"), arg("content"), arg("new_source")))),
        query=is_("search", cut(F.coalesce(arg("pattern"), arg("query"), F.lit("")))), path=is_("search", arg("path")),
        command=is_("run", cut(F.coalesce(arg("command"), F.lit("")))), description=is_("run", cut(arg("description"))),
        input=is_("other", cut(F.to_json(F.try_variant_get("b", "$.input", "variant")))),
    )
    kind = F.when((F.col("base") == "run") & F.coalesce(arg("command"), F.lit("")).rlike(TEST_COMMAND), "test").otherwise(F.col("base"))
    both = users.unionByName(calls.select("session", "line_no", "block_no", kind.alias("type"), "ts", "cwd", details.alias("details")))
    order = Window.partitionBy("session").orderBy("line_no", "block_no")
    return both.select(F.concat(F.lit(prefix), "session").alias("instance_id"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("base_commit"), F.last("cwd", True).over(Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("cwd"), F.row_number().over(order).alias("pos"), "type", "ts", "details")


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """.traj files: the first user message, then the actions of `trajectory`, or else those of the history. Unreadable files are passed over."""
    files = spark.read.option("pathGlobFilter", "*.traj").option("recursiveFileLookup", True).text(path, wholetext=True)
    v = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.traj$", 1).alias("instance_id"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda c, p, kind="string": F.try_variant_get(c, p, kind)
    history, steps = get(F.col("v"), "$.history", "array<variant>"), get(F.col("v"), "$.trajectory", "array<variant>")
    config = get(F.col("v"), "$.replay_config")
    v = v.select("instance_id", F.coalesce(history, F.array().cast("array<variant>")).alias("h"), F.coalesce(steps, F.array().cast("array<variant>")).alias("s"), F.nullif(F.get_json_object(config, "$.env.repo.base_commit"), F.lit("")).alias("base_commit"))
    first = F.get(F.filter("h", lambda x: get(x, "$.role") == "user"), F.lit(0))
    prompt = F.filter(F.array(get(first, "$.content")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    acted = F.filter(F.transform("h", lambda x: F.when(get(x, "$.role") == "assistant", get(x, "$.action"))), lambda a: a.isNotNull() & (a != ""))
    actions = F.when(F.size("s") > 0, F.transform("s", lambda x: F.coalesce(get(x, "$.action"), F.lit("")))).otherwise(acted)
    event = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    rows = v.select("instance_id", "base_commit", F.posexplode(F.concat(F.transform(prompt, event("prompt")), F.transform(actions, event("action")))).alias("pos", "e"))
    text = F.col("e.text")
    is_prompt = F.col("e.kind") == "prompt"
    file_path = F.when(text.startswith("str_replace_editor"), F.nullif(F.regexp_extract(text, r"^\S+\s+\S+(?:\s+\S+)*?\s+([/~]\S*)", 1), F.lit("")))
    return rows.select("instance_id", repo_of(F.col("instance_id")).alias("repo"), "base_commit", F.lit(None).cast("string").alias("cwd"), (F.col("pos") + 1).alias("pos"), F.when(is_prompt, "prompt").otherwise(action_event_type(text)).alias("type"), F.lit(None).cast("string").alias("ts"), F.when(is_prompt, _details(text=text)).otherwise(_details(command=text, file_path=file_path)).alias("details"))


def read_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """Records with role-tagged messages and tool calls, one JSON object a line; records without events vanish."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{")).select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("n")).where("v IS NOT NULL")
    get = lambda c, p, kind="string": F.try_variant_get(c, p, kind)
    v = F.col("v")
    rows = lines.select(F.coalesce(get(v, "$.instance_id"), get(v, "$.id"), F.concat(F.lit("record-"), F.col("n").cast("string"))).alias("instance_id"), get(v, "$.repo").alias("repo"), get(v, "$.base_commit").alias("base_commit"), F.coalesce(get(v, "$.trajectory", "array<variant>"), get(v, "$.history", "array<variant>")).alias("m"))
    messages = rows.select("instance_id", "repo", "base_commit", F.posexplode("m").alias("at", "x"))
    user = messages.where((get(F.col("x"), "$.role") == "user") & (F.trim(get(F.col("x"), "$.content")) != ""))
    first = user.withColumn("k", F.row_number().over(Window.partitionBy("instance_id").orderBy("at"))).where("k = 1")
    prompts = first.select("instance_id", "repo", "base_commit", "at", F.lit(0).alias("call"), F.lit("prompt").alias("type"), _details(text=get(F.col("x"), "$.content")).alias("details"))
    calls = messages.where(get(F.col("x"), "$.role") == "assistant").select("instance_id", "repo", "base_commit", "at", F.posexplode(get(F.col("x"), "$.tool_calls", "array<variant>")).alias("call", "c"))
    name, arguments = get(F.col("c"), "$.function.name"), get(F.col("c"), "$.function.arguments")
    command = F.coalesce(F.get_json_object(arguments, "$.command"), F.lit(""))
    kind = F.when(name == "str_replace_editor", classify_editor(command)).when(name == "execute_bash", classify_command(command)).otherwise("other")
    events = prompts.unionByName(calls.select("instance_id", "repo", "base_commit", "at", "call", kind.alias("type"), _details(tool=name, command=F.nullif(command, F.lit("")), file_path=F.get_json_object(arguments, "$.path"), input=F.left(arguments, F.lit(MAX_FIELD))).alias("details")))
    order = Window.partitionBy("instance_id").orderBy("at", "call")
    return events.select("instance_id", F.coalesce("repo", repo_of(F.col("instance_id"))).alias("repo"), "base_commit", F.lit(None).cast("string").alias("cwd"), F.row_number().over(order).alias("pos"), "type", F.lit(None).cast("string").alias("ts"), "details")


def records(events: DataFrame) -> DataFrame:
    """One record per trace: instance_id, repo, base_commit, cwd, events, prompts, in order."""
    rows = events.groupBy("instance_id").agg(*[F.max(c).alias(c) for c in ("repo", "base_commit", "cwd")], F.collect_list(F.struct("pos", "type", F.col("ts").alias("timestamp"), "details")).alias("e"))
    ordered = F.array_sort("e", lambda a, b: a["pos"] - b["pos"])
    plain = F.transform(ordered, lambda x: F.struct(x["type"].alias("type"), x["timestamp"].alias("timestamp"), x["details"].alias("details")))
    return rows.withColumn("events", plain).withColumn("prompts", F.transform(F.filter("events", lambda x: x["type"] == "prompt"), lambda x: F.struct(F.element_at(x["details"], "text").alias("text"), x["timestamp"].alias("timestamp")))).drop("e")


def parse_patches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, patch): id, file_no, file_path, before, after, added, removed of each file of a unified diff."""
    import re

    for frame in frames:
        out = []
        for key, patch in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
            for part in re.split(r"(?m)^(?=diff --git )", patch or ""):
                head = re.match(r"diff --git a/(.+?) b/.+", part)
                if not head:
                    continue
                before, after, added, removed, inside = [], [], 0, 0, False
                for line in part.split("\n")[1:]:
                    sign, rest = line[:1], line[1:]
                    if line.startswith("@@ "):
                        inside = True
                    elif line.startswith(("--- ", "+++ ")) or not inside:
                        continue
                    elif sign == "-" and not line.startswith("---"):
                        before.append(rest)
                        removed += 1
                    elif sign == "+" and not line.startswith("+++"):
                        after.append(rest)
                        added += 1
                    elif sign == " ":
                        before.append(rest)
                        after.append(rest)
                if before or after:
                    out.append((key, len([o for o in out if o[0] == key]), head[1], "\n".join(before), "\n".join(after), added, removed))
        yield pd.DataFrame(out, columns=["id", "file_no", "file_path", "before", "after", "added", "removed"])


PATCH_DDL = "id string, file_no int, file_path string, before string, after string, added int, removed int"
