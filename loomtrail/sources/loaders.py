"""Loaders of results and records that other tools wrote: distance matrices, labels, chat trajectories, filters, names of outputs."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import NESTED_KEY, flatten, infer_format, load

EVENT_TYPES = ("prompt", "edit", "read", "search", "run", "test", "other")  # Fixed values: the types of events.


def load_matrices(spark: SparkSession, path: str) -> DataFrame:
    """i, j, name, d with i < j: distances in long form, never as a dense matrix.

    parquet: columns i, j and a column d_<name> for each representation, of one triangle or both. npz and json: square arrays by name
    (or D_<name>), as they fit in memory where they were made."""
    if path.rstrip("/").endswith(".parquet"):
        wide = spark.read.parquet(path)
        names = [c for c in wide.columns if c.startswith("d_")]
        long = wide.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("name"), F.col(f"`{c}`").cast("double").alias("d")) for c in names])).alias("s"))
        return long.where("i <> j").select("i", "j", "s.name", "s.d").dropDuplicates(["i", "j", "name"])
    if path.endswith(".npz"):
        import numpy as np

        with np.load(path) as held:
            arrays = {k: held[k] for k in held.files}
    elif path.endswith(".json"):
        with open(path) as f:
            arrays = json.load(f)
    else:
        raise ValueError(f"distances are read from parquet, npz or json: {path}")
    rows = [(i, j, k.removeprefix("D_"), float(m[i][j])) for k, m in arrays.items() for i in range(len(m)) for j in range(i + 1, len(m))]
    return spark.createDataFrame(rows, "i long, j long, name string, d double")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """All columns and `label_value`: of a table, the column stratum, else label, else the last; of json lines, the first of stratum, label and instance_id that a record has."""
    rows = load(spark, path)
    if infer_format(path) == "parquet":
        name = next((c for c in ("stratum", "label") if c in rows.columns), rows.columns[-1])
        return rows.withColumn("label_value", F.col(f"`{name}`").cast("string"))
    there = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("stratum", "label", "instance_id") if c in rows.columns]
    return rows.withColumn("label_value", F.coalesce(*there, F.lit("")))


def filter_records(records: DataFrame, least_events: int = 0, workspace: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records with enough events, of one workspace, whose first event with a time lies in [since, until]; bounds are ISO strings, or null for none."""
    out = records.where(F.coalesce(F.size("events"), F.lit(0)) >= least_events) if least_events else records
    if workspace is not None:
        out = out.where(F.col("workspace") == workspace)
    if since is not None or until is not None:
        first = F.array_min(F.filter(F.transform("events", lambda e: F.try_to_timestamp(e["timestamp"].cast("string"))), lambda t: t.isNotNull()))
        out = out.where((first >= F.lit(since).cast("timestamp") if since is not None else F.lit(True)) & (first <= F.lit(until).cast("timestamp") if until is not None else F.lit(True)))
    return out


def parse_types(spec: str) -> set[str]:
    """A comma-separated list of event types; `tools` is all but prompts, and the older type code_change is allowed."""
    names = set(EVENT_TYPES) - {"prompt"} if spec == "tools" else {x for x in spec.split(",")}
    if unknown := names - set(EVENT_TYPES) - {"code_change"}:
        raise ValueError(f"unknown event types: {', '.join(sorted(unknown))}; there are {', '.join(EVENT_TYPES)}")
    return names


def derived_name(path: str, anonymised: bool = False, types: str | None = None, compact: bool = False, interval: str | None = None) -> str:
    """The name of what is made from a file: its stem, marks in a fixed order, and jsonl."""
    folder, _, name = path.rpartition("/")
    stem = next((name[: -len(s)] for s in (".jsonl.gz", ".jsonl.zst", ".jsonl", ".parquet", ".msgpack") if name.endswith(s)), name)
    marks = [m for m in ("anon" if anonymised else "", (types or "").replace(",", "-"), "compact" if compact else "") if m]
    if interval:
        marks.append(interval.replace("..", "-").strip("-") or "window")
    return (folder + "/" if folder else "") + ".".join([stem, *marks, "jsonl"])


def push_report(df: DataFrame, target: str, private: bool = True) -> str:
    """What an upload would hold: rows, columns and those that are encoded as JSON. Nothing is sent."""
    flat = flatten(df)
    nested = [f.name for f in flat.schema.fields if NESTED_KEY in f.metadata]
    columns = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in flat.schema.fields)
    return f"dry run: {df.count()} rows -> {target} (private={private}); columns: {columns}" + (f" (JSON-encoded columns: {', '.join(nested)})" if nested else "")


def chat_events(messages: Column) -> Column:
    """array<struct<type, text>> of messages (role, content): users prompt, tools observe; of an assistant, its commands in fenced blocks, and what it says besides."""
    from ..functions.classify import fenced_commands

    event = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    said = lambda m: F.trim(F.regexp_replace(m["content"], r"(?s)```(?:bash|sh|shell)?\n.*?```", ""))
    none = F.array().cast("array<struct<type:string,text:string>>")

    def one(m: Column) -> Column:
        commands = F.transform(fenced_commands(m["content"]), lambda c: event("terminal_command", c))
        thought = F.when(said(m) != "", F.array(event("model_reasoning", said(m)))).otherwise(none)
        return F.when(m["role"].isin("user", "human", "system"), F.array(event("prompt", m["content"]))).when(m["role"].isin("tool", "observation", "environment"), F.array(event("observation", m["content"]))).otherwise(F.concat(thought, commands))

    return F.flatten(F.transform(F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != ""), one))


def before_after_events(before: Column, after: Column, prompt: Column, file: Column) -> Column:
    """array<struct<type, text, file_path, before, after>> of a task of code: its prompt, then one edit from the given to the accepted code."""
    none = F.lit(None).cast("string")
    fields = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("type", "text", "file_path", "before", "after"), strict=True)])
    return F.array_compact(
        F.array(
            F.when(F.coalesce(prompt, F.lit("")) != "", fields(F.lit("prompt"), prompt, none, none, none)),
            F.when(F.coalesce(after, F.lit("")) != "", fields(F.lit("edit"), none, file, F.coalesce(before, F.lit("")), after)),
        )
    )


#: Layouts of sets of code tasks: where their prompt, given code, accepted code and file name lie.
CODE_TASKS = {
    "humaneval": ("prompt", "prompt", "canonical_solution", "entry_point"),
    "mbpp": ("text", None, "code", "task_id"),
    "bigcodebench": ("instruct_prompt", "code_prompt", "canonical_solution", "task_id"),
    "livecodebench": ("question_content", "starter_code", "solution", "question_id"),
}


def code_task_traces(tasks: DataFrame, layout: str) -> DataFrame:
    """instance_id, events from a table of code tasks of a known layout; columns that it lacks count as empty."""
    if layout not in CODE_TASKS:
        raise ValueError(f"unknown layout: {layout}; there are {', '.join(sorted(CODE_TASKS))}")
    prompt, before, after, name = CODE_TASKS[layout]
    column = lambda c: F.col(f"`{c}`").cast("string") if c in tasks.columns else F.lit(None).cast("string")
    return tasks.select(column(name).alias("instance_id"), before_after_events(column(before), column(after), column(prompt), F.concat(column(name), F.lit(".py"))).alias("events"))


def export_sessions(records: DataFrame, path: str, id_: str = "instance_id") -> None:
    """A folder for each session with its events as JSON lines, in order, for an index of texts."""
    events = records.select(F.col(id_).alias("session"), F.posexplode("events").alias("pos", "event")).select("session", "pos", "event.*")
    events.repartition("session").sortWithinPartitions("session", "pos").write.partitionBy("session").mode("overwrite").json(path)


def loader(name: str):
    """The reader of a kind of records, called with (spark, path); the layouts of code tasks take a table instead. Unknown names are an error."""
    from . import chat_store, formats, sessions

    readers = {"sessions": sessions.read_sessions, "trajectories": sessions.read_trajectories, "tool_calls": sessions.read_tool_calls, "chat_store": chat_store.read_store, "records": formats.load}
    readers |= {layout: functools.partial(code_task_traces, layout=layout) for layout in CODE_TASKS}
    if name not in readers:
        raise ValueError(f"unknown loader: {name}; there are {', '.join(sorted(readers))}")
    return readers[name]
