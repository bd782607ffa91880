"""Chat stores in SQLite files, and other records that become traces."""

from __future__ import annotations

import functools
import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_key_values(spark: SparkSession, path: str, name: str = "cursorDiskKV") -> DataFrame:
    """key, value of one SQLite table, opened read-only on the driver; empty if the table is not there."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        there = con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (name,)).fetchone()
        rows = [(k, v.decode() if isinstance(v, bytes) else v) for k, v in con.execute(f'SELECT key, value FROM "{name}"')] if there else []
    finally:
        con.close()
    return spark.createDataFrame(rows, "key string, value string")


def ordered_bubbles(kv: DataFrame) -> DataFrame:
    """composer, pos, bubble (JSON): those of a composer's header list first, in its order, then the rest by creation.

    Composers without bubbles come with a null bubble; values that are not JSON are passed over."""
    good = kv.where(F.try_parse_json("value").isNotNull())
    part = F.split("key", ":")
    composers = good.where(F.col("key").startswith("composerData:")).select(
        F.regexp_extract("key", r"^composerData:(.*)$", 1).alias("composer"), F.from_json(F.get_json_object("value", "$.fullConversationHeadersOnly"), "array<struct<bubbleId:string>>").alias("heads"), F.get_json_object("value", "$.text").alias("first_text")
    )
    bubbles = good.where(F.col("key").startswith("bubbleId:") & (F.size(part) == 3)).select(part[1].alias("composer"), part[2].alias("id"), F.col("value").alias("bubble"), F.coalesce(F.get_json_object("value", "$.createdAt"), F.lit("")).alias("created"))
    heads = composers.select("composer", F.posexplode("heads").alias("at", "h")).select("composer", F.col("h.bubbleId").alias("id"), "at").groupBy("composer", "id").agg(F.min("at").alias("at"))
    placed = bubbles.join(heads, ["composer", "id"], "left")
    order = Window.partitionBy("composer").orderBy(F.col("at").asc_nulls_last(), "created", "id")
    return composers.select("composer", "first_text").join(placed, "composer", "full_outer").select("composer", "first_text", F.when(F.col("id").isNotNull(), F.row_number().over(order)).alias("pos"), "id", "bubble")


def patch_events(instances: DataFrame) -> DataFrame:
    """instance_id, pos, type, details of benchmark instances: the problem first, then a change per file of `patch` and of `test_patch`."""
    from .sessions import PATCH_DDL, parse_patches

    files = lambda c, mark: instances.where(F.col(c).isNotNull()).select("instance_id", c).mapInPandas(parse_patches, PATCH_DDL).withColumns({"part": F.lit(1 if c == "patch" else 2), "mark": F.lit(mark)})
    changes = files("patch", "").unionByName(files("test_patch", "test "))
    summary = F.concat("mark", F.lit("+"), F.col("added").cast("string"), F.lit(", -"), F.col("removed").cast("string"))
    details = F.create_map(*[x for k, c in {"file_path": "file_path", "before_content": "before", "after_content": "after", "lines_added": "added", "lines_removed": "removed"}.items() for x in (F.lit(k), F.col(c).cast("string"))], F.lit("diff_summary"), summary)
    prompts = instances.where(F.coalesce("problem_statement", F.lit("")) != "").select("instance_id", F.lit(0).alias("part"), F.lit(0).alias("file_no"), F.lit("prompt").alias("type"), F.create_map(F.lit("text"), F.col("problem_statement"), F.lit("content"), F.col("problem_statement")).alias("details"))
    rows = prompts.unionByName(changes.select(F.col("id").alias("instance_id"), "part", "file_no", F.lit("code_change").alias("type"), details.alias("details")))
    return rows.select("instance_id", F.row_number().over(Window.partitionBy("instance_id").orderBy("part", "file_no")).alias("pos"), "type", "details")


def to_json_value(text: str) -> object:
    """A text as one JSON value, else as one value a line, else None."""
    text = text.strip()
    try:
        return json.loads(text) if text else None
    except ValueError:
        try:
            values = [json.loads(x) for x in text.split("\n") if x.strip()]
        except ValueError:
            return None
        return values if len(values) > 1 else values[0]


DUMP_DDL = "session string, part int, pos int, type string, text string, role string, conversation string, context string"


def _dumped(most_chars: int):
    def text_of(prompt: dict) -> str:
        return str(prompt.get("text") or prompt.get("prompt") or "")

    def one(path: str, raw: str):
        name = path.rsplit("/", 1)[-1].removesuffix(".txt")
        value = to_json_value(raw or "")
        if name.startswith("workspace_"):
            items, session = value if isinstance(value, list) else [], name.replace("workspace_", "")
        else:
            items, session = value.get("conversations", [value]) if isinstance(value, dict) else value if isinstance(value, list) else [], "global"
        items = [x for x in items or [] if isinstance(x, dict)]
        asks = {"prompts_raw": items, "conversations_raw": []}.get(name, [x for x in items if "prompt" in x or "text" in x])
        talks = {"prompts_raw": [], "conversations_raw": items}.get(name, [x for x in items if "messages" in x and not ("prompt" in x or "text" in x)])
        rows = [(0, "prompt", text_of(x), "user", None, json.dumps(x["context"]) if "context" in x else None) for x in asks]
        for talk in talks:
            for m in talk.get("messages") or []:
                if isinstance(m, dict):
                    role, text = str(m.get("role", "unknown")), str(m.get("content", ""))[:most_chars]
                    rows.append((1, "prompt" if role == "user" else "other", text, role, str(talk.get("id", "")), None))
        return [(session, part, pos, *rest) for pos, (part, *rest) in enumerate(rows)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for path, raw in zip(f["path"], f["value"], strict=True) for r in one(path, raw)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DUMP_DDL.split(", ")])

    return run


def read_dumps(spark: SparkSession, folder: str, most_chars: int = 4000) -> DataFrame:
    """session, pos, type, text, role, conversation, context of a folder of text dumps: `prompts_raw.txt` and `conversations_raw.txt` are the session
    `global`, each `workspace_NAME.txt` is the session NAME.

    A dump is one JSON value, or one a line; prompts come first, then messages, cut to `most_chars` as the model does. Files that
    can't be parsed, and items that are no objects, are passed over. A file is read into one row."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "{prompts_raw,conversations_raw,workspace_*}.txt").text(folder).select(F.input_file_name().alias("path"), "value")
    order = Window.partitionBy("session").orderBy("part", "pos")
    return files.mapInPandas(_dumped(most_chars), DUMP_DDL).withColumn("pos", F.row_number().over(order)).drop("part")


def store_layout(path: str) -> tuple[str, list[str]]:
    """(`sqlite`, its files) for a store file, a user folder or a folder of store files; (`dumps`, [folder]) for any other folder.

    Of a user folder the global store comes first, then those of the workspaces in order. A path that is not there is an error."""
    place = Path(path).expanduser()
    if place.is_file() and place.suffix == ".vscdb":
        return "sqlite", [str(place)]
    if not place.is_dir():
        raise FileNotFoundError(f"no chat store at {path}")
    stores = [*place.glob("globalStorage/state.vscdb"), *sorted(place.glob("workspaceStorage/*/state.vscdb"))] or sorted(place.glob("*.vscdb"))
    return ("sqlite", [str(s) for s in stores]) if stores else ("dumps", [str(place)])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A chat store of any layout: the rows of `read_dumps`, or store, composer, pos, id, bubble of each SQLite file.

    SQLite files are read on the driver, so a store must fit there; they are files of one user's machine."""
    kind, places = store_layout(path)
    if kind == "dumps":
        return read_dumps(spark, places[0])
    parts = [ordered_bubbles(read_key_values(spark, p)).withColumn("store", F.lit(p)) for p in places]
    return functools.reduce(DataFrame.unionByName, parts).select("store", "composer", "first_text", "pos", "id", "bubble")
