"""Sessions of several record formats as atoms of one alphabet: a row an atom, without a shuffle."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _PATH, action_atom, file_type

# Stages of a log, as its headers name them in lower case, and their atoms.
STAGE_ATOMS: dict[str, str] = {
    "localize to suspicious files": "FIND_FILE",
    "model predicted suspicious files": "FIND_FILE",
    "model predicted irrelevant folders": "FIND_FILE",
    "embedding retrieval files": "FIND_FILE",
    "localize to related elements": "SEARCH",
    "localize to edit locations": "NAV_SRC_PY",
    "repair sample 1": "EDIT_SRC_PY",
    "repair sample 2": "EDIT_SRC_PY",
    "repair sample 3": "EDIT_SRC_PY",
    "repair sample 4": "EDIT_SRC_PY",
    "regression test selection": "RUN_PYTHON_TEST_PY",
    "reproduction test generation": "RUN_PYTHON_REPRO_PY",
}

# Last part of the class name of a step's arguments, and its atom.
CLASS_ATOMS: dict[str, str] = {
    "StringReplaceArgs": "EDIT_SRC_PY",
    "AppendStringArgs": "EDIT_SRC_PY",
    "CreateFileArgs": "EDIT_SRC_PY",
    "ApplyChangeArgs": "EDIT_SRC_PY",
    "SemanticSearchArgs": "SEARCH",
    "FindClassArgs": "SEARCH",
    "FindFunctionArgs": "SEARCH",
    "FindCodeSnippetArgs": "SEARCH",
    "ViewCodeArgs": "OPEN_SRC_PY",
    "RequestMoreContextArgs": "OPEN_SRC_PY",
    "ListFilesArgs": "FIND_FILE",
    "RunTestsArgs": "RUN_PYTHON_TEST_PY",
    "VerifiedFinishArgs": "SUBMIT",
    "FinishArgs": "SUBMIT",
    "RejectArgs": "SUBMIT",
}

# Names of the formats.
TRAJECTORY, MESSAGES, LOG, TREE = "sweagent_traj_subdir", "dars_traj_list", "agentless_log_text", "moatless_trajectory_json"

_STEP = "array<struct<action:string,state:string>>"


def editor_atom(action: Column) -> Column:
    """The atom of a call of the editor tool, `str_replace_editor COMMAND [PATH]`; OTHER for other commands and for no such call."""
    call = r"^\s*str_replace_editor\s+(\w+)(?:\s+(\S+))?"
    command, target = F.lower(F.regexp_extract(action, call, 1)), F.regexp_extract(action, call, 2)
    found = F.regexp_extract(target, _PATH, 1)
    kind = F.when(target == "", "UNKNOWN").otherwise(file_type(F.when(found != "", found).otherwise(target)))
    edit = F.when(kind == "UNKNOWN", "EDIT").otherwise(F.concat(F.lit("EDIT_"), kind))
    return F.when(command == "view", F.concat(F.lit("OPEN_"), kind)).when(command == "create", F.concat(F.lit("CREATE_"), kind)).when(command.isin("str_replace", "insert", "undo_edit"), edit).otherwise("OTHER")


def step_atom(bare: Column, action: Column, state: Column) -> Column:
    """The atom of a step of a trajectory from its action's own one: bare EDIT and NAV by the file that is open, editor calls by their command, other unknown ones OTHER."""
    open_file = F.get_json_object(state, "$.open_file")
    typed = F.when(bare.isin("EDIT", "NAV") & (open_file != "") & (open_file != "n/a"), F.concat(bare, F.lit("_"), file_type(open_file)))
    return F.coalesce(typed, F.when(bare == "UNKNOWN_STR_REPLACE_EDITOR", editor_atom(action)).when(bare.startswith("UNKNOWN_"), "OTHER").otherwise(bare))


def message_atom(bare: Column, action: Column) -> Column:
    """The atom of an assistant's action from its own one; two verbs stand for a search and an edit."""
    verb = F.lower(F.regexp_extract(action, r"^\s*(\S+)", 1))
    return F.when(verb == "search_repo", "SEARCH").when(verb == "append", "EDIT").otherwise(bare)


def log_atoms(content: Column) -> Column:
    """array of the atoms of known stage headers in order, and SUBMIT if there is one."""
    stages = F.create_map(*[F.lit(x) for kv in STAGE_ATOMS.items() for x in kv])
    found = F.transform(F.regexp_extract_all(content, F.lit(r"(?md)^### (.+)$"), 1), lambda h: F.try_element_at(stages, F.lower(F.regexp_replace(h, r"^\s+|\s+$", ""))))
    known = F.filter(found, lambda a: a.isNotNull())
    return F.when(F.size(known) > 0, F.array_append(known, F.lit("SUBMIT"))).otherwise(known)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tree_classes(content: pd.Series) -> pd.Series:
    """Names of the steps of a JSON tree: those of its list `actions`, then of each node under `root`, depth first. Not recursive, so any depth."""

    def name(step) -> str | None:
        if not isinstance(step, dict):
            return None
        action = step.get("action") or {}
        if not isinstance(action, dict):
            return None
        return str(action.get("action_args_class") or action.get("action_name") or action.get("name") or "").rpartition(".")[2]

    def one(text):
        try:
            record = json.loads(text) if text else None
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return []
        steps, stack = list(record.get("actions") or []), [record.get("root")]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                steps += node.get("action_steps") or []
                stack += reversed(node.get("children") or [])
        return [n for n in map(name, steps) if n is not None]

    return content.map(one)


def canonical_atoms(records: DataFrame, id_: str = "id", format_: str = "format", content: str = "content") -> DataFrame:
    """id, pos, atom: a row for each step of a record, from 1.

    `content` is JSON, or the text of a log. A null format is a trajectory if the content has one; unknown formats, null content
    and content that can't be parsed give no rows. Records whose id repeats keep their own positions."""
    kind, body = F.col(format_), F.col(content)
    of = lambda k: F.when(kind == k, body)
    trajectory = F.when((kind == TRAJECTORY) | kind.isNull(), F.from_json(F.get_json_object(body, "$.trajectory"), _STEP))
    messages = F.filter(F.from_json(of(MESSAGES), "array<struct<role:string,action:string>>"), lambda m: (m["role"] == "assistant") & (F.trim(F.coalesce(m["action"], F.lit(""))) != ""))
    classes = F.create_map(*[F.lit(x) for kv in CLASS_ATOMS.items() for x in kv])
    as_step = lambda action, state, atom: F.struct(action.alias("action"), state.alias("state"), atom.alias("atom"))
    none = F.lit(None).cast("string")
    steps = (
        F.when(trajectory.isNotNull(), F.transform(trajectory, lambda s: as_step(F.coalesce(s["action"], F.lit("")), s["state"], none)))
        .when(kind == MESSAGES, F.transform(messages, lambda m: as_step(m["action"], none, none)))
        .when(kind == LOG, F.transform(log_atoms(body), lambda a: as_step(none, none, a)))
        .when(kind == TREE, F.transform(tree_classes(of(TREE)), lambda c: as_step(none, none, F.coalesce(F.try_element_at(classes, c), F.lit("OTHER")))))
    )
    rows = records.select(F.col(id_).alias("id"), kind.alias("format"), F.posexplode(steps).alias("pos", "step"))
    action, bare = F.col("step.action"), F.col("bare")
    own = rows.withColumn("bare", F.when(F.col("step.atom").isNull(), action_atom(action)))
    atom = F.coalesce(F.col("step.atom"), F.when(F.col("format") == MESSAGES, message_atom(bare, action)).otherwise(step_atom(bare, action, F.col("step.state"))))
    return own.select("id", (F.col("pos") + 1).alias("pos"), atom.alias("atom"))
