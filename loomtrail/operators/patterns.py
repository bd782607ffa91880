"""Patterns of sessions: file switches, intents, item sets, paths in trees of steps, and usage in nested records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# When a pattern of file switches counts.
HOTSPOT_EDITS, CHASE_SWITCHES = 5, 3


def file_switch_motifs(events: DataFrame, id_: str, pos: str, file: str) -> DataFrame:
    """id, motifs: HOTSPOT_n for a file with more than 5 events, DEPENDENCY_CHASE for more than 3 switches, ITERATIVE_REFINE where
    two switches in a row have one target. Sessions of fewer than two events, or without files, have none."""
    w = Window.partitionBy(id_).orderBy(pos)
    many = events.groupBy(id_).agg(F.count("*").alias("_events"))
    named = events.where(F.coalesce(F.col(file), F.lit("")) != "").withColumn("_last", F.lag(file).over(w))
    hot = named.groupBy(id_, file).agg(F.count("*").alias("n")).groupBy(id_).agg(F.max("n").alias("_most"))
    switches = named.where(F.col("_last").isNotNull() & (F.col("_last") != F.col(file))).withColumn("_before", F.lag(file).over(w))
    moved = switches.groupBy(id_).agg(F.count("*").alias("_switches"), F.bool_or(F.coalesce(F.col("_before") == F.col(file), F.lit(False))).alias("_back"))
    motifs = F.array_compact(
        F.array(
            F.when(F.col("_most") > HOTSPOT_EDITS, F.concat(F.lit("HOTSPOT_"), F.col("_most").cast("string"))),
            F.when(F.col("_switches") > CHASE_SWITCHES, F.lit("DEPENDENCY_CHASE")),
            F.when(F.col("_back"), F.lit("ITERATIVE_REFINE")),
        )
    )
    return many.join(hot, id_, "left").join(moved, id_, "left").select(id_, F.when(F.col("_events") >= 2, motifs).otherwise(F.array().cast("array<string>")).alias("motifs"))


def intent_motifs(items: Column) -> Column:
    """Motifs of an array of items: for each INTENT_ marker what follows it, its pattern of two steps and its type; then the transitions between markers."""
    places = F.filter(F.transform(items, lambda x, i: F.when(x.startswith("INTENT_"), i)), lambda i: i.isNotNull())
    at = lambda i: F.get(items, i)
    each = F.transform(
        places,
        lambda i: F.array_compact(
            F.array(
                F.when(i + 1 < F.size(items), F.concat(at(i), F.lit("_TO_"), at(i + 1))),
                F.when(i + 2 < F.size(items), F.concat_ws("_", F.lit("INTENT_PATTERN"), at(i), at(i + 1), at(i + 2))),
                F.concat(F.lit("INTENT_TYPE_"), F.replace(at(i), F.lit("INTENT_"), F.lit(""))),
            )
        ),
    )
    names = F.filter(items, lambda x: x.startswith("INTENT_"))
    moves = F.filter(F.transform(names, lambda x, k: F.when(k + 1 < F.size(names), F.concat_ws("_", F.lit("INTENT_TRANS"), x, F.get(names, k + 1)))), lambda x: x.isNotNull())
    return F.concat(F.flatten(each), moves)


def has_pattern(items: Column, target: list[str]) -> Column:
    """Whether a set holds all of the target."""
    return F.size(F.array_except(F.array(*map(F.lit, target)), items)) == 0 if target else F.lit(True)


def assign_itemsets(certs: DataFrame, id_: str, items: str, closed: DataFrame) -> DataFrame:
    """id, itemset: the largest closed item set (items, freq) that a set holds; ties go to the greater frequency, then the smaller set in order; null without any.

    Sets meet through the rarest item of each closed set, so a record meets only sets whose rarest item it has."""
    often = closed.select(F.explode("items").alias("item"), "freq").groupBy("item").agg(F.sum("freq").alias("often"))
    rarest = closed.select("items", "freq", F.explode("items").alias("item")).join(often, "item").groupBy("items", "freq").agg(F.min_by("item", F.struct("often", "item")).alias("item"))
    own = certs.select(id_, F.col(items).alias("_own"))
    met = own.select(id_, "_own", F.explode(F.array_distinct("_own")).alias("item")).join(rarest, "item").where(F.size(F.array_except("items", "_own")) == 0)
    best = met.groupBy(id_).agg(F.min_by("items", F.struct(-F.size("items"), -F.col("freq"), "items")).alias("itemset"))
    return own.select(id_).join(best, id_, "left")


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for key, raw in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True):
            try:
                root = json.loads(raw) if raw else None
            except json.JSONDecodeError:
                root = None
            stack = [(root, [], 0)] if isinstance(root, dict) else []
            number = 0
            while stack:
                node, path, depth = stack.pop()
                steps = node.get("action_steps") or []
                action = (steps[0].get("action") or {}) if steps and isinstance(steps[0], dict) else {}
                name = action.get("action_args_class") or action.get("name") or ""
                name = str(name).rpartition(".")[2]
                path = [*path, name] if name else path
                if name:
                    rows.append((key, number, depth, name, str(action.get("thoughts") or ""), path))
                    number += 1
                stack += [(child, path, depth + 1) for child in reversed(node.get("children") or []) if isinstance(child, dict)]
        yield pd.DataFrame(rows, columns=["id", "pos", "depth", "action", "thought", "path"])


def tree_paths(records: DataFrame, id_: str, tree: str) -> DataFrame:
    """id, pos, depth, action, thought, path: nodes of a JSON tree of steps (children, action_steps), depth first, each with the actions on its way.

    Trees that are no JSON object give no rows. Iterative, so depth is not bounded by a call stack."""
    return records.select(F.col(id_).cast("string").alias("id"), F.col(tree).alias("tree")).mapInPandas(_walk, "id string, pos int, depth int, action string, thought string, path array<string>")


USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("tokens_sent", "tokens_received", "api_calls")] + [T.StructField("cost", T.DoubleType())])


@F.pandas_udf(USAGE)
def nested_usage(raw: pd.Series) -> pd.DataFrame:
    """Sums of `usage` objects and `response_cost` numbers at any depth of a JSON record; zeros where there are none."""

    def one(text):
        sent = received = calls = 0
        cost = 0.0
        try:
            stack = [json.loads(text)] if text else []
        except json.JSONDecodeError:
            stack = []
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                usage = node.get("usage")
                if isinstance(usage, dict) and ("prompt_tokens" in usage or "completion_tokens" in usage):
                    calls += 1
                    sent += int(usage.get("prompt_tokens") or 0)
                    received += int(usage.get("completion_tokens") or 0)
                if isinstance(node.get("response_cost"), (int, float)):
                    cost += float(node["response_cost"])
                stack += node.values()
            elif isinstance(node, list):
                stack += node
        return sent, received, calls, cost

    return pd.DataFrame([one(x) for x in raw], columns=["tokens_sent", "tokens_received", "api_calls", "cost"])


def motif_registry(motifs: DataFrame, pattern: str, id_: str) -> DataFrame:
    """hash, pattern, length, n, records: a row a distinct motif, with the hash that stands for it elsewhere."""
    return motifs.groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"), F.countDistinct(id_).alias("records")).select(F.concat(F.lit("M_"), F.left(F.sha1(F.col("pattern").cast("binary")), F.lit(10))).alias("hash"), "pattern", F.size(F.split("pattern", ">")).alias("length"), "n", "records")


def fp_templates(spark, sets: DataFrame, form: str, items: str, supports: tuple[float, ...]) -> DataFrame:
    """form, support, items, n, lift: frequent sets of two items or more within each form, and their share there over that in all records.

    A model for each form and support; forms are a class of the data, few values."""
    from pyspark.ml.fpm import FPGrowth

    distinct = sets.select(F.col(form).alias("form"), F.array_distinct(items).alias("items"))
    total, out = distinct.count(), None
    for (name,) in sorted(distinct.select("form").distinct().where("form IS NOT NULL").collect()):
        own = distinct.where(F.col("form") == F.lit(name))
        size = own.count()
        for support in supports:
            found = FPGrowth(itemsCol="items", minSupport=support).fit(own).freqItemsets.where(F.size("items") >= 2)
            rows = found.select(F.lit(name).alias("form"), F.lit(support).alias("support"), F.array_sort("items").alias("items"), F.col("freq").alias("n"), F.lit(size).alias("size"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "form string, support double, items array<string>, n long, lift double")
    wanted = out.select("items").distinct().withColumn("item", F.get("items", F.lit(0)))
    have = distinct.select(F.col("items").alias("own"), F.explode("items").alias("item")).join(wanted, "item").where(F.size(F.array_except("items", "own")) == 0).groupBy("items").agg(F.count("*").alias("all_n"))
    return out.join(have, "items").select("form", "support", "items", "n", ((F.col("n") / F.col("size")) / (F.col("all_n") / F.lit(total))).alias("lift"))
