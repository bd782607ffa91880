"""A content-addressed vector index that is built again only where texts changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 256


def changes(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, state: new, changed, kept or removed, by (id, sha)."""
    h = held.select("id", F.col("sha").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("sha").isNull(), "removed").when(F.col("old") == F.col("sha"), "kept").otherwise("changed")
    return h.join(wanted.select("id", "sha"), "id", "full_outer").select("id", state.alias("state"))


def build(held: DataFrame | None, records: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """id, sha, vector of all records (id, text): kept vectors are taken over, the rest is encoded in batches.

    Missing or repeated ids are refused."""
    bad = records.groupBy("id").count().where("id IS NULL OR count > 1")
    if not bad.isEmpty():
        raise ValueError("ids must be there and unique")
    keyed = records.select("id", F.sha2("text", 256).alias("sha"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), BATCH):
                some = f.iloc[k : k + BATCH]
                yield pd.DataFrame({"id": some["id"], "sha": some["sha"], "vector": encode(some["text"].tolist())})

    schema = f"id {keyed.schema['id'].dataType.simpleString()}, sha string, vector array<double>"
    if held is None:
        return keyed.mapInPandas(run, schema)
    fresh = keyed.join(held.select("id", "sha"), ["id", "sha"], "left_anti").mapInPandas(run, schema)
    return held.join(keyed.select("id", "sha"), ["id", "sha"], "left_semi").select("id", "sha", "vector").unionByName(fresh)


def lookup(index: DataFrame, records: DataFrame) -> DataFrame | None:
    """Vectors of all records, or None unless the index covers every one."""
    keyed = records.select("id", F.sha2("text", 256).alias("sha"))
    return None if not keyed.join(index, ["id", "sha"], "left_anti").isEmpty() else keyed.join(index, ["id", "sha"])
