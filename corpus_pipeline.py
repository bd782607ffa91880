"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Defined cases of all stages: a null text counts as empty, is clean, unlinked and without leaks; null ids and null sources take
part like others; rows that repeat an id and text are near copies of each other; an empty table gives an empty result;
other columns are carried along unchanged, but for those that assign_shards replaces. Names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import decontaminate, jaccard, mixing, sharding, toxicity
from loomtrail.llm.common import prepare, stored, table

N_SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The field is fitted to the labelled ones among docs."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that with the smallest doc_id (null last), of rows that repeat it any one.

    Links are between rows. Where ids are unique and not null, they tell rows apart; else rows get numbers of their own, so
    repeated and null ids take part like all others. Texts without words and null texts are linked with nothing and all stay."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if unique:
        numbered = docs.select("*", F.col("doc_id").cast("long").alias("__row"))
    else:
        numbered = stored(docs.select("*", F.monotonically_increasing_id().alias("__row")), "numbered")
    found = jaccard.components(numbered.select(F.col("__row").alias("doc_id"), "text")).where("n_shingles > 0")
    rows = stored(found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("first_row")), "row-components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__row"))
    best = rows.join(numbered.select("__row", "doc_id"), "__row").groupBy("first_row").agg(first.alias("best"))
    # a component is named by its first row; where another one has the smallest id, the two change places
    swaps = stored(best.where("best.__row <> first_row").select("first_row", F.col("best.__row").alias("__row")), "swaps")
    others = rows.where("__row <> first_row").select("__row").join(swaps.select("__row"), "__row", "left_anti")
    gone = stored(others.union(swaps.select("first_row")), "near-copies")
    return numbered.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, verified by edit distance."""
    return decontaminate.remove_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson number with their source's rate, in shuffled order, with all columns of docs as they were."""
    return mixing.mix(docs, mixing.source_rates(docs), names=("__copy", "__order_key")).drop("__copy", "__order_key")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with virtual_slot, shard_bytes and shard, which replace columns of docs with these names."""
    return sharding.assign_shards(docs, sharding.build_map(docs, N_SHARDS), names=("virtual_slot", "shard_bytes", "shard"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaked),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A fitted field, edit distances and a largest-first map have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
