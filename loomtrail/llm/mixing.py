"""Mixing sources to target weights by Poisson replication.

A source with target weight w of a budget of T bytes and b bytes of its own gets the repetition rate w * T / b.
Each record gets a uniform number from a seeded hash of its id, the Poisson distribution with its source's rate is
inverted at that number, the record is repeated that often, and all copies are put into the order of another hash.

Defined cases: a null source is a source of its own; a source without bytes keeps rate 1; a null text is empty;
repeated rows of one id get the same count; an empty table gives an empty result; other columns are carried along,
but for columns named like the operator's own (`names`), in any case, which its own replace.
The order is by a hash that is uniform on [0, SPAN), so partitions take equal ranges of it, without a look at the rows first.
Rates over PIECE are split into a sum of Poisson numbers, so that exp(-rate) never underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash64, stored, utf8_bytes, without

SEED, TEMPERATURE, PIECE = "mix-1", 0.5, 256.0
MAX_BROADCAST_SOURCES, SALTS = 10_000, 64
SPAN = float(1 << 60)


def source_rates(docs: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """source, rate: one row a source. Target weights are `weights` (others 0), or in proportion to bytes**temperature.
    budget: bytes to return, as a multiple of those there are."""
    sizes = docs.groupBy("source").agg(F.sum(utf8_bytes()).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("bytes").cast("double"))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    everything = Window.partitionBy(F.lit(0))  # as many rows as sources
    return (
        sizes.withColumn("weight", weight)
        .withColumns({"all_weight": F.sum("weight").over(everything), "all_bytes": F.sum("bytes").over(everything)})
        .select("source", F.when(F.col("bytes") > 0, F.try_divide(F.col("weight"), F.col("all_weight")) * F.col("all_bytes") * F.lit(float(budget)) / F.col("bytes")).otherwise(F.lit(1.0)).alias("rate"))
    )


def poisson(rate: Column, uniform: Column) -> Column:
    """The smallest k whose cumulative probability exceeds `uniform`; rate at most PIECE."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    state = lambda p, c, k: F.struct(p.alias("p"), c.alias("c"), k.alias("k"))
    zero = state(F.exp(-rate), F.exp(-rate), F.lit(0))
    step = lambda a, i: F.when(uniform >= a["c"], state(a["p"] * rate / i, a["c"] + a["p"] * rate / i, a["k"] + 1)).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda a: a["k"])


def copies(rate: Column, *key: Column, seed: str = SEED) -> Column:
    pieces = F.greatest(F.ceil(rate / PIECE), F.lit(1)).cast("int")
    uniform = lambda j: hash64(F.lit(seed), *key, j).cast("double") / F.lit(SPAN)
    each = F.transform(F.sequence(F.lit(1), pieces), lambda j: poisson(rate / pieces, uniform(j)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs and __rate. The rates are broadcast up to MAX_BROADCAST_SOURCES sources, and beyond joined by salted keys."""
    rates = stored(rates.coalesce(1), "rates").select(F.col("source").alias("__rate_source"), F.col("rate").alias("__rate"))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("__rate_source"))).drop("__rate_source")
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn("__doc_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("__rate_source")) & (F.col("__doc_salt") == F.col("__salt"))).drop("__rate_source", "__salt", "__doc_salt")


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED, names: tuple[str, str] = ("copy", "order_key")) -> DataFrame:
    """docs repeated, with copy (from 1) and order_key, under these names, in the order of order_key."""
    kept = [F.col(f"`{c}`") for c in without(docs, *names).columns]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = with_rates(docs, rates).select(*kept, copies(F.col("__rate"), F.col("doc_id"), seed=seed).alias("__copies")).where("__copies > 0")
    repeated = drawn.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    keyed = repeated.withColumn("__order", hash64(F.lit(seed + ":order"), F.col("doc_id"), F.col("__copy")))
    part = F.floor(F.shiftright("__order", 30) * F.lit(parts) / F.lit(1 << 30)).cast("int")
    dealt = keyed.repartitionById(parts, part)
    return dealt.sortWithinPartitions("__order", "doc_id", "__copy").select(*kept, F.col("__copy").alias(names[0]), F.col("__order").alias(names[1]))
