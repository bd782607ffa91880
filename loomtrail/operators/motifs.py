"""Learning recurring procedures: pair merging (BPE), description length, sequential patterns, closed itemsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import merge_pair
from ..sources.store import stored

MERGES_PER_WRITE = 8


@dataclass
class Merges:
    merges: list[tuple[str, str, str, int]] = field(default_factory=list)
    atoms: int = 0


def _best_pair(seqs: DataFrame) -> tuple[str, str, int] | None:
    """The most frequent adjacent pair; of several, the one seen first (smallest id, then place)."""
    indexed = seqs.select("id", F.posexplode("seq").alias("pos", "a"), "seq").select("id", "pos", "a", F.get("seq", F.col("pos") + 1).alias("b")).where("b IS NOT NULL")
    row = indexed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).orderBy(F.desc("n"), "first").first()
    return (row["a"], row["b"], row["n"]) if row else None


def train_bpe(seqs: DataFrame, target_size: int = 200, min_pair_frequency: int = 2) -> tuple[Merges, DataFrame]:
    """Merge the most frequent pair until the vocabulary has target_size tokens. seqs: id, seq, and more columns.

    One job a merge, as merges depend on each other; every few merges the table is written, so plans stay short."""
    model = Merges(atoms=seqs.select(F.explode("seq")).distinct().count())
    work = stored(seqs, "bpe")
    while model.atoms + len(model.merges) < target_size:
        best = _best_pair(work)
        if best is None or best[2] < min_pair_frequency:
            break
        a, b, n = best
        model.merges.append((a, b, f"{a}+{b}", n))
        work = work.withColumn("seq", merge_pair(F.col("seq"), a, b, f"{a}+{b}"))
        if len(model.merges) % MERGES_PER_WRITE == 0:
            work = stored(work, "bpe")
    return model, work


def apply_bpe(seqs: DataFrame, model: Merges) -> DataFrame:
    """Merges in order, in Arrow batches: hundreds of merges would make too deep a plan."""
    merges = [(a, b, new) for a, b, new, _ in model.merges]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["seq"] = [_merged(list(s), merges) for s in frame["seq"]]
            yield frame

    return seqs.mapInPandas(run, seqs.schema)


def _merged(seq: list[str], merges: list[tuple[str, str, str]]) -> list[str]:
    for a, b, new in merges:
        if a in seq:
            out, k = [], 0
            while k < len(seq):
                if k + 1 < len(seq) and seq[k] == a and seq[k + 1] == b:
                    out.append(new)
                    k += 2
                else:
                    out.append(seq[k])
                    k += 1
            seq = out
    return seq


def description_length(expressed: DataFrame, n_merges: int, first_size: int) -> DataFrame:
    """n_tokens, entropy, corpus, vocabulary and total bits."""
    counts = expressed.select(F.explode("seq").alias("t")).groupBy("t").count()
    total = counts.withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(0))))
    bits = total.agg(F.first("total").alias("n_tokens"), F.sum(-F.col("count") * F.log2(F.col("count") / F.col("total"))).alias("corpus_bits"))
    vocabulary = F.aggregate(F.sequence(F.lit(1), F.lit(n_merges)), F.lit(0.0), lambda s, i: s + 2 * F.log2(F.lit(first_size) + i)) if n_merges else F.lit(0.0)
    return bits.select("n_tokens", (F.col("corpus_bits") / F.col("n_tokens")).alias("entropy_bits_per_token"), "corpus_bits", vocabulary.alias("vocab_bits"), (F.col("corpus_bits") + vocabulary).alias("total_bits"))


def mdl_sweep(seqs: DataFrame, sizes: list[int]) -> DataFrame:
    """Description length per vocabulary size: one training run, whose first merges serve each size."""
    model, _ = train_bpe(seqs, max(sizes))
    out = None
    for size in sorted(sizes):
        some = Merges(model.merges[: max(0, size - model.atoms)], model.atoms)
        row = description_length(apply_bpe(seqs, some), len(some.merges), model.atoms).select(F.lit(size).alias("vocab_size"), F.lit(len(some.merges)).alias("n_merges"), *[F.round(c, 6).alias(c) for c in ("n_tokens", "entropy_bits_per_token", "corpus_bits", "vocab_bits", "total_bits")])
        out = row if out is None else out.unionByName(row)
    return out


def prefixspan(seqs: DataFrame, min_support: float, longest: int) -> DataFrame:
    """Frequent subsequences of at least two items: pattern, freq."""
    from pyspark.ml.fpm import PrefixSpan

    found = PrefixSpan(minSupport=min_support, maxPatternLength=longest).findFrequentSequentialPatterns(seqs.select(F.transform("seq", lambda x: F.array(x)).alias("sequence")))
    return found.where(F.size("sequence") >= 2).select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), "freq")


def closed_itemsets(certs: DataFrame, items: str, min_support: float) -> DataFrame:
    """Frequent sets of two items or more without a larger one of the same frequency: items (sorted), freq."""
    from pyspark.ml.fpm import FPGrowth

    freq = stored(FPGrowth(itemsCol=items, minSupport=min_support).fit(certs).freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    larger = freq.select(F.col("items").alias("more"), F.col("freq").alias("same"))
    inside = (F.col("freq") == F.col("same")) & (F.size("more") > F.size("items")) & (F.size(F.array_except("items", "more")) == 0)
    return freq.where(F.size("items") >= 2).join(larger, inside, "left_anti")
