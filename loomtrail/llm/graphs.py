"""Connected components of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) joined along links (a, b): afterwards linked ids have one label, the smallest.

    Works on labels as nodes: each takes the smallest label it is linked with, then labels of labels are followed,
    until nothing changes. The table given is deleted if a new one is returned. A label that is linked with many is combined before the shuffle.
    """
    at = lambda name, side: labels.select(F.col("id").alias(side), F.col("label").alias(name))
    pairs = links.join(at("x", "a"), "a").join(at("y", "b"), "b").where("x <> y").select("x", "y").distinct()
    edges = stored(pairs.union(pairs.select(F.col("y"), F.col("x"))), "edges")
    if edges.isEmpty():
        discard(edges)
        return labels
    roots = stored(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("root")), "roots")
    held = roots
    while True:
        seen = edges.join(roots.select(F.col("x").alias("y"), F.col("root").alias("theirs")), "y")
        best = seen.groupBy("x").agg(F.min("theirs").alias("theirs"))
        near = roots.join(best, "x").select("x", F.least("root", "theirs").alias("near"), F.col("root").alias("was"))
        follow = roots.select(F.col("x").alias("near"), F.col("root").alias("beyond"))
        new = stored(near.join(follow, "near", "left").select("x", F.least("near", F.coalesce("beyond", "near")).alias("root"), "was"), "roots")
        discard(held)
        held, roots = new, new.select("x", "root")
        if new.where("root <> was").isEmpty():
            break
    out = stored(labels.join(roots, labels["label"] == roots["x"], "left").select("id", F.coalesce("root", "label").alias("label")), "labels")
    discard(edges, held, labels)
    return out
