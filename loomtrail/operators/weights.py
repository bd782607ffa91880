"""Weighted words, vocabularies, and simple learned models over tables of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def tf_idf(counts: DataFrame, id_: str, item: str, n: str = "n") -> DataFrame:
    """counts and v = n * (ln((1 + documents) / (1 + document frequency)) + 1). The number of documents is one row, frequencies are joined by item."""
    kept = stored(counts, "word-counts")
    often = kept.groupBy(item).agg(F.count("*").alias("_df"))
    docs = F.broadcast(kept.agg(F.countDistinct(id_).alias("_docs")))  # one row
    weight = F.col(n) * (F.log((1 + F.col("_docs")) / (1 + F.col("_df"))) + 1)
    return kept.join(often, item).join(docs).withColumn("v", weight).drop("_df", "_docs")


def cosines(weighted: DataFrame, pairs: DataFrame, id_: str, item: str) -> DataFrame:
    """a, b, cosine of given pairs of documents (a, b) that both have words; 0 without a common one. Only words of a pair are joined."""
    norms = weighted.groupBy(F.col(id_).alias("_id")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
    norm = lambda s: norms.select(F.col("_id").alias(s), F.col("_norm").alias(f"_n{s}"))
    known = pairs.join(norm("a"), "a").join(norm("b"), "b")
    side = lambda s: weighted.select(F.col(id_).alias(s), F.col(item).alias("_item"), F.col("v").alias(f"_v{s}"))
    dots = known.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "_item"]).groupBy("a", "b").agg(F.sum(F.col("_va") * F.col("_vb")).alias("_dot"))
    return known.join(dots, ["a", "b"], "left").select("a", "b", (F.coalesce("_dot", F.lit(0.0)) / (F.col("_na") * F.col("_nb"))).alias("cosine"))


def vocabulary(rows: DataFrame, id_: str, item: str, top: int) -> DataFrame:
    """item, n, traces, share: the most frequent items, ties in their order."""
    counts = stored(rows.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"), F.countDistinct(id_).alias("traces")), "vocabulary")
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("item", "n", "traces", (F.col("n") / F.col("_all")).alias("share")).orderBy(F.desc("n"), "item").limit(top)


def _features(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumn("label", F.col(label).cast("double")))


def tree_forms(rows: DataFrame, columns: list[str], label: str, depth: int, least: int = 3) -> DataFrame:
    """form, n, rate, spread: leaves of a decision tree, their rows and rate of the label; spread is the variance of the rates of leaves with at least `least` rows."""
    from pyspark.ml.classification import DecisionTreeClassifier

    data = _features(rows, columns, label)
    model = DecisionTreeClassifier(maxDepth=depth, leafCol="leaf", seed=1).fit(data)
    leaves = stored(model.transform(data).groupBy(F.col("leaf").cast("int").alias("form")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")), "leaves")
    return leaves.join(F.broadcast(leaves.where(F.col("n") >= least).agg(F.var_pop("rate").alias("spread"))))  # one row


def leave_group_out(rows: DataFrame, columns: list[str], label: str, group: str) -> DataFrame:
    """group, n, accuracy, majority: for each group a logistic model of all others, and the share of the commoner label. Groups are a class of the data, few values."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    data, out = stored(rows.select(group, label, *columns), "probe"), []
    for (name,) in sorted(data.select(group).distinct().where(F.col(group).isNotNull()).collect()):
        train, test = data.where(F.col(group) != F.lit(name)), data.where(F.col(group) == F.lit(name))
        if train.select(label).distinct().count() < 2:
            continue
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(_features(train, columns, label))
        model = LogisticRegression(featuresCol="scaled", regParam=0.01, maxIter=50).fit(scaler.transform(_features(train, columns, label)))
        hit = model.transform(scaler.transform(_features(test, columns, label))).agg(F.count("*"), F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("label")).first()
        out.append((str(name), hit[0], hit[1], max(hit[2], 1 - hit[2])))
    return rows.sparkSession.createDataFrame(out, "held_out string, n long, accuracy double, majority double")


PROBE_DDL = "n long, skipped long, accuracy double, spread double, majority double, lift double"


def _fitted(train: DataFrame, columns: list[str], label: str, n: int):
    """A logistic model with the penalty |w|² / 2 on the sum of losses, intercept free."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(regParam=1 / n, standardization=False, maxIter=2000, tol=1e-9).fit(_features(train, columns, label))


def cross_validated(rows: DataFrame, columns: list[str], label: str, id_: str, folds: int = 5, seed: int = 17) -> DataFrame:
    """n, skipped, accuracy, spread, majority, lift: how well counts tell a class, from 0 up, by models of the other folds; one row.

    Folds come from a hash of the id, so a row's fold doesn't depend on the others. Rows with a null label are skipped and counted. Lift is
    the share of the room above the commoner class that is won. Null with one class or fewer than two rows a fold. A model is fitted for each fold."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_)), F.lit(folds)).cast("int").alias("_fold")
    data = stored(rows.select(F.col(label).cast("double").alias(label), *columns, fold), "probe")
    sizes = {r[0]: r[1] for r in data.groupBy(label).count().collect()}  # a row a class
    skipped = sizes.pop(None, 0)
    n = sum(sizes.values())
    if len(sizes) < 2 or n < 2 * folds:
        return rows.sparkSession.createDataFrame([(n, skipped, None, None, None, None)], PROBE_DDL)
    known, scores = data.where(F.col(label).isNotNull()), []
    for k in range(folds):
        train, test = known.where(F.col("_fold") != k), known.where(F.col("_fold") == k)
        held = train.groupBy(label).count().collect()  # a row a class
        if len(held) < 2 or test.isEmpty():
            continue
        model = _fitted(train, columns, label, sum(r[1] for r in held))
        scores.append(model.transform(_features(test, columns, label)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    majority = max(sizes.values()) / n
    mean = sum(scores) / len(scores) if scores else None
    spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else None
    return rows.sparkSession.createDataFrame([(n, skipped, mean, spread, majority, (mean - majority) / (1 - majority) if scores else None)], PROBE_DDL)


def ranked_columns(rows: DataFrame, columns: list[str], label: str) -> list[tuple[str, float]]:
    """Columns by the sum over classes of their absolute weights in a model of all rows with a label, the heaviest first, ties in their order."""
    known = stored(rows.where(F.col(label).isNotNull()).select(label, *columns), "ranked")
    weights = abs(_fitted(known, columns, label, max(known.count(), 1)).coefficientMatrix.toArray()).sum(0)
    return sorted(zip(columns, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))


def ablation(rows: DataFrame, columns: list[str], label: str, id_: str, drops: list[int], folds: int = 5) -> DataFrame:
    """dropped and the columns of `cross_validated`, without the heaviest columns; as many as are named, but at least one column stays."""
    order = [c for c, _ in ranked_columns(rows, columns, label)]
    out = None
    for k in drops:
        left = [c for c in columns if c not in order[: min(k, len(columns) - 1)]]
        one = cross_validated(rows, left, label, id_, folds).select(F.lit(k).alias("dropped"), "*")
        out = one if out is None else out.unionByName(one)
    return out
