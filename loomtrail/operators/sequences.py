"""Ordered sequences: positions, runs, turns, phases, n-grams, pair merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows and pos, from 1, within `by`. The order should be total."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def sequences(rows: DataFrame, by: list[str], item: str, pos: str = "pos", name: str = "seq") -> DataFrame:
    """One array of items per group, in order."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(pos, item))).alias("_s")).select(*by, F.col(f"_s.{item}").alias(name))


def split_turns(rows: DataFrame, by: str, pos: str, opens: Column) -> DataFrame:
    """rows and turn: each opening row starts a turn; rows before the first are turn 0."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn_no", F.sum(opens.cast("int")).over(w))


def runs(rows: DataFrame, by: str, kind: str, pos: str = "pos") -> DataFrame:
    """Maximal runs of one kind: by, run, kind, n, first_pos."""
    w = Window.partitionBy(by).orderBy(pos)
    change = F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))
    return rows.withColumn("run", F.sum(change).over(w)).groupBy(by, "run", kind).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def without_repeats(seq: Column) -> Column:
    """Consecutive duplicates dropped."""
    return F.filter(seq, lambda x, i: (i == 0) | (x != F.get(seq, i - 1)))


def upper_median(values: str) -> Column:
    """The middle element, the upper one of two."""
    v = F.sort_array(F.collect_list(values))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def adjacent_pairs(rows: DataFrame, by: list[str], item: str, pos: str = "pos") -> DataFrame:
    """by, a, b: each item with its successor."""
    w = Window.partitionBy(*by).orderBy(pos)
    return rows.withColumn("b", F.lead(item).over(w)).where("b IS NOT NULL").select(*by, F.col(item).alias("a"), "b")


def ngrams(seq: Column, n: int, joiner: str = ">") -> Column:
    """Overlapping n-grams as strings; none where the sequence is shorter."""
    starts = F.when(F.size(seq) >= n, F.sequence(F.lit(1), F.size(seq) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(seq, i, n), joiner))


def merge_pair(seq: Column, a: str, b: str, new: str) -> Column:
    """Left to right, without overlap, each a, b becomes new."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(s, x):
        joined = F.struct(F.concat(s["out"], F.array(F.lit(new))).alias("out"), F.lit(None).cast("string").alias("held"))
        moved = F.struct(F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]).alias("out"), x.alias("held"))
        return F.when((s["held"] == a) & (x == b), joined).otherwise(moved)

    return F.aggregate(seq, start, step, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


#: The phases of an atom are decided by these names and beginnings.
PHASES = ("cleanup_submit", "verification", "editing", "localization", "exploration")


def phase(atom: Column, seen_open: Column, seen_edit: Column) -> Column:
    """The phase of an atom, given whether a file was opened or edited before it."""
    starts = lambda *names: F.lit(False) if not names else F.reduce(F.array(*[atom.startswith(n) for n in names]), F.lit(False), lambda s, x: s | x)
    return (
        F.when((atom == "SUBMIT") | starts("SHELL_RM"), "cleanup_submit")
        .when(starts("RUN_PYTHON_", "RUN_PYTEST"), "verification")
        .when(starts("EDIT_", "CREATE_"), "editing")
        .when(starts("OPEN_", "NAV_"), F.when(seen_edit, "editing").otherwise("localization"))
        .when((atom == "SEARCH") | starts("FIND_FILE"), F.when(seen_edit, "editing").when(seen_open, "localization").otherwise("exploration"))
        .when(starts("SHELL_"), F.when(~seen_open & ~seen_edit, "exploration").otherwise("editing"))
        .otherwise("exploration")
    )


def with_phases(rows: DataFrame, by: str, atom: str = "atom", pos: str = "pos") -> DataFrame:
    before = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.max(c).over(before), F.lit(False))
    a = F.col(atom)
    return rows.withColumn("phase", phase(a, seen(a.startswith("OPEN_")), seen(a.startswith("EDIT_") | a.startswith("CREATE_"))))


def stuck_loop(rows: DataFrame, by: str, located: Column, atom: str = "atom", pos: str = "pos", least: int = 14, edit_share: float = 0.30, submit_share: float = 0.05) -> DataFrame:
    """Per trace: how it goes on after the first atom for which `located` holds."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("after") == 1
    marked = rows.withColumn("after", F.max(located.cast("int")).over(w))
    counted = marked.groupBy(by).agg(
        F.count("*").alias("n_atoms"),
        F.count(F.when(after, 1)).alias("postloc_steps"),
        F.count(F.when(after & (F.col(atom) == "EDIT_SRC_PY"), 1)).alias("edits"),
        F.count(F.when(after & (F.col(atom) == "SUBMIT"), 1)).alias("submits"),
    )
    n = F.greatest("postloc_steps", F.lit(1))
    stuck = (F.col("postloc_steps") >= least) & (F.col("edits") / n >= edit_share) & (F.col("submits") / n <= submit_share)
    verdict = F.when(F.col("postloc_steps") == 0, "no-localization").when(stuck, "stuck-edit-loop").when(F.col("postloc_steps") < least, "short-trajectory").otherwise("normal")
    return counted.select(by, "n_atoms", "postloc_steps", F.round(F.col("edits") / n, 4).alias("edit_src_share"), F.round(F.col("submits") / n, 4).alias("submit_share"), stuck.cast("int").alias("flag_stuck_edit_loop"), verdict.alias("verdict"))


def first_position(rows: DataFrame, by: str, holds: Column, pos: str = "pos") -> DataFrame:
    return rows.groupBy(by).agg(F.min(F.when(holds, F.col(pos))).alias("first_pos"))


def forward_fill(rows: DataFrame, by: str, value: Column, pos: str = "pos", name: str = "current") -> DataFrame:
    """The last non-null value so far: the nearest form of an as-of join within a trace."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def touches_within(rows: DataFrame, by: str, item: str, seconds: Column, most: int, pos: str = "pos") -> DataFrame:
    """Edges of a co-touch graph: each touch is linked to the first later touch of another item within `most` seconds.

    Rows in time order; done over each trace's array, so no self join of all pairs is made.
    """
    touched = rows.select(by, pos, F.col(item).alias("item"), seconds.alias("at")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(pos, "item", "at"))).alias("t"))
    later = F.transform(
        "t",
        lambda x, i: F.struct(
            x["item"].alias("a"),
            F.get(F.filter(F.slice("t", i + 2, F.size("t")), lambda y: (y["item"] != x["item"]) & (y["at"] - x["at"] >= 0) & (y["at"] - x["at"] <= most)), F.lit(0))["item"].alias("b"),
        ),
    )
    edges = touched.select(by, F.explode(later).alias("e")).where("e.b IS NOT NULL")
    return edges.groupBy(by, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).agg(F.count("*").alias("n"))
