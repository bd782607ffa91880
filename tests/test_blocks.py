"""Neighbours, orders and ranks over whole tables against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.operators import blocks as B
from loomtrail.operators import distances as D
from loomtrail.operators import statistics as A


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), int(i % 4), r.normal(size=6).tolist()) for i in range(230)]
    rows += [(300, 1, rows[5][2]), (301, None, rows[6][2]), (302, 1, [0.0] * 6), (303, 2, [1.0, 2.0]), (304, 1, None), (None, 1, rows[3][2])]
    return rows, spark.createDataFrame(rows, "id long, label int, v array<double>")


def cosine(a, b):
    x, y = np.linalg.norm(a), np.linalg.norm(b)
    return 1 - float(np.dot(a, b) / (x * y)) if x and y else 1.0


def test_nearest_equals_brute_force(vectors):
    rows, df = vectors
    got = {}
    for r in B.nearest(df.where("id % 10 = 0"), df, 4).collect():
        got.setdefault(r.i, []).append((r.d, r.j))
    for i, _, v in rows:
        if i is not None and i % 10 == 0 and v:
            want = sorted((round(cosine(v, w), 9), j) for j, _, w in rows if j is not None and j != i and w and len(w) == len(v))[:4]
            assert sorted((round(d, 8), j) for d, j in got[i]) == sorted((round(d, 8), j) for d, j in want)
    assert B.nearest(df.limit(0), df, 4).count() == 0 and B.nearest(df, df.limit(0), 4).count() == 0
    pairs = {(r.i, r.j) for r in B.within(df.where("id % 10 = 0"), df, 0.5).collect()}
    assert pairs == {(i, j) for i, _, v in rows for j, _, w in rows if i is not None and j is not None and i % 10 == 0 and v and w and len(v) == len(w) and round(cosine(v, w), 9) < 0.5}


def test_orders_equal_plain_greedy_ones(spark, vectors):
    rows, df = vectors
    unit = df.where("size(v) = 6").select("id", D.normalised(F.col("v")).alias("v"))
    own = {r.id: np.array(r.v) for r in unit.collect() if r.id is not None}
    taken, want = [min(own)], [(1, min(own), None)]
    while len(taken) < 6:
        near = {i: round(min(2.0, *(1 - float(v @ own[t]) for t in taken), 2.0), 9) for i, v in own.items() if i not in taken}
        best = min(near, key=lambda i: (-near[i], i))
        want.append((len(taken) + 1, best, near[best]))
        taken.append(best)
    got = [tuple(r) for r in D.farthest_first(unit, 6).collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    covers = {k: {random.Random(k * 50 + j).randrange(40) for j in range(8)} for k in range(12)}
    out, left = [], set().union(*covers.values())
    while len(out) < 5:
        best = min(covers, key=lambda k: (-len(covers[k] & left), k))
        out.append((len(out) + 1, best, len(covers[best] & left)))
        left -= covers[best]
    assert [tuple(r) for r in D.greedy_cover(spark.createDataFrame([(k, j) for k, v in covers.items() for j in v], "i long, j long"), 5).collect()] == out
    assert D.greedy_cover(spark.createDataFrame([], "i long, j long"), 5).count() == 0 and D.farthest_first(unit.limit(0), 3).count() == 0


def test_erfc(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 1.9, 2.0, 3.5, 6.0, 15.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", A.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-300)


def test_benjamini_hochberg_by_ranges(spark):
    r = random.Random(4)
    ps = [round(r.random() ** 3, 2) for _ in range(200)] + [0.0, 1.0, 1.0]
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    q, least = {}, 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * len(ps) / rank)
        q[i] = least
    got = A.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "id int, p double"), "p", "id").collect()
    assert {x.id: round(x.q, 12) for x in got} == {i: round(v, 12) for i, v in q.items()}
    assert all(x.significant == (x.q <= 0.05) for x in got)


def test_wilcoxon_equals_a_plain_version(spark):
    r = random.Random(5)
    rows = [(k, float(r.randrange(-6, 9))) for k in "abc" for _ in range(60)] + [("none", 0.0), ("one", 2.0)]
    got = {x.key: x for x in A.wilcoxon_signed_rank(spark.createDataFrame(rows, "key string, delta double"), "key", "delta").collect()}
    for k in {k for k, _ in rows}:
        d = [x for y, x in rows if y == k and x]
        rank = lambda x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2  # noqa: B023, E731
        n, up = len(d), sum(rank(x) for x in d if x > 0)
        w = min(up, n * (n + 1) / 2 - up)
        ties = sum(c**3 - c for c in (sum(abs(y) == s for y in d) for s in {abs(y) for y in d}))
        sd = math.sqrt(max(1e-12, n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
        p = math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if n else 1.0
        assert (got[k].n, got[k].w) == (n, w) and got[k].p == pytest.approx(p, rel=1e-9)


def test_shuffled_labels_are_permutations(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, label long")
    got = {}
    for x in A.shuffled_labels(rows, "label", "id", 5).collect():
        got.setdefault(x.permutation, {})[x.id] = x.label
    assert set(got) == set(range(6)) and got[0] == {i: i % 3 for i in range(50)}
    assert all(sorted(g.values()) == sorted(got[0].values()) and set(g) == set(range(50)) for g in got.values())
    assert len({tuple(sorted(g.items())) for g in got.values()}) == 6
