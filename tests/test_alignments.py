"""Distances of a stated set of queries to all rows, against plain versions, on odd values and long sequences."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.operators import alignments as L
from loomtrail.operators import comparisons as C
from loomtrail.operators import distances as D
from loomtrail.plans import catalog


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("words", [2, 5, 100])
def test_costs_equal_plain_ones(words, monkeypatch):
    """Lengths on both sides of 64, 128 and 255, and groups of one and of many."""
    r = np.random.default_rng(words)
    some = lambda lengths: [r.integers(0, words, n).astype(np.int8) for n in lengths]
    q, rows = some([1, 63, 64, 65, 130, 300]), some([1, 2, 63, 64, 64, 65, 127, 128, 129, 254, 255, 256])
    q.append(np.array([-2, 1, -2], np.int8))
    want = [[edits(x, y) for y in rows] for x in q]
    similar = [[D.dtw_similarity(list(x), list(y)) for y in rows] for x in q]
    longest = np.maximum(np.array(list(map(len, q)))[:, None], np.array(list(map(len, rows)))[None])
    for cells in (1, 600, L.CELLS):
        monkeypatch.setattr(L, "CELLS", cells)
        assert (L.edit_costs(q, rows) == want).all()
        assert np.allclose(1 - L.warping_costs(q, rows) / longest, similar)
    assert (L.edit_costs([*q, q[0][:0]], [*rows, q[0][:0]])[-1] == [*map(len, rows), 0]).all()


@pytest.mark.parametrize("blob", [2, 1 << 13])
def test_stated_distances_equal_the_plain_columns(spark, blob, monkeypatch):
    """Copies, empty and null lists, null tokens, words that the other side does not have, negative and null ids."""
    r = random.Random(blob)
    lists = [None, [], ["a"], ["a", None], [None, None, "é"], ["longer name", "a"] * 40]
    lists += [[r.choice("abcde") for _ in range(r.randrange(1, 90))] for _ in range(14)]
    rows = [(k - 20, lists[k % len(lists)], sorted(set(filter(None, lists[k * 7 % len(lists)] or []))) if k % 9 else None) for k in range(70)] + [(None, ["a"], [])]
    df = spark.createDataFrame(rows, "id long, s array<string>, t array<string>").repartition(3)
    monkeypatch.setattr(L, "ROWS", blob)
    monkeypatch.setattr(L, "QUERIES", blob)
    got = L.stated_distances(df, "id", 10, {"e": ("s", "edit"), "w": ("s", "warping"), "j": ("t", "jaccard"), "d": ("t", "dice")}).collect()
    known = {i: (s, t) for i, s, t in rows if i is not None}
    assert sorted((x.id_a, x.id_b) for x in got) == sorted((a, b) for a in known if a % 10 == 0 for b in known if a != b)
    for x in got:
        (s, t), (u, v) = known[x.id_a], known[x.id_b]
        if s is None or u is None:
            assert x.e is None and x.w is None
        else:
            assert x.w == pytest.approx(D.dtw_similarity(s, u))
            assert x.e == (pytest.approx(edits(s, u) / max(len(s), len(u))) if s or u else None)
        if t is None or v is None or not t and not v:
            assert x.j is None and x.d is None
        else:
            both = len(set(t) & set(v))
            assert x.j == pytest.approx(1 - both / (len(t) + len(v) - both)) and x.d == pytest.approx(1 - 2 * both / (len(t) + len(v)))
    assert L.stated_distances(df.limit(0), "id", 10, {"e": ("s", "edit")}).count() == 0


def test_stated_levels_equal_the_columns_of_pairs(spark):
    r = random.Random(7)
    some = lambda: sorted({r.choice("abcde") for _ in range(r.randrange(4))})
    df = spark.createDataFrame([(k, [r.choice("xyz") for _ in range(r.randrange(9))], some(), some(), some()) for k in range(40)], "id long, tokens array<string>, edits array<string>, scopes array<string>, modules array<string>")
    names = ["id_a", "id_b", *(f"d_{n}" for n in C.LEVELS)]
    code = F.create_map(*[F.lit(x) for x in "xxyyzz"])
    plain = lambda d: sorted(str([None if v is None else round(v, 9) + 0.0 for v in x]) for x in d.select(*names).collect())
    assert plain(C.stated_levels(df, "id", 5)) == plain(C.four_levels(D.stated_pairs(df, "id", list(C.LEVELS), 5), code))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Events with types that no list names, two types of one letter, and null ones; a user of null types and one of no id."""
    at, r = tmp_path_factory.mktemp("odd"), random.Random(11)
    types = ["click", "view", "purchase", "signup", "error", "refund", "comment", None]
    users = [u for u in range(41) for _ in range(r.randrange(1, 140))] + [None] * 5
    rows = [(k, k * 60, u, None if u == 3 else r.choice(types), 1.0, f'{{"k": {r.randrange(90)}}}') for k, u in enumerate(users)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df.select("event_id", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{at}/events.parquet")
    return str(at)


def equals_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, odd).select(*want.columns)
    plain = lambda rows: sorted(str([None if v is None else round(v, 6) + 0.0 for v in x]) for x in rows)
    assert plain(got.collect()) == plain(want.fetchall())
    assert "levenshtein" not in got._jdf.queryExecution().toString()  # none for each pair


def test_token_edit_distance_of_odd_types(spark, odd):
    equals_sql(spark, odd, "token_edit_distance")


def test_level_distances_of_odd_types(spark, odd):
    equals_sql(spark, odd, "level_distances")


def test_level_means_of_odd_types(spark, odd):
    equals_sql(spark, odd, "level_means")


def test_warping_of_copies_and_long_sequences_is_quick(spark):
    """Cell by cell in Python, these 600 million cells took more than a minute."""
    r = random.Random(2)
    long = [[r.choice("abcde") for _ in range(1000)] for _ in range(30)]
    df = spark.createDataFrame([(k, long[k % 30]) for k in range(300)], "id long, s array<string>")
    began = time.perf_counter()
    got = {(x.id_a, x.id_b): x.w for x in L.stated_distances(df, "id", 150, {"w": ("s", "warping")}).collect()}
    assert time.perf_counter() - began < 40
    assert len(got) == 2 * 299 and got[0, 30] == 1 and got[150, 7] == pytest.approx(D.dtw_similarity(long[0], long[7]))


def test_dtw_similarities_hold_every_pair(spark, odd):
    got = {(x.id_a, x.id_b): x.similarity for x in catalog.queries()["dtw_similarities"](spark, odd).collect()}
    seqs = {}
    for x in spark.read.parquet(f"{odd}/events.parquet").where("user_id IS NOT NULL").orderBy("ts", "event_id").collect():
        seqs.setdefault(x.user_id, []).append(x.event_type)
    assert got == {(a, b): pytest.approx(D.dtw_similarity(seqs[a], seqs[b]), abs=6e-7) for a in seqs if a % 20 == 0 for b in seqs if a != b}
