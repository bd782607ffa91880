"""The registered queries against DuckDB where they have SQL, and against plain versions where they have none."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomtrail.llm import queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.registered_sql()))
def test_query_equals_sql(spark, db, name):
    got = queries.registered()[name](spark, SF)
    want = db.execute(queries.registered_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.registered()} == {f"op{k}" for k in range(1, 11)}


def test_sharding_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.registered()["op5_sharding"](spark, SF).collect()
    slot = {r.doc_id: r.virtual_slot for r in docs.select("doc_id", sharding.slot_of(sharding.N_SLOTS).alias("virtual_slot")).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    size, members = Counter(), defaultdict(list)
    for d, t in texts.items():
        size[slot[d]] += len(t) + 1
        members[slot[d]].append((d, zlib.crc32(t)))
    held, many, shard_of = [0] * 8, [0] * 8, {}
    for s in sorted(range(sharding.N_SLOTS), key=lambda s: (-size[s], s)):
        best = min(range(8), key=lambda k: (held[k], many[k], k))
        shard_of[s] = best
        held[best] += size[s]
        many[best] += 1
    want = set()
    for k in range(8):
        place = 0
        for s in sorted(x for x in shard_of if shard_of[x] == k):
            for d, crc in sorted(members[s]):
                want.add((d, len(texts[d]) + 1, crc, "bytes", k, place, None))
                place += 1
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows} == want and len(rows) == len(want)
    assert max(held) - min(held) <= max(size.values())


def test_toxicity_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    t = np.exp(np.array(model.move))
    rows = {r.doc_id: r for r in queries.registered()["op8_toxicity"](spark, SF).collect()}
    for d in docs.collect():
        words = toxicity._WORDS.findall(d.text or "")
        e = [max(-30.0, min(30.0, model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)))) for w in words]
        ahead, v = [], np.array([1.0, 0.0])
        for x in e:
            v = (v @ t) * np.array([1.0, math.exp(x)])
            v /= v.sum()
            ahead.append(v)
        total, v = 0.0, np.ones(2)
        for x, a in zip(reversed(e), reversed(ahead), strict=True):
            p = a[1] * v[1] / (a @ v)
            if p > 0.5:
                total += math.log(min(p, 1 - 1e-9) / (1 - min(p, 1 - 1e-9)))
            v = t @ (np.array([1.0, math.exp(x)]) * v)
            v /= v.sum()
        score = 1 / (1 + math.exp(-max(-30, min(30, model.slope * min(toxicity.MOST_EVIDENCE, total) + model.level))))
        r = rows.pop(d.doc_id)
        assert r.score == pytest.approx(score, abs=1e-6) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
    assert not rows
