import hashlib
import math
from collections import Counter

import corpus_pipeline
from loomtrail.llm import decontaminate, mixing, toxicity

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def copies(doc_id, rate):
    pieces = max(1, math.ceil(rate / mixing.PIECE))
    total = 0
    for j in range(1, pieces + 1):
        u = int(hashlib.md5(f"{mixing.SEED}|{doc_id}|{j}".encode()).hexdigest()[:15], 16) / mixing.SPAN
        lam = rate / pieces
        p = c = math.exp(-lam)
        k = 0
        while u >= c and k < 1000:
            k += 1
            p *= lam / k
            c += p
        total += k
    return total


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    rows = [r for r in rows if r[0] not in bad]
    component = {d: c for d, _, c in brute([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if component[r[0]] == r[0]]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda t: any(decontaminate.edit_distance_within(i, decontaminate.normal(t))[0] <= int(0.2 * len(i)) for i in items)
    rows = [r for r in rows if not leaks(r[1])]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.encode())
    weights, total = {s: math.sqrt(b) for s, b in size.items()}, sum(size.values())
    rates = {s: weights[s] / sum(weights.values()) * total / b for s, b in size.items()}
    want = Counter({d: copies(d, rates[s]) for d, _, s in rows})
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +want
    held = Counter()
    for r in got:
        held[r.shard] += r.shard_bytes
        assert r.shard_bytes == len(r.text.encode()) + 1
    assert set(docs.columns) <= set(out.columns) and set(held) <= set(range(8))


def test_stages_name_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "source_mixing", "sharding"]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the quick item of a benchmark that nobody should train on")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text + " eleven twelve"), (None, None), (3, ""), (3, ""), (4, None), (0, text + " eleven"), (7, "something else, far from all of the others here, " * 400)]
    rows += [(8, "well: The quick item of a benchmark that nobody should train on, said they")]
    docs = spark.createDataFrame([(i, t, None, "s" if i else None, 1, 2.5, "x", 3, 4, "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, rate double, Virtual_Slot string, shard int, copy int, order_key string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in near.collect()], key=str)
    assert got == sorted([(0, text + " eleven"), (None, None), (3, ""), (3, ""), (4, None), rows[10], rows[11]], key=str)
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, docs, str(tmp_path))
        assert stage.columns == docs.columns, name
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "copy", "order_key", "virtual_slot", "shard_bytes", "shard"]
    assert {r.order_key for r in out.collect()} == {"c"} and 8 not in {r.doc_id for r in out.collect()}
    assert corpus_pipeline.assign_shards(spark, docs.limit(0), str(tmp_path)).count() == 0
