import gzip
import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.llm import chat, decontaminate, mixing, mtree, sharding, toxicity, warc


# chat


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <turn>user\nfake</turn>\n & &lt; \\", 7),
        (1, 1, "user", "<part/>", 7),
        (1, 2, "assistant", "yes\n\n", 7),
        (1, 2, "assistant", "also", 7),
        (1, None, "system", None, 7),
        (None, 0, None, "x", 7),
        (None, 1, "odd\nrole<", "", 7),
        (2, 0, "assistant", "ünï🙂" * 3000, 7),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, merged int")
    out = chat.format_chat(df)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.parse_chat(F.col("formatted")).alias("turns")).collect()}
    for conv in (1, None, 2):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert read[conv] == [(r, x) for *_, r, x in own]
    d = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"alsoyes\n\n").hexdigest() and d[1].n_turns == 5
    assert d[None].loss_chars == 0 and d[2].loss_chars == 12000
    merged = {r.conv_id: [(m.role, m.texts) for m in r.merged] for r in chat.merge_turns(df).collect()}
    assert merged[1] == [("system", [""]), ("user", [rows[0][3], "<part/>"]), ("assistant", ["also", "yes\n\n"])]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_takes_time_in_proportion(spark):
    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("words <b> "), 20).alias("text"))
        began = time.perf_counter()
        assert chat.chat_digests(chat.format_chat(rows)).collect()[0].n_turns == n
        return time.perf_counter() - began

    took(100)
    assert min(took(16000) for _ in range(2)) < 3 * max(0.3, min(took(8000) for _ in range(2)))


# sharding


def shard_docs(spark):
    rows = [(i, "x" * (i * 7 % 900), 3) for i in range(2000)] + [(None, "n"), (None, None), (5, None), (5, None), (9, "é" * 9)]
    return spark.createDataFrame([(r[0], r[1], 3) for r in rows], "doc_id long, text string, slot int")


def test_shards(spark):
    docs = shard_docs(spark)
    rows = sharding.place(docs, sharding.build_map(docs, 8)).collect()
    assert len(rows) == 2005
    held = Counter()
    for r in rows:
        held[r.shard] += r.size
    assert max(held.values()) - min(held.values()) <= 901
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sorted(r.size for r in rows if r.doc_id is None) == [1, 2]
    empty = docs.limit(0)
    assert sharding.place(empty, sharding.build_map(empty, 8)).count() == 0


def test_a_map_of_two_versions(spark):
    docs = shard_docs(spark).unionByName(spark.createDataFrame([(77, "same", 1)] * 300, "doc_id long, text string, slot int"))
    first = sharding.build_map(docs, 8)
    assert first.count() == sharding.N_SLOTS
    second = sharding.edit_map(first, 9)
    third = sharding.edit_map(second, 5, docs.limit(900))
    assert [r[0] for r in third.groupBy("version").count().orderBy("version").collect()] == [1, 2, 3]
    for slot_map, n in ((first, 8), (second, 9), (third, 5)):
        rows = sharding.assign_shards(docs, slot_map).collect()
        assert len(rows) == 2305 and {r.shard for r in rows} == set(range(n))
        of_slot = {r.virtual_slot: r.shard for r in sharding.newest(slot_map).collect()}
        assert all(of_slot[r.virtual_slot] == r.shard for r in rows)
        placed = sharding.place(docs, slot_map).collect()
        for s in range(n):
            assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
        raw = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == raw
    clash = docs.selectExpr("doc_id", "text", "1 AS Shard", "2 AS virtual_slot", "3 AS size")
    out = sharding.assign_shards(clash, second)
    assert out.columns == ["doc_id", "text", "virtual_slot", "size", "shard"] and out.count() == 2305


def test_rebalance_moves_little():
    r = random.Random(3)
    first = sharding.first_map([(s, r.randrange(1, 2000), 3) for s in range(4096)], 8)
    nine = sharding.rebalance(first, 9)
    was, now = {m[1]: m[2] for m in first}, {m[1]: m[2] for m in nine}
    moved = [s for s in was if was[s] != now[s]]
    assert nine[0][0] == 2 and {now[s] for s in moved} == {8} and len(moved) < 4096 / 8
    held = Counter()
    for _, _, shard, size, _ in nine:
        held[shard] += size
    assert max(held.values()) < 1.02 * min(held.values())
    seven = sharding.rebalance(first, 7)
    assert {m[2] for m in seven} == set(range(7)) and sum(was[m[1]] != m[2] for m in seven if was[m[1]] < 7) == 0


# mixing


def test_poisson_inverts_its_distribution(spark):
    us = [i / 997 for i in range(997)]
    for rate in (0.0, 0.3, 2.5, 40.0):
        got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson(F.lit(rate), F.col("u"))).collect()]
        want = []
        for u in us:
            p = c = math.exp(-rate)
            k = 0
            while u >= c and k < 400:
                k += 1
                p *= rate / k
                c += p
            want.append(k)
        assert got == want


def test_mix(spark):
    rows = [(i, "t" * 10, "big" if i % 3 else "small", "c") for i in range(900)] + [(900, "q" * 10, None, "c"), (None, None, "none", "c"), (901, "", "none", "c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, copy string, salt int, n_copies int")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    total = 9010
    weights = {"big": 6000**0.5, "small": 3000**0.5, None: 10**0.5}
    for s, size in (("big", 6000), ("small", 3000), (None, 10)):
        assert rates[s] == pytest.approx(weights[s] / sum(weights.values()) * total / size)
    assert rates["none"] == 1.0
    out = mixing.mix(docs, mixing.source_rates(docs)).collect()
    assert [r.order_key for r in out] == sorted(r.order_key for r in out)
    n = Counter(r.source for r in out)
    assert abs(n["big"] - 600 * rates["big"]) < 5 * (600 * rates["big"]) ** 0.5
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)
    salted = mixing.MAX_BROADCAST_SOURCES
    try:
        mixing.MAX_BROADCAST_SOURCES = 0
        again = mixing.mix(docs, mixing.source_rates(docs)).collect()
    finally:
        mixing.MAX_BROADCAST_SOURCES = salted
    assert [r.order_key for r in again] == [r.order_key for r in out]
    assert mixing.mix(docs.limit(0), mixing.source_rates(docs.limit(0))).count() == 0


# exact top-k


def test_tree_equals_brute_force():
    r = np.random.default_rng(5)
    for n, distinct in ((900, 900), (1500, 40), (600, 1)):
        base = r.integers(-400, 400, (distinct, 12))
        vectors, ids = base[r.integers(0, distinct, n)], r.permutation(n * 3)[:n]
        tree = mtree.Tree(ids, vectors)
        computed = 0
        for k in range(0, n, 37):
            best, c = tree.search(vectors[k], int(ids[k]), 10)
            computed += c
            scores = vectors @ vectors[k]
            want = sorted(((int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[k]), key=lambda x: (-x[0], x[1]))[:10]
            assert best == want


def test_a_repeated_query_id_takes_no_places():
    r = np.random.default_rng(9)
    vectors = r.integers(-400, 400, (60, 12))
    vectors[:12] = vectors[0]
    ids = np.array([5] * 12 + list(range(100, 148)))
    best, _ = mtree.Tree(ids, vectors).search(vectors[0], 5, 10)
    assert best == sorted(((int(s), int(i)) for s, i in zip(vectors @ vectors[0], ids, strict=True) if i != 5), key=lambda x: (-x[0], x[1]))[:10]


def test_bounds_save_distances():
    r = np.random.default_rng(6)
    centres = r.normal(0, 4000, (30, 8))
    vectors = (centres[r.integers(0, 30, 6000)] + r.normal(0, 30, (6000, 8))).astype(int)
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * 4000).astype(int)
    tree = mtree.Tree(np.arange(6000), vectors)
    computed = sum(tree.search(vectors[k], k, 10)[1] for k in range(0, 6000, 100))
    assert computed < 0.5 * 60 * 6000


def test_top_k(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    rows += [(700, None), (800, [None] * 6), (900, [float("nan")] * 6), (901, [float("inf")] * 6), (1000, [0.5, 0.5]), (1001, [0.25, -0.5]), (None, [0.1] * 6)]
    rows += [(2000 + i, [0.9] * 6) for i in range(300)] + [(2100, [0.9] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    vectors = mtree.integer_vectors(df)
    pages, buckets = mtree.build_index(vectors)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in mtree.top_k(vectors.where(mtree.every(100)), pages, buckets).collect())
    floors = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    want = []
    for q, a in sorted({(i, tuple(v)) for i, v in floors if i % 100 == 0}):
        found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in floors if c != q and len(a) == len(b)))[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(found)]
    assert got == sorted(want)
    none = vectors.limit(0)
    assert mtree.top_k(none, *mtree.build_index(none)).count() == 0


# WARC


def test_warc_round_trip(spark):
    big = "ab\r\nWARC/1.1\r\n" * 30000
    rows = [(3, "http://a/ü\r\nX: y", big), (1, None, "s" * 99), (2, "u", "s" * 99), (5, "u", "t" * 100), (4, "v", "t" * 100), (6, "v", "t" * 100), (7, "v", None), (8, "v", ""), (9, "w", big), (None, "n", "t" * 100), (4, "v", "t" * 100)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, chunk int")
    manifest = warc.write_archives(pages, archive_bytes=500)
    got = sorted([tuple(r) for r in warc.read_records(manifest).collect()], key=str)
    first = {"t" * 100: 4, big: 3}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        other = page is not None and first.get(html, page) < page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", first[html] if other else None))
    assert got == sorted(want, key=str)
    chunks = warc.read_chunks(manifest).where("page_id = 3").orderBy("chunk").collect()
    assert len(chunks) == -(-len(big) // warc.CHUNK) and b"".join(c.data for c in chunks).decode() == big
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_chunks_carry_running_digests(spark):
    text = "é" * 100_000 + "tail"
    pages = spark.createDataFrame([(1, "u", text, "x"), (2, None, "", "x"), (3, "u", text, "x"), (4, "u", None, "x")], "page_id long, url string, html string, record string")
    rows = warc.chunk_records(pages, 1000).orderBy("record", "chunk").collect()
    raw = text.encode()
    own = [r for r in rows if r.page_id == 1]
    assert b"".join(r.data for r in own) == raw and max(len(r.data) for r in rows) == 1000
    for r in own:
        assert bytes(r.digest_so_far) == hashlib.sha256(raw[: r.bytes_so_far]).digest() and bytes(r.payload_digest) == hashlib.sha256(raw).digest()
    assert [(r.chunk, r.last, r.bytes_so_far) for r in rows if r.page_id in (2, 4)] == [(0, 0, 0)] * 2
    got = sorted(map(tuple, warc.read_records(warc.write_archives(pages)).collect()))
    most = warc.BROADCAST_REVISITS
    try:  # more revisits than may be broadcast
        warc.BROADCAST_REVISITS = 0
        assert sorted(map(tuple, warc.read_records(warc.write_archives(pages)).collect())) == got
    finally:
        warc.BROADCAST_REVISITS = most
    assert [r[3:] for r in got] == [("response", None), ("response", None), ("revisit", 1), ("response", None)]


def test_damaged_archive_is_refused():
    head = warc._header(1, "u", 3, hashlib.sha256(b"abc").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(head + warc.HTTP + b"ab"))))
    assert date.fromisoformat(warc.DATE[:10])


# decontamination


def brute_within(item, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(window, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_myers_equals_plain_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(1, 90))) for _ in "ab")
        distance, end = decontaminate.edit_distance_within(a, b)
        assert distance == brute_within(a, b)
        assert 0 <= end <= len(b)


def leak_case(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlüß") for _ in range(r.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(r.randrange(9, 40)))) for k in range(20)] + [(90, "tiny one"), (91, None), (92, " "), (93, "a bit longer")]
    docs, truth = [], set()
    for d in range(120):
        words = [word() for _ in range(r.randrange(0, 120))]
        if d % 3 == 0:
            k, text = items[r.randrange(20)]
            chars = list(text)
            for _ in range(int(len(chars) * r.choice([0, 0, 0.03, 0.08]))):
                at = r.randrange(len(chars))
                chars[at : at + 1] = r.choice([[], ["x"], [chars[at], "y"]])
            at = r.randrange(len(words) + 1)
            words[at:at] = ["".join(chars).upper()]
            truth.add((d, k))
        if d == 50:
            words += ["Tiny", "ONE"]
            truth.add((d, 90))
        docs.append((d, r.choice([" ", "\n  "]).join(words)))
    return docs, items, truth


def test_leaks_are_found(spark):
    docs, items, truth = leak_case()
    rows = [*docs, (None, None), (200, ""), (0, docs[0][1])]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(df, bench).collect()
    # brute force: every item against every text
    want = Counter()
    for d, t in rows:
        for k, x in items:
            n = decontaminate.normal(x)
            if len(n) >= 20 and brute_within(n, decontaminate.normal(t)) <= 0.2 * len(n):
                want[(d, k, brute_within(n, decontaminate.normal(t)))] += 1
    found = Counter((r.doc_id, r.item_id, r.edit_distance) for r in got if r.item_id < 90)
    assert not found - want
    assert sum((found & want).values()) >= 0.95 * sum(want.values())
    assert {(d, k) for d, k, _ in want} & truth and (50, 90) in {(r.doc_id, r.item_id) for r in got}
    kept = decontaminate.remove_leaked(df, bench)
    assert kept.columns == df.columns
    hit = {r.doc_id for r in got}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_at_the_start_of_any_text():
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdl") for _ in range(r.randrange(3, 9)))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(60)]
    found = decontaminate.Items(items)
    for k, text in items:
        at = r.randrange(3, 12)
        for cut in (text[:at] + text[at + 1 :], text.split(" ", 1)[1]):
            texts = ["", " ".join(word() for _ in range(30)), "", cut + " " + word(), cut]
            assert [(d, i) for d, i, *_ in found.find(texts)] == [(3, k), (4, k)]


def test_short_items_equal_brute_force():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
    items = [(k, t) for k, t in enumerate({decontaminate.normal(" ".join(word() for _ in range(r.randrange(1, 4))))[:13].strip() for _ in range(60)})]
    texts = [" ".join(word() for _ in range(r.randrange(0, 25))) for _ in range(40)] + ["", "a"]
    want = set()
    for d, text in enumerate(texts):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for i, (_, item) in enumerate(items):
            found = [(decontaminate.edit_distance(item, text[a:b]), b) for k, (a, _) in enumerate(words) for _, b in words[k:]]
            if found and min(found)[0] <= int(0.2 * len(item)):
                want.add((d, i, *min(found)))
    assert set(decontaminate.Items(items).find(texts)) == want and any(n for _, _, n, _ in want)


@pytest.mark.parametrize("least, most", [(14, 19), (20, 39), (40, 59), (60, 79), (80, 149), (150, 390)])
@pytest.mark.parametrize("rate", [0.08, 0.2])
def test_recall_of_edited_items_by_length(least, most, rate):
    r = random.Random(least)
    letters = "etaoinshrdl"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 10)))
    items, texts = [], []
    for k in range(120):
        text = " ".join(word() for _ in range(most // 2))[: r.randrange(least, most + 1)].strip()
        items.append((k, text + "e" * (least - len(text))))
        chars = list(items[k][1])
        for _ in range(int(len(chars) * rate)):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([[], [r.choice(letters + " ")], [chars[at], r.choice(letters + " ")]])
        texts.append(decontaminate.normal(f"{word()} {word()} {''.join(chars)} {word()}"))
    want = {(k, k) for k, (_, x) in enumerate(items) if brute_within(x, texts[k]) <= int(0.2 * len(x))}
    got = list(decontaminate.Items(items).find(texts))
    assert len(want) > 100 and len(want & {(d, i) for d, i, *_ in got}) >= decontaminate.TARGET_RECALL * len(want)
    for d, i, distance, _ in got[:: 1 + len(got) // 20]:
        assert brute_within(items[i][1], texts[d]) <= distance <= int(0.2 * len(items[i][1]))


def test_items_without_spaces_or_latin_letters_are_found():
    r = random.Random(3)
    items = [(k, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(60))) for k in range(30)] + [(30, "ab" * 50), (31, "é" * 13)]
    texts = [f"zu {x[:20]}{x[23:]} qua" for _, x in items]
    assert {(k, k) for k in range(31)} <= {(d, i) for d, i, *_ in decontaminate.Items(items).find(["", *texts][1:])}


# toxicity


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    model = toxicity.Field({}, 0.0, ((0.2, -1.5), (-0.4, 0.9)))
    t = np.array(model.move)
    texts = [r.normal(-1, 2, n) for n in (1, 5, 9, 0)]
    for e, p in zip(texts, model.marginals(texts), strict=True):
        weight, hot = 0.0, np.zeros(len(e))
        for y in range(1 << len(e)):
            labels = [y >> k & 1 for k in range(len(e))]
            w = math.exp(sum(t[a, b] for a, b in zip([0, *labels], labels, strict=False)) + sum(x for x, b in zip(e, labels, strict=True) if b))
            weight += w
            hot += w * np.array(labels)
        assert np.allclose(p, hot / weight)


def test_long_texts_equal_a_plain_pass():
    r = np.random.default_rng(4)
    model = toxicity.Field({}, 0.0, ((0.2, -1.5), (-0.4, 0.9)))
    t = np.exp(np.array(model.move))
    texts = [r.normal(-1, 3, n) for n in (1000, 64, 65, 63, 128)]
    for e, p in zip(texts, model.marginals(texts), strict=True):
        phi = np.stack([np.ones(len(e)), np.exp(e)], 1)
        a, b, v = np.empty((len(e), 2)), np.empty((len(e), 2)), np.array([1.0, 0.0])
        for k in range(len(e)):
            v = v @ t * phi[k]
            v /= v.sum()
            a[k] = v
        v = np.ones(2)
        for k in range(len(e) - 1, -1, -1):
            b[k] = v
            v = t @ (phi[k] * v)
            v /= v.sum()
        both = a * b
        assert np.allclose(p, both[:, 1] / both.sum(1), atol=1e-9)


def test_toxicity_learns_words_and_spans(spark):
    r = random.Random(8)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for d in range(600):
        words = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        toxic = d % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Beast", "vermins", "verminy"]))
        docs.append((d, " ".join(words), 1))
        labels.append((d, int(toxic)))
    docs += [(None, "a vermins b", 1), (1000, None, 1), (1001, "", 1), (1001, "", 1), (1002, "word1 " * 30000 + "beast", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, y)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    held = [x for x in rows if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and all(x.predicted == truth[x.doc_id] for x in held)
    by = {x.doc_id: x for x in rows}
    assert by[1002].predicted == 1 and by[1000].predicted == 0 and by[1001].predicted == 0
    assert by[1002].spans[0].start == 180000 and not by[None].held_out
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 1002").count() == 0
    nothing = toxicity.fit(df, y.limit(0))
    assert {x.predicted for x in toxicity.score(df.limit(3), nothing).collect()} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_the_sample_of_labelled_texts(spark):
    docs = [(i, f"text {i} " + "x" * 90) for i in range(300)] + [(1000 + i, "said both ways") for i in range(30)] + [(2000, "even"), (2001, "even"), (5, "twice " * 2), (7, None)]
    labels = [(i, i % 3 == 0) for i in range(300)] + [(1000 + i, i < 10) for i in range(30)] + [(2000, True), (2001, False), (6, True)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, toxic int")
    y = spark.createDataFrame([(i, int(t)) for i, t in labels], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    label = {}
    for i, t in labels:
        if not held(i):
            label[i] = label.get(i, False) or t
    texts = {}
    for i, t in docs:
        if t is not None and i in label:
            texts.setdefault(t, []).append(label[i])
    want = {(int(sum(v) / len(v) >= 0.5), t) for t, v in texts.items()}
    for _ in range(2):
        assert {tuple(r) for r in toxicity.training_sample(df, y).collect()} == want
    few = toxicity.training_sample(df, y, max_chars=1000).collect()
    for c in (0, 1):
        own = [len(r.text) for r in few if r.toxic == c]
        assert 1000 <= sum(own) < 1000 + max(own)
    assert {tuple(r) for r in few} <= want and toxicity.fit(df, y) == toxicity.fit(df, y)


def test_fit_climbs_to_the_best_field():
    r = random.Random(4)
    segments = []
    for _ in range(300):
        labels = [int(r.random() < 0.3) for _ in range(r.randrange(1, 9))]
        segments.append(([r.choice(["bad", "odd"] if x else ["good", "fine", "odd"]) for x in labels], labels))

    def loss(model):
        total, t = 0.0, np.exp(np.array(model.move))
        for words, labels in segments:
            phi = np.stack([np.ones(len(words)), np.exp(model.emissions(words))], 1)
            v, gold, last = np.array([1.0, 0.0]), 0.0, 0
            for k, x in enumerate(labels):
                gold += math.log(t[last, x] * phi[k, x])
                v, last = v @ t * phi[k], x
            total += math.log(v.sum()) - gold
        return total / len(segments)

    best = toxicity.fit_field(segments, steps=400)
    for name in [*best.weights, None]:
        for change in (-0.2, 0.2):
            other = toxicity.Field(dict(best.weights), best.bias, best.move)
            if name:
                other.weights[name] += change
            else:
                other.bias += change
            assert loss(other) > loss(best) - 1e-3
