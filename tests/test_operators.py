import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import text
from loomtrail.operators import distances, index, motifs, sequences, statistics

# Strings and what remains of them.
ANONYMISED = [
    ("cd /Users/jdoe/src/app && pytest -q", "cd ~/src/app && pytest -q"),
    ("/root/.ssh/known_hosts", "~/.ssh/known_hosts"),
    (r"C:\Users\jdoe\Documents\notes.txt", r"~\Documents\notes.txt"),
    ("%2FUsers%2Fjdoe%2Fsrc", "~%2Fsrc"),
    ("/var/folders/zz/8kq1n0s7xz/T/tmpabc.json", "/var/folders/<tmp>/T/tmpabc.json"),
    ("su jdoe && whoami", "su anon && whoami"),
    ("host jdoe-mbp is up", "host anon is up"),
    ("resolved Janes-MacBook-Pro.local ok", "resolved <host> ok"),
    ("ssh jdoe@Janes-MacBook-Pro.local", "ssh <email>"),
    ("contact jane.doe+ci@example.co.uk", "contact <email>"),
    ("curl http://192.168.1.42:8080/health", "curl http://<ip>:8080/health"),
    ("arp -a 3c:22:fb:1a:2b:3c", "arp -a <ip>"),
    ("git remote add origin git@github.com:janedoe/proj.git", "git remote add origin git@<host>:<user>/proj.git"),
    ("git clone https://github.com/janedoe/proj.git", "git clone https://github.com/<user>/proj.git"),
    ("-H 'Authorization: Bearer " + "x" * 40 + "'", "-H 'Authorization: Bearer <token>'"),
    ('{"api_key": "abcdefgh12345678"}', '{"api_key": "<redacted>"}'),
    ("settings.local.json", "settings.local.json"),
    ("2026-09-02T20:41:33.123Z", "2026-09-02T20:41:33.123Z"),
    ("version 1.2.3 build 4", "version 1.2.3 build 4"),
    ("/some/root/dir", "/some/root/dir"),
]


def test_anonymise(spark):
    once = text.anonymise(F.col("s"), ["jdoe-mbp", "jdoe"])
    rows = spark.createDataFrame(ANONYMISED, "s string, want string").select("want", once.alias("s")).withColumn("again", once).collect()
    assert [r.s for r in rows] == [w for _, w in ANONYMISED]
    assert all(r.again == r.s for r in rows)


def test_anonymise_reaches_every_string(spark):
    df = spark.createDataFrame([((["a@b.org", None], {"k@k.org": "c@d.org"}),)], "x struct<l: array<string>, m: map<string,string>>")
    row = text.anonymise_frame(df).first()
    assert row.x.l == ["<email>", None] and row.x.m == {"k@k.org": "<email>"}
    assert {r.kind: r.n for r in text.residual_counts(df).collect()}["email"] == 2
    assert spark.range(1).select(text.mask(F.lit("/Users/jonathan"))).first()[0] == "/Users/jo******"


@pytest.mark.parametrize("action, atom", [
    ("open src/main.py", "OPEN_SRC_PY"), ("edit 3:4\nx", "EDIT"), ("A_B=1 C=2 python manage.py test", "RUN_PYTHON_SRC_PY"), ("pytest -q tests/test_b.py", "RUN_PYTEST_TEST_PY"), ("python x", "RUN_PYTHON_ALL"),
    ("ls -la", "SHELL_LS"), ("find . -name x", "FIND_FILE"), ("search_dir foo", "SEARCH"), ("submit", "SUBMIT"), ("# note", "COMMENT"), ("", "EMPTY"), ("make html", "RUN_MAKE"), ("sed -i s/a/b/ f", "SHELL_SED"),
    ("foo bar", "UNKNOWN_FOO"), ("./bin/test all", "RUN_TEST_SCRIPT"), ("exit_cost", "EXIT_ERROR"), ("create", "CREATE_UNKNOWN"), (None, "EMPTY"),
])
def test_action_atoms(spark, action, atom):
    assert spark.createDataFrame([(action,)], "a string").select(text.action_atom(F.col("a"))).first()[0] == atom


def test_merge_pair_and_bpe(spark):
    df = spark.createDataFrame([(0, list("AAABAB")), (1, list("AB")), (2, []), (3, list("AAAA"))], "id long, seq array<string>")
    assert df.orderBy("id").select(sequences.merge_pair(F.col("seq"), "A", "A", "A+A")).first()[0] == ["A+A", "A", "B", "A", "B"]
    model, out = motifs.train_bpe(df, target_size=4)
    assert model.merges == [("A", "A", "A+A", 5), ("A", "B", "A+B", 3)]
    assert [r.seq for r in out.orderBy("id").collect()] == [["A+A", "A+B", "A+B"], ["A+B"], [], ["A+A", "A+A"]]
    assert [r.seq for r in motifs.apply_bpe(df, model).orderBy("id").collect()] == [r.seq for r in out.orderBy("id").collect()]
    bits = motifs.description_length(out, 2, 2).first()
    assert bits.n_tokens == sum(len(r.seq) for r in out.collect()) and bits.vocab_bits == pytest.approx(2 * math.log2(3) + 2 * math.log2(4))


def test_statistics(spark):
    d = spark.createDataFrame([("g", "x", 0.5), ("g", "y", 0.5), ("h", "y", 1.0), ("k", "z", 1.0)], "agent string, item string, p double")
    jsd = {(r.group_a, r.group_b): r.jsd for r in statistics.jsd_matrix(d, "agent", "item").collect()}
    assert jsd["g", "k"] == pytest.approx(1) and jsd["h", "k"] == pytest.approx(1) and jsd["g", "h"] == pytest.approx(0.3112781, abs=1e-6)
    t = spark.createDataFrame([("m", 10, 5, 3, 12), ("m", 8, 2, 4, 6), ("m", 1, 0, 0, 0), ("zero", 1, 0, 0, 1)], "motif string, a long, b long, c long, d long")
    out = {r.motif: r for r in statistics.mantel_haenszel(t, ["motif"]).collect()}
    assert out["m"].odds_ratio == pytest.approx((120 / 30 + 48 / 20) / (15 / 30 + 8 / 20)) and 0 < out["m"].p < 0.05 and out["zero"].p == 1
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id long, p double")
    assert [r.q for r in statistics.benjamini_hochberg(p, "p", "id").orderBy("id").collect()] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    f = spark.createDataFrame([(8, 2, 1, 5)], "a long, b long, c long, d long").select(statistics.fisher_exact("a", "b", "c", "d")).first()[0]
    assert f == pytest.approx(0.0349650, abs=1e-6)
    low, high = spark.range(1).select(*statistics.wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == (pytest.approx(0.4901625, abs=1e-4), pytest.approx(0.9433178, abs=1e-4))
    shuffled = statistics.shuffled_labels(spark.createDataFrame([(k, k % 3) for k in range(12)], "id long, label long"), "label", "id", 5)
    assert all(sorted(r.label for r in rows) == sorted(k % 3 for k in range(12)) for _, rows in itertools.groupby(shuffled.orderBy("permutation").collect(), lambda r: r.permutation))


def brute_tree(a, b):
    """Forest edit distance by definition; a forest is a tuple of (label, children)."""
    from functools import cache

    size = lambda f: sum(1 + size(c) for _, c in f)

    @cache
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (la, ca), (lb, cb) = f[-1], g[-1]
        return min(d(f[:-1] + ca, g) + 1, d(f, g[:-1] + cb) + 1, d(f[:-1], g[:-1]) + d(ca, cb) + (la != lb))

    return d((a,), (b,))


def random_tree(r, depth=3):
    return (r.choice("ab"), tuple(random_tree(r, depth - 1) for _ in range(r.randrange(3) if depth else 0)))


def post_order(tree):
    labels, parents = [], []

    def walk(t):
        own = [walk(c) for c in t[1]]
        labels.append(t[0])
        parents.append(-1)
        for c in own:
            parents[c] = len(labels) - 1
        return len(labels) - 1

    walk(tree)
    return labels, parents


def test_tree_distance_equals_definition():
    r = random.Random(1)
    for _ in range(60):
        a, b = random_tree(r), random_tree(r)
        assert distances.tree_distance(post_order(a), post_order(b)) == brute_tree(a, b)


def test_dtw():
    assert distances.dtw_similarity(list("aab"), list("ab")) == 1 and distances.dtw_similarity([], ["a"]) == 0 and distances.dtw_similarity(["a"], ["b"]) == 0


def test_index_is_incremental(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    records = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id long, text string")
    first = spark.createDataFrame(index.build(None, records, encode).collect(), "id long, sha string, vector array<double>")
    assert seen.value == 3
    later = spark.createDataFrame([(1, "a"), (2, "changed"), (4, "d")], "id long, text string")
    assert index.lookup(first, later) is None
    second = index.build(first, later, encode).collect()
    assert seen.value == 5 and {r.id: r.vector for r in second} == {1: [1.0], 2: [7.0], 4: [1.0]}
    states = {r.id: r.state for r in index.changes(first, later.select("id", F.sha2("text", 256).alias("sha"))).collect()}
    assert states == {1: "kept", 2: "changed", 3: "removed", 4: "new"}
    with pytest.raises(ValueError):
        index.build(None, records.union(records), encode)


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    from loomtrail.streaming import windows

    src = "/root/testdata/sf0.001/events.parquet"
    stream = windows.windowed_counts(windows.event_stream(spark, src))
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start, r.event_type): r.n for r in spark.table("closed").collect()}
    batch = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").count().collect()
    want = {(r.window.start, r.event_type): r["count"] for r in batch}
    assert got and all(want[k] == n for k, n in got.items())
