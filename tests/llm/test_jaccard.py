import random
import re

from loomtrail.llm import jaccard, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    ids = [i for i, _ in rows if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, brute_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i) if s else i) for i, s in sets), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 40, 90, 200]))] for _ in range(25)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w += passage
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_sets_equal_brute_force():
    texts = ["", "one", "A b\tC d", "a b c d e", "A b c d e f\x0b g  \x0c h", "x y z", " lead and trail ", "É é e"]
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(s) == len(brute_set(t)), t
    low, up = shingles.shingle_sets(["a b c d e", "A B C D E"])
    assert (low == up).all()


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, gram string, label int").repartition(5)
        assert got(jaccard.components(df)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, "  "), (None, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (6, "Q R S T U V"), (7, long), (8, long + " end"), (9, "tiny"), (10, "tiny"), (7, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.components(df)) == brute(rows)
    assert jaccard.components(df.limit(0)).count() == 0


def test_many_unlinked_classes_share_one_shingle(spark):
    # short texts with one common shingle and nothing else in common: leaders must retire one after another
    rows = [(i, "c1 c2 c3 c4 c5 " + f"x{i}") for i in range(30)] + [(100 + i, "c1 c2 c3 c4 c5 " + f"x{i}") for i in range(3)]
    assert got(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_shingles_are_dealt_in_parts(spark):
    r = random.Random(8)
    common = "the very same five words and some more of them here"
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(0, 6))) + " " + common) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace("more", "less")) for i in range(0, 300, 3)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, salt int, gram int")
    usual = jaccard.HOT
    try:
        jaccard.HOT = 4
        got = sorted(tuple(x) for x in jaccard.components(df).collect())
    finally:
        jaccard.HOT = usual
    assert got == sorted(brute(rows)) and len({c for *_, c in got}) < len(got)
