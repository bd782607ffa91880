"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so tokens are labelled first: features of words (the word, its beginnings of 3 to 6 letters)
that occur, once or REPEATS times, in toxic training documents far more often than chance allows, and in many different
contexts, mark tokens, which take the label of their document. A two-state chain field is fitted to all words of these
documents, in stretches of SEGMENT words, and scores all words of a text: forward-backward gives each word's marginal p. A document's evidence is the sum of
log(p / (1 - p)) over words that are likelier toxic than not, so that many doubtful words weigh less than a certain one; a
logistic curve fitted to training documents turns it into the score. Runs of words over SPAN_AT are its offending spans. The chain is evaluated in chunks joined by a scan, so long texts cost no more per
word than short ones, and nothing is cut.

The fit uses a sample of the labelled rows: of each class the max_train with the smallest hashes, as long as those before
have fewer than max_chars characters together. Everything in the sample counts: whole texts, all marks, all words. Scoring and
statistics cover all documents.

Defined cases: a null or wordless text has no evidence; null ids are scored and never held out; repeated rows each get a row;
an id that is labelled both ways is toxic; equal texts with different labels are one text, toxic if at least half of their
labels are; without labels of both classes every score is next to 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

MAX_TRAIN, MAX_TRAIN_CHARS = 4000, 8_000_000  # labelled rows and characters of each class
FIT_STEPS, L2, SEGMENT, LEAST_SEGMENTS = 100, 1e-4, 64, 3
THRESHOLD, SPAN_AT, REPEATS, MOST_EVIDENCE = 0.7, 0.5, 3, 30.0
CHUNK, CACHE_WORDS, COUNTED = 64, 150_000, 100_000
_WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    w = word.lower()
    return [w, *("^" + w[:k] for k in range(3, 7) if len(w) > k)]


@dataclass
class Field:
    """Weights are differences toxic minus plain; `move[a][b]` weighs label b after a. A text begins after plain."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    move: tuple = ((0.0, 0.0), (0.0, 0.0))
    slope: float = 0.0
    level: float = -20.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        values = list(map(known.get, words))
        if None in values:
            if len(known) > CACHE_WORDS:
                known.clear()
            get = self.weights.get
            for i, v in enumerate(values):
                if v is None:
                    w = words[i]
                    v = known.get(w)
                    if v is None:
                        v = known[w] = max(-30.0, min(30.0, self.bias + sum(get(f, 0.0) for f in features(w))))
                    values[i] = v
        return np.array(values, np.float64)

    def document_score(self, p: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence(p) + self.level))))

    def marginals(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Each word's probability to be toxic, from the emissions of whole texts."""
        lengths = np.array([len(e) for e in texts])
        chunks = -(-lengths // CHUNK)
        total = int(chunks.sum())
        if not total:
            return [np.zeros(0) for _ in texts]
        first = np.cumsum(chunks) - chunks
        flat, real = np.zeros(total * CHUNK), np.zeros(total * CHUNK, bool)
        for e, at in zip(texts, first.tolist(), strict=True):
            flat[at * CHUNK : at * CHUNK + len(e)] = e
            real[at * CHUNK : at * CHUNK + len(e)] = True
        ex, real = np.exp(flat).reshape(total, CHUNK).T.copy(), real.reshape(total, CHUNK).T.copy()
        t = np.exp(np.array(self.move))
        step = np.empty((CHUNK, 2, 2, total))
        for a in range(2):  # the identity where a chunk is padded
            step[:, a, 0] = np.where(real, t[a, 0], 1.0 - a)
            step[:, a, 1] = np.where(real, t[a, 1] * ex, float(a))
        product = step[0].copy()
        for k in range(1, CHUNK):
            m = step[k]
            product = np.stack([np.stack([product[a, 0] * m[0, b] + product[a, 1] * m[1, b] for b in range(2)]) for a in range(2)])
            product /= product.max((0, 1))
        ahead, behind = np.empty((2, total)), np.empty((2, total))
        for k in range(int(chunks.max())):  # the state that enters each chunk, and what follows it
            own = np.flatnonzero(chunks > k)
            at = first[own] + k
            if k == 0:
                ahead[:, at] = np.array([[1.0], [0.0]])
            else:
                p, v = product[:, :, at - 1], ahead[:, at - 1]
                new = v[0] * p[0] + v[1] * p[1]
                ahead[:, at] = new / new.sum(0)
            at = first[own] + chunks[own] - 1 - k
            if k == 0:
                behind[:, at] = 0.5
            else:
                p, v = product[:, :, at + 1], behind[:, at + 1]
                new = p[:, 0] * v[0] + p[:, 1] * v[1]
                behind[:, at] = new / new.sum(0)
        forward = np.empty((CHUNK, 2, total))
        v = ahead
        for k in range(CHUNK):
            m = step[k]
            v = np.stack([v[0] * m[0, b] + v[1] * m[1, b] for b in range(2)])
            v /= v.sum(0)
            forward[k] = v
        out = np.empty((CHUNK, total))
        v = behind
        for k in range(CHUNK - 1, -1, -1):
            both = forward[k] * v
            out[k] = both[1] / both.sum(0)
            m = step[k]
            v = np.stack([m[a, 0] * v[0] + m[a, 1] * v[1] for a in range(2)])
            v /= v.sum(0)
        flat = out.T.reshape(-1)
        return [flat[at * CHUNK : at * CHUNK + n] for at, n in zip(first.tolist(), lengths.tolist(), strict=True)]


def evidence(p: np.ndarray) -> float:
    p = p[p > 0.5].clip(max=1 - 1e-9)
    return min(MOST_EVIDENCE, float(np.log(p / (1 - p)).sum()))


def fit_curve(x: list[float], y: list[int], toxic_share: float) -> tuple[float, float]:
    """Slope and level of a logistic curve (Newton's method, slightly damped), its level moved to the true share of toxic documents."""
    a = np.array([np.array(x, float), np.ones(len(x))]).T
    y, w = np.array(y, float), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    odds = lambda s: math.log(s / (1 - s))
    return float(w[0]), float(w[1]) + odds(toxic_share) - odds(y.mean())


def fit_field(segments: list[tuple[list[str], list[int]]], steps: int = FIT_STEPS, l2: float = L2) -> Field:
    """The field fitted to segments of words and labels."""
    vocabulary: dict[str, int] = {}
    tokens = np.array([vocabulary.setdefault(w, len(vocabulary)) for words, _ in segments for w in words], np.int32)
    y = np.array([x for _, labels in segments for x in labels], np.int8)
    return fit_tokens(list(vocabulary), tokens, y, np.array([len(w) for w, _ in segments], np.int64), steps, l2)


def _feature_table(vocabulary: list[str], tokens: np.ndarray, segment: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names of the features that LEAST_SEGMENTS segments have, and pairs (word, feature). In Arrow arrays: as Python objects they would be most of the driver's memory."""
    import pyarrow.compute as pc

    key = tokens.astype(np.int64)
    key *= int(segment[-1]) + 1
    key += segment
    key.sort()
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    in_segments = np.bincount(key // (int(segment[-1]) + 1), minlength=len(vocabulary))
    del key
    lower = pa.array([w.lower() for w in vocabulary], pa.large_string())
    size, parts, words = pc.utf8_length(lower).to_numpy(), [lower], [np.arange(len(vocabulary), dtype=np.int32)]
    for k in range(3, 7):
        some = np.flatnonzero(size > k).astype(np.int32)
        parts.append(pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), pc.utf8_slice_codeunits(lower.take(pa.array(some)), 0, k), pa.scalar("", pa.large_string())))
        words.append(some)
    coded = pa.concat_arrays(parts).dictionary_encode()
    word, column = np.concatenate(words), coded.indices.to_numpy()
    often = np.bincount(column, in_segments[word], len(coded.dictionary))
    kept = np.flatnonzero(often >= LEAST_SEGMENTS)
    number = np.full(len(often), -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    used = number[column] >= 0
    return coded.dictionary.take(pa.array(kept)), word[used], number[column[used]]


def fit_tokens(vocabulary: list[str], tokens: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = FIT_STEPS, l2: float = L2) -> Field:
    """Maximum likelihood with an L2 penalty by gradient ascent with momentum. tokens: numbers of words, segment after segment.

    A word's emission is computed once a step, whatever number of tokens it has."""
    if not len(tokens) or not y.any():
        return Field()
    many, n = len(lengths), int(lengths.max())
    starts = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(many, dtype=np.int32), lengths)
    place = (np.arange(len(tokens), dtype=np.int32) - starts.astype(np.int32)[segment]).astype(np.int16)
    # positions by segments: one row of arrays for each place in a segment
    grid = np.full((n, many), -1, np.int32)
    grid[place, segment] = tokens
    gold = np.zeros((n, many), np.int8)
    gold[place, segment] = y
    del place
    names, word, column = _feature_table(vocabulary, tokens, segment)
    del segment
    real = grid >= 0
    before = np.concatenate([np.zeros((1, many), np.int8), gold[:-1]])
    seen = np.bincount((2 * before + gold)[real], minlength=4).reshape(2, 2).astype(float)
    weights, bias, move = np.zeros(len(names)), math.log((int(y.sum(dtype=np.int64)) + 1) / (len(y) + 2)), np.zeros((2, 2))
    speed = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
    second = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
    marked = int(y.sum(dtype=np.int64))  # the likelihood is taken per marked word, so the penalty weighs alike in long and short texts
    for step in range(1, steps + 1):
        ex = np.exp((bias + np.bincount(word, weights[column], len(vocabulary))).clip(-30, 30))
        t = np.exp(move)
        forward = np.empty((n + 1, many), np.float32)  # the probability of label 1 so far; label 0 has the rest
        forward[0] = 0.0
        for k in range(n):
            p = forward[k].astype(np.float64)
            one = ((1 - p) * t[0, 1] + p * t[1, 1]) * ex[grid[k]]
            new = one / (one + (1 - p) * t[0, 0] + p * t[1, 0])
            forward[k + 1] = np.where(real[k], new, p)
        expected, error, b = np.zeros((2, 2)), np.zeros(len(vocabulary)), np.full(many, 0.5)  # b: what follows, for label 1
        for k in range(n - 1, -1, -1):
            p, here = forward[k].astype(np.float64), real[k]
            one, none = b * ex[grid[k]], 1 - b
            pair = [[(1 - p) * t[0, 0] * none, (1 - p) * t[0, 1] * one], [p * t[1, 0] * none, p * t[1, 1] * one]]
            total = pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]
            for i in range(2):
                for j in range(2):
                    expected[i, j] += (pair[i][j] / total)[here].sum()
            marginal = (pair[0][1] + pair[1][1]) / total
            error += np.bincount(grid[k][here], (gold[k] - marginal)[here], len(vocabulary))
            up, down = t[1, 0] * none + t[1, 1] * one, t[0, 0] * none + t[0, 1] * one
            b = np.where(here, up / (up + down), b)
        slopes = [np.bincount(column, error[word], len(names)) / marked - l2 * weights, error.sum() / marked, (seen - expected) / marked - l2 * move]
        for i, g in enumerate(slopes):
            speed[i] = 0.9 * speed[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
        change = [0.3 * (s / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6) for s, q in zip(speed, second, strict=True)]
        weights, bias, move = weights + change[0], bias + float(change[1]), move + change[2]
    keep = {names[int(k)].as_py(): float(weights[k]) for k in np.flatnonzero(np.abs(weights) > 1e-3)}
    return Field(keep, float(bias), tuple(map(tuple, move.tolist())))


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by feature and label, given out whenever COUNTED features are held, so a feature may have several rows."""
    once, often = (Counter(), Counter()), (Counter(), Counter())

    def out(toxic: int) -> Iterator[pa.RecordBatch]:
        names = list(once[toxic])
        for k in range(0, len(names), 20_000):
            some = names[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([once[toxic][f] for f in some], pa.int64()), pa.array([often[toxic][f] for f in some], pa.int64()), pa.array([toxic] * len(some), pa.int64())], names=["feature", "n1", "n3", "toxic"])
        once[toxic].clear()
        often[toxic].clear()

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Counter()
            for w, n in Counter(_WORDS.findall(text or "")).items():
                for f in features(w):
                    own[f] += n
            once[toxic].update(own.keys())
            often[toxic].update(f for f, n in own.items() if n >= REPEATS)
            if len(once[toxic]) >= COUNTED:
                yield from out(toxic)
    for toxic in (0, 1):
        yield from out(toxic)


def _contexts(marks: frozenset):
    def run(batches):
        for batch in batches:
            rows = set()
            for text in batch.column(1).to_pylist():
                words = _WORDS.findall(text or "")
                for k, w in enumerate(words):
                    for f in features(w):
                        if f in marks:
                            rows.add((f, (words[k - 1] if k else "") + " " + (words[k + 1] if k + 1 < len(words) else "")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["feature", "context"])

    return run


def _segments(marks: frozenset):
    """All words of the sample in stretches of SEGMENT, with 1 for marked ones of toxic texts."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            words, hits = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _WORDS.findall(text or "")
                if toxic:
                    for w in own:
                        if w not in known:
                            known[w] = int(any(f in marks for f in features(w)))
                for k in range(0, len(own), SEGMENT):
                    some = own[k : k + SEGMENT]
                    words.append(some)
                    hits.append([known[w] for w in some] if toxic else [0] * len(some))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int8()))], names=["words", "hits"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """toxic, text: labelled texts that are not held out, at most max_train of each class and, but for the last one, max_chars characters."""
    known = _known(labels)
    order = F.md5(F.col("doc_id").cast("string"))
    ids = known.where("toxic = 1").orderBy(order).limit(max_train).unionByName(known.where("toxic = 0").orderBy(order).limit(max_train))
    ids = stored(ids.select("doc_id", "toxic", order.alias("place")), "train-ids")  # 2 * max_train rows at most, so they may be broadcast
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").where("text IS NOT NULL")
    texts = stored(labelled.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("long").alias("toxic"), F.min("place").alias("place")), "train-texts")
    before = Window.partitionBy("toxic").orderBy("place", "text_hash").rowsBetween(Window.unboundedPreceding, -1)  # as many narrow rows as ids, but for repeated ids
    narrow = texts.select("toxic", "place", F.xxhash64("text").alias("text_hash"), F.length("text").alias("chars"))
    kept = narrow.withColumn("so_far", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("so_far") < max_chars).select("place", "text_hash")
    return stored(texts.withColumn("text_hash", F.xxhash64("text")).join(kept, ["place", "text_hash"], "left_semi").select("toxic", "text"), "train")


def _known(labels: DataFrame) -> DataFrame:
    return labels.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Field:
    """The field fitted to a bounded sample of labelled documents that are not held out."""
    prepare(docs.sparkSession)
    sample = training_sample(docs, labels, max_train, max_chars)
    count = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return Field()
    share = count[1] / (count[0] + count[1])
    side = lambda n, toxic, name: F.sum(F.when(F.col("toxic") == toxic, F.col(n)).otherwise(0)).alias(name)
    by_feature = stored(
        sample.mapInArrow(_count_features, "feature string, n1 long, n3 long, toxic long").groupBy("feature").agg(side("n1", 1, "bad1"), side("n1", 0, "good1"), side("n3", 1, "bad3"), side("n3", 0, "good3")), "features"
    )
    # a mark must be less likely by chance than one in the number of features (likelihood ratio against the share of toxic documents)
    least = math.log(max(10, by_feature.count()))

    def telling(bad: str, good: str) -> Column:
        b, g = F.col(bad).cast("double"), F.col(good).cast("double")
        ratio = b * F.log(b / ((b + g) * share)) + F.when(g > 0, g * F.log(F.when(g > 0, g).otherwise(1.0) / ((b + g) * (1 - share)))).otherwise(0.0)
        return F.when((b >= 4) & (b >= 4 * g), ratio >= least).otherwise(False)

    # all marks come to the driver: each is a feature of the bounded sample that four toxic texts have
    some = frozenset(r["feature"] for r in by_feature.where(telling("bad1", "good1") | telling("bad3", "good3")).select("feature").collect())
    if not some:
        return Field()
    # copies of one text repeat its words and their neighbours, so different contexts are what counts
    contexts = sample.where("toxic = 1").mapInArrow(_contexts(some), "feature string, context string").distinct().groupBy("feature").count()
    marks = frozenset(r["feature"] for r in contexts.where(F.col("count") * -math.log(share) >= least).select("feature").collect())
    # ordered, so that the fit is the same each time
    model = _fit_segments(sample.orderBy("toxic", F.md5("text")).mapInArrow(_segments(marks), "words array<string>, hits array<tinyint>"))
    seen = sorted(tuple(r) for r in sample.mapInArrow(_evidence(model), "toxic long, evidence double").collect())  # a number for each text of the sample
    all_known = {r["toxic"]: r["count"] for r in _known(labels).groupBy("toxic").count().collect()}
    model.slope, model.level = fit_curve([e for _, e in seen], [t for t, _ in seen], all_known[1] / (all_known[0] + all_known[1]))
    return model


def _fit_segments(segments: DataFrame) -> Field:
    found = segments.toArrow()
    words = found.column("words").combine_chunks()
    coded = words.values.dictionary_encode()
    tokens, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    lengths = words.value_lengths().to_numpy().astype(np.int64)
    y = found.column("hits").combine_chunks().values.to_numpy()
    del found, words, coded
    pa.default_memory_pool().release_unused()
    return fit_tokens(vocabulary, tokens, y, lengths)


def _evidence(model: Field):
    def run(batches):
        for batch in batches:
            p = model.marginals([model.emissions(_WORDS.findall(t or "")) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([evidence(x) for x in p], pa.float64())], names=["toxic", "evidence"])

    return run


def _score(model: Field, with_spans: bool, name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            words = [_WORDS.findall(t or "") for t in texts]
            p = model.marginals([model.emissions(w) for w in words])
            scores, spans = [], []
            for text, own in zip(texts, p, strict=True):
                scores.append(model.document_score(own))
                if with_spans:
                    found = []
                    if len(own) and own.max() >= SPAN_AT:
                        hot = set(np.flatnonzero(own >= SPAN_AT).tolist())
                        for k, m in enumerate(_WORDS.finditer(text)):
                            if k in hot:
                                if found and k - 1 in hot:
                                    found[-1]["end"] = m.end()
                                else:
                                    found.append({"start": m.start(), "end": m.end()})
                    spans.append(found)
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            names = [*batch.schema.names, name]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans array<struct<start, end>> (code points), a row per row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_drop_text(_score(model, True)), "doc_id long, score double, spans array<struct<start: int, end: int>>")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def _drop_text(run):
    def without(batches):
        for batch in run(batches):
            yield batch.select([n for n in batch.schema.names if n != "text"])

    return without


def keep_clean(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    prepare(docs.sparkSession)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(model, False, "__score"), ddl + ", __score double").where(F.col("__score") < threshold).drop("__score")
