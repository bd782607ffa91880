import random
from zlib import crc32

import numpy as np
import pytest

from loomtrail.llm import sstable, tokens

TEXTS = [
    "Hello  world, it's 2024!\n\n\tI've  done ... ",
    "",
    None,
    "naïve façade — Ünïcödé ½ Ⅷ ² 数字 emoji 🙂 \x1c\x85 x",
    "a<|endoftext|>b <|endoftext|>",
    "x" * 5000,
    " \n \n  trailing   ",
    "'s 't's''re don't \x01\x01 \x01",
    "Hello  world, it's 2024!\n\n\tI've  done ... ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def frame(spark):
    return spark.createDataFrame([(i if i != 6 else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, bucket string")


def test_split_and_encode_equal_the_library(library):
    vocab = tokens.Vocabulary(tokens.tokenizer_path())
    for text in filter(None, TEXTS):
        ids = next(vocab.ids([text]))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_characters_where_engines_could_differ(library):
    vocab = tokens.Vocabulary(tokens.tokenizer_path())
    for c in map(chr, [*range(0, 0x250), 0x2028, 0x3000, 0xFEFF, 0x660]):
        text = f"a{c}1 {c}{c} b"
        assert np.frombuffer(next(vocab.ids([text])), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_counts(spark, library):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame(spark)).collect()), key=str)
    want = []
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i != 6 else None, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(frame(spark).limit(0)).count() == 0


def test_shards_round_trip(spark, library):
    docs = frame(spark)
    manifest = sstable.write_shards(docs)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    order = [6, *[i for i in range(len(TEXTS)) if i != 6]]
    start = 0
    for row, i in zip(got, order, strict=True):
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i if i != 6 else None, start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = sstable.lookup(spark, manifest, [3, None, 99])
    assert found[3] == [[*library.encode(TEXTS[3], add_special_tokens=False).ids, 2]] and len(found[None]) == 1 and found[99] == []
    assert sstable.read_shards(sstable.write_shards(docs.limit(0))).count() == 0


def test_shard_file_of_many_blocks(tmp_path):
    path = tmp_path / "x.sst"
    rows = [(d, np.arange(d % 3000, dtype="<u4") + (70_000 if d % 7 == 0 else 0)) for d in sorted([-5, *range(0, 900, 3), 30])]
    with open(path, "wb") as f:
        w = sstable.Writer(f)
        for d, ids in rows:
            w.add(sstable.key_of(d), ids)
        w.close()
    with open(path, "rb") as f:
        r = sstable.Reader(f)
        assert len(r.index) > 1
        assert [(sstable.id_of(k), ids.tolist()) for k, _, ids in r] == [(d, ids.tolist()) for d, ids in rows]
        assert len(r.get(30)) == 2 and r.get(31) == [] and r.get(-5)[0].tolist() == rows[0][1].tolist()


def test_plain_texts_are_split_as_arrays(library, monkeypatch):
    """No string a pre-token is made, and a text's ids don't depend on its neighbours; the library gets new words in short calls."""
    vocab = tokens.Vocabulary(tokens.tokenizer_path())
    assert vocab.apart
    plain = [t or "" for t in TEXTS if tokens._PLAIN.fullmatch(t or "") and "<|" not in (t or "")]
    monkeypatch.setattr(vocab, "_split", lambda text: pytest.fail("a plain text was split into strings"))
    for texts in (plain, plain[::-1], ["", ""], []):
        assert [np.asarray(x).tolist() for x in vocab.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_array_splits_equal_the_regular_expression():
    draw = random.Random(7)
    for _ in range(5000):
        texts = ["".join(draw.choices("'''  \n\tstmdrevlaéªȳZ09.!\x00\x0b\x7f", k=draw.randrange(12))) for _ in range(draw.randrange(6))]
        parts = [t.encode() for t in texts]
        data, edge = b"".join(parts), np.cumsum([0, *map(len, parts)])
        at = [*tokens.starts(np.frombuffer(data, np.uint8), edge).tolist(), len(data)]
        assert [data[a:b].decode() for a, b in zip(at, at[1:])] == [p for t in texts for p in tokens._SPLIT(t)], texts


def test_ids_after_the_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    vocab = tokens.Vocabulary(tokens.tokenizer_path())
    for texts in ([t or "" for t in TEXTS], ["one two three four five six seven", "½ ²"], ["one two", "", TEXTS[3]]):
        assert [x.tolist() for x in vocab.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_a_token_could_join_are_split_by_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    crossing = models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "aĠ": 3, "Ġb": 4}, merges=[("a", "Ġ"), ("Ġ", "b")])
    whole = models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "Ġab": 3}, merges=[], ignore_merges=True)
    for i, model in enumerate((crossing, whole)):
        small = Tokenizer(model)
        small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        small.save(str(path := tmp_path / f"{i}.json"))
        vocab, text = tokens.Vocabulary(str(path)), "a a b ab ba a"
        assert not vocab.apart
        assert next(vocab.ids([text])).tolist() == small.encode(text).ids
