"""Encoding equals the tokenizer library's, whatever the leaves, and decoding is exact."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from repograin.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", " ", "  ", "\n", "'", "'s", "'r", "'ll", "é", "ß", "1", "23", ".", "!!", "　", "\t", "中", "文", "🙂", "́", "the", " and", "tion", "a" * 40, "ab" * 30]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_pattern_is_the_vocabularys():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("text_leaf,word_leaf,window", [(1, 1, 64), (2, 3, 2), (5, 2, 8), (4096, 16, 64)])
def test_trees_equal_the_library(vocabulary, library, monkeypatch, text_leaf, word_leaf, window):
    monkeypatch.setattr(byte_bpe, "LEAF_TEXT", text_leaf)
    monkeypatch.setattr(byte_bpe, "LEAF_WORD", word_leaf)
    monkeypatch.setattr(byte_bpe, "LEAF_WINDOW", window)
    monkeypatch.setattr(byte_bpe, "LEAF_IDS", 3)
    rng = random.Random(text_leaf)
    for _ in range(400):
        vocabulary.known.clear()
        vocabulary.older.clear()
        vocabulary.stays.cache_clear()
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        assert vocabulary.words(text) == vocabulary.pattern.findall(text)
        ids = vocabulary.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_long_runs(vocabulary, library):
    for text in ("a" * 20_000, "x" + " " * 30_000 + "y", "äbc" * 5_000, "word, " * 30_000):
        assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)


def test_spark_round_trip(docs, library):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "Plain text, it's here."), (3, "Plain text, it's here."), (None, "Größe 中文 🙂\n\n"), (5, "long " * 20_000)]
    df = docs(rows).withColumn("key", F.lit("clash"))
    got = byte_bpe.decode(byte_bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    once = byte_bpe.recode(df, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in once) == sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got)
    assert byte_bpe.encode(docs([]), PATH).collect() == []


def test_remembered_words_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 10)
    before = vocabulary.encode("one two three four five six seven eight nine ten eleven twelve")
    assert len(vocabulary.known) <= 10
    assert np.array_equal(before, vocabulary.encode("one two three four five six seven eight nine ten eleven twelve"))


def test_known_words_are_not_looked_up_one_by_one(vocabulary, library):
    text = "the same words again and again " * 50 + "ünknown" + "x" * 60
    vocabulary.known.clear()
    vocabulary.older.clear()
    made = []
    vocabulary.known.make = lambda word: made.append(word) or vocabulary.word(word)
    try:
        assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)
    finally:
        vocabulary.known.make = vocabulary.word
    assert len(made) == len(set(vocabulary.words(text)))


def test_a_worker_remembers_no_more_words_than_asked_for(docs, vocabulary, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    want = [vocabulary.encode(t).tolist() for t in texts]
    vocabulary.known.clear()
    vocabulary.older.clear()
    monkeypatch.setattr(vocabulary, "most", 30)
    assert [vocabulary.encode(t).tolist() for t in texts] == want and max(len(vocabulary.known), len(vocabulary.older)) <= 30
    df = docs([(i, t) for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.ids) for r in byte_bpe.recode(df, PATH, known=30).collect()) == list(enumerate(want))
