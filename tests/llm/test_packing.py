"""Packing against the tokenizer library and a plain version of the greedy rule."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from repograin.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  \n\t", "Don't WE'LL 'S ''s a'b", "ÀÉ'S Ü'd naïve ß, ...ÄÖß", "İstanbul Σας ΣΑΣ ǅ", "áb ́c", "x\x1cy \u0085z\xa0q r", "汉字 한글 ᄀ ᅡ", "\x01 a\x01b\x01\x01", "<|endoftext|>a <|startoftext|>", "×÷ª º µ ² ¼ ¿quién?", "1234 5,678.90", "\U0001f600\U0001f600 👩‍💻", "z" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def checked(rows, got, library, room=packing.ROOM, end=packing.END):
    """Every id in exactly one piece, no gap in a sequence, none over the room; returns the sequences' lengths."""
    from collections import Counter, defaultdict

    want = Counter()
    for doc_id, text in rows:
        want[(doc_id, np.array([*library(text or ""), end], "<u2").tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 2 * r.length > 0
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
        lengths.append(at)
    if len(want) == len(by_doc):
        for doc_id, parts in by_doc.items():
            parts.sort(key=lambda r: r.start)
            held = b"".join(bytes(r.ids) for r in parts)
            assert want[(doc_id, held)] == 1 and {r.doc_tokens for r in parts} == {len(held) // 2}
            assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
    assert sum(lengths) == sum(len(held) // 2 * n for (_, held), n in want.items())
    return lengths


def test_words_are_encoded_as_by_the_library(library):
    coder = packing.WordCoder(PATH)
    rng = np.random.default_rng(3)
    letters = "aab'stßÄé,.-_(){}1 9\n\tΣİ́汉 "
    texts = ODD + ["".join(rng.choice(list(letters), 200)) for _ in range(50)]
    ids, begin = coder.encode(pa.array([None, *texts]))
    assert begin[1] == 0
    for i, text in enumerate(texts):
        assert ids[begin[i + 1] : begin[i + 2]].tolist() == library(text), text


def test_a_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="not those of its words"):
        packing.WordCoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_texts_in_sequences_without_padding(spark, docs, library):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{rng.integers(0, 5000)}" for _ in range(rng.integers(0, 900)))) for i in range(120)]
    rows += [(1000 + i, text) for i, text in enumerate(ODD)] + [(2000, "long " * 30_000), (2001, None)]
    df = docs(rows).selectExpr("*", "1 AS piece", "'x' AS start", "2 AS ids", "3 AS key", "4 AS length", "5 AS sequence_id").repartition(5)
    for group_tokens in (1 << 20, 20_000):  # the smaller one needs several groups
        got = packing.pack(df, PATH, group_tokens=group_tokens).collect()
        lengths = checked(rows, got, library)
        assert all(n == packing.ROOM or n & (n - 1) == 0 for n in lengths)
        assert sum(n < packing.ROOM for n in lengths) <= 12 * max(1, -(-sum(lengths) // group_tokens))


def test_repeated_and_null_keys_and_an_empty_table(docs, library):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d"), (None, None), (1, "e")]
    got = packing.pack(docs(rows), PATH).collect()
    checked(rows, got, library)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got) == [("1", 2), ("1", 4), ("1", 4), ("None", 1), ("None", 2)]
    assert packing.with_crc32(packing.pack(docs([]), PATH), PATH).collect() == []


def test_crc32_is_of_32_bit_ids(docs, library):
    got = packing.with_crc32(packing.pack(docs(list(enumerate(ODD))), PATH), PATH).collect()
    assert {r.doc_id for r in got} == set(range(len(ODD)))
    for r in got:
        ids = [*library(ODD[r.doc_id]), 2][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_lay_out(lengths, room, ratio):
    caps = packing.capacities(sum(lengths), room)
    left, cost, out = list(caps), [0.0] * len(caps), []
    waiting = [(n, i, 0) for i, n in enumerate(lengths)]
    while waiting:
        waiting.sort(key=lambda w: (-w[0], w[1]))
        n, i, start = waiting.pop(0)
        able = [s for s in range(len(caps)) if left[s] >= n] or [s for s in range(len(caps)) if left[s] == max(left)]
        at = min(able, key=lambda s: (cost[s], s))
        taken = min(n, left[at])
        out.append((i, start, taken, at, caps[at] - left[at]))
        left[at] -= taken
        cost[at] += taken + taken * taken / ratio
        if taken < n:
            waiting.append((n - taken, i, start + taken))
    return out


@pytest.mark.parametrize("room", [64, 60])
def test_lay_out_equals_plain_version(room):
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = [int(n) for n in rng.integers(1, room + 1, rng.integers(1, 60))]
        got = packing.lay_out(lengths, room, 100)
        assert got == plain_lay_out(lengths, room, 100)
        caps = packing.capacities(sum(lengths), room)
        used = [sum(r[2] for r in got if r[3] == s) for s in range(len(caps))]
        assert used == caps and sum(caps) == sum(lengths)


def test_costs_are_balanced():
    rng = np.random.default_rng(6)
    lengths = [int(n) for n in np.minimum(4096, rng.lognormal(6, 1, 2000) + 1)]
    cost = {}
    for _, _, n, s, _ in packing.lay_out(lengths):
        cost[s] = cost.get(s, 0) + n + n * n / packing.RATIO
    first_fit, left = [], []  # longest first, to the first sequence that has room, whatever it costs
    for n in sorted(lengths, reverse=True):
        at = next((s for s, room in enumerate(left) if room >= n), len(left))
        if at == len(left):
            left.append(packing.ROOM)
            first_fit.append(0)
        left[at] -= n
        first_fit[at] += n + n * n / packing.RATIO
    full = [c for s, c in cost.items() if s < sum(lengths) // packing.ROOM]
    assert np.std(full) < 0.9 * np.std(first_fit[:-1])
