"""Fingerprints against a plain-Python version, and likeness against true Jaccard similarity."""

import hashlib
import re

import xxhash

from repograin.llm import minhash

TEXTS = [
    (7, "a b c d e f g h"), (5, None), (3, ""), (9, "one"), (2, " \t one \n two "), (11, "é" * 10 + " ü x y z w v"),
    (4, " ".join(f"w{i % 700}x{i // 3}" for i in range(3000))), (8, " ".join(f"v{i}" for i in range(90))), (6, "a b c d e f g h"), (1, " ".join(f"v{i}" for i in range(30, 120))),
]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed=h)
    return signed(h)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_print(text):
    bins = {}
    for s in shingles(text):
        h = long_hash(*[w.encode() for w in s])
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    if not bins:
        return ""
    out = []
    for b in range(256):
        if b not in bins:
            tries = [int_hash(b, t) % 256 for t in range(8)]
            slot = next((t for t in tries if t in bins), None)
            if slot is None:
                slot = min((mixed(b, j) for j in bins)) & 255
            out.append(bins[slot] & 15)
        else:
            out.append(bins[b] & 15)
    return "".join(f"{x:x}" for x in out)


def int_hash(*values):
    """Spark hashes a 32-bit value by the four-byte step of XXH64, which one-shot hashing of four bytes equals."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed=h)
    return signed(h)


def mixed(b, j):
    h = xxhash.xxh64_intdigest(b.to_bytes(4, "little"), seed=42)
    h = xxhash.xxh64_intdigest((j - 128).to_bytes(8, "little", signed=True), seed=h)
    return (signed(h) & -256) | j


def test_equals_plain_version(docs):
    got = {r.doc_id: r for r in minhash.edited_neighbours(docs(TEXTS)).collect()}
    order = sorted(TEXTS, key=lambda r: -r[0])
    assert len(got) == len(TEXTS)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_print(text)
        assert r.edited_fingerprint == plain_print(edited)
        for estimate, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= estimate <= 1 and abs(estimate - true) < 0.16, (doc_id, estimate, true)
    assert got[7].fingerprint == got[6].fingerprint


def test_repeated_rows_null_keys_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "no key at all"), (2, None)]
    df = docs(rows).withColumn("key", F.lit(1)).withColumn("body", F.lit("x")).withColumn("mark", F.lit(2)).withColumn("print", F.lit("p"))
    got = minhash.edited_neighbours(df).collect()
    assert len(got) == len(rows)
    assert len({(r.edited_sha256, r.near_next) for r in got if r.doc_id == 1 and r.n_chars == 5}) == 1


def test_empty_table_and_one_row(docs):
    assert minhash.edited_neighbours(docs([])).collect() == []
    only = minhash.edited_neighbours(docs([(1, "a b c d e f")])).collect()[0]
    assert only.near_next == 1.0
