"""Exact copies against plain Python."""

import hashlib
import re

from repograin.llm import exact_dedup

ROWS = [
    (5, "a b\n c"), (3, "a  b c"), (9, "a b c "), (4, None), (2, ""), (8, "alone"), (7, "x" * 300_000), (6, "x" * 300_000), (1, " "), (None, "a b c"), (None, "no key"), (None, "no key"),
    (11, "tie"), (11, "tie"), *((100 + i, "hot text") for i in range(300)), *((1000 + i, f"text {i}") for i in range(500)),
]


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_verdicts(docs):
    from pyspark.sql import functions as F

    df = docs(ROWS).withColumn("sha", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("h", F.lit(1))
    got = exact_dedup.verdicts(df).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in ROWS:
        own = groups[norm(t)]
        want.append((i, min((x for x in own if x is not None), default=None), len(own), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_keep_first(docs):
    got = exact_dedup.keep_first(docs(ROWS))
    first = {}
    for i, t in ROWS:
        k = norm(t)
        first[k] = min([first[k], i] if k in first else [i], key=lambda x: (x is None, x))
    assert sorted(((norm(r.text), r.doc_id) for r in got.collect()), key=str) == sorted(first.items(), key=str)


def test_the_filter_finds_every_repeat(docs):
    from pyspark.sql import functions as F

    hashes = docs(ROWS).select(F.xxhash64(exact_dedup.normalized(F.col("text"))).alias("h"))
    bloom, words = exact_dedup.repeated_cells(hashes, hashes.count())
    tested = exact_dedup.probe(hashes, F.col("h"), bloom, words).groupBy("h").agg(F.count("*").alias("n"), F.min("maybe").alias("maybe")).collect()
    assert all(r.maybe for r in tested if r.n > 1)
    assert sum(r.maybe for r in tested if r.n == 1) < 0.1 * len(tested)


def test_empty_table(docs):
    assert exact_dedup.verdicts(docs([])).collect() == [] and exact_dedup.keep_first(docs([])).collect() == []
