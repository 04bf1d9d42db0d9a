"""SimHash classes against all pairs, BK-tree search against a scan, and the near-copy filter."""

import re

import numpy as np
import xxhash

from repograin.llm import simhash
from repograin.llm.components import components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = {(k, t): plain(t) for k, t in rows}
    own = list(prints)
    root = {x: x for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for b in own[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for x in own:
        if x[0] is not None:
            low[find(x)] = min(low.get(find(x), x[0]), x[0])
    return sorted(((k, f"{prints[k, t]:016x}", low.get(find((k, t)))) for k, t in rows), key=str)


def rows_with_copies():
    rng = np.random.default_rng(3)
    rows = [(1000, None), (1001, " \n"), (1002, ""), (1003, "One"), (1004, "one"), (1005, "Äb c d e f"), (None, "one"), (1006, "a b"), (None, "lonely words of no key"), (1004, "one")]
    for base in range(40):
        words = [f"w{rng.integers(500)}" for _ in range(rng.integers(3, 400))]
        for copy in range(rng.integers(1, 6)):
            edited = list(words)
            for _ in range(copy):
                edited[rng.integers(len(edited))] = "Changed"
            rows.append((base * 10 + copy, " ".join(edited)))
    return rows


def test_classes_equal_all_pairs(docs, monkeypatch):
    rows = rows_with_copies()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_long_texts_count_all_shingles():
    text = " ".join(f"w{i % 977}" for i in range(80_000))
    assert int.from_bytes(simhash.simhash(text), "big") == plain(text)


def test_shards_cut_into_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 16)
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    values = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (150, 2))} | {int(v) for v in rng.integers(0, 1 << 62, 50)}
    values = sorted(values)
    df = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")
    found = {tuple(sorted(map(bytes, r))) for r in simhash.links(df, simhash.block_tables(), 2).collect()}

    def groups(edges):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return sorted(sorted(v for v in values if find(v) == r) for r in {find(v) for v in values})

    want = groups((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2)
    assert groups((int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in found) == want


def test_tree_search_equals_scan():
    rng = np.random.default_rng(7)
    nodes = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    nodes[100:200] = nodes[:100] ^ np.uint64(5)
    queries = np.concatenate([nodes[::7], rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)])
    tree = simhash.BKTree(nodes)
    for radius in (0, 2, 4, 50):
        got = {(int(a), int(b)) for q, n in tree.search(queries, radius) for a, b in zip(q, n)}
        d = np.bitwise_count(queries[:, None] ^ nodes[None]).sum(axis=2, dtype=int)
        assert got == {tuple(map(int, p)) for p in np.argwhere(d <= radius)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 1001), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 5000: 1000}
    assert components(edges.where("a < 0")).count() == 0


def test_keep_one_drops_near_copies_only(docs):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    rows, near = [(900, None), (901, ""), (None, "no key " * 20), (902, "short text")], []
    for base in range(30):
        words = [f"w{rng.integers(5000)}" for _ in range(200)]
        rows.append((base * 10, " ".join(words)))
        if base % 2:
            edited = list(words)
            edited[50], edited[120] = "x", "y"  # similarity about 0.9
            rows.append((base * 10 + 1, " ".join(edited)))
            near.append(base * 10 + 1)
    df = docs(rows).withColumn("key", F.lit(1)).withColumn("fp", F.lit("clash"))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((k for k, _ in rows if k not in near), key=str)


def test_empty_table(docs):
    assert simhash.classes(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []
