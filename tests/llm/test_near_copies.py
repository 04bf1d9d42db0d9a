"""The near-copy filter against all pairs of shingle sets."""

import itertools
from fractions import Fraction

import numpy as np

from repograin.llm import near_copies, simhash


def plain(rows, similarity=Fraction(4, 5), shingle=5):
    """Ids that stay: the least of each component of the pairs at or above the similarity."""
    sets = {}
    for k, text in rows:
        words = (text or "").lower().split()
        size = min(shingle, len(words))
        sets[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(k for k in sets if find(k) == k)


def words_of(rng, n):
    return [f"w{rng.integers(100_000)}" for _ in range(n)]


def kept(docs, rows):
    return sorted(r.doc_id for r in simhash.keep_one(docs(rows)).collect())


def test_pairs_below_the_similarity_stay(docs):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = words_of(rng, 9)
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base + words_of(rng, 2)))]  # 5 of 7 shingles
        base = words_of(rng, 104)
        rows += [(10 * i + 2, " ".join(base)), (10 * i + 3, " ".join(base + words_of(rng, 30)))]  # 100 of 130, 0.77
    assert kept(docs, rows) == plain(rows) == sorted(k for k, _ in rows)


def test_pairs_at_the_similarity_go(docs):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        for at, (short, long) in enumerate(((8, 9), (16, 19), (24, 29), (84, 104), (404, 504))):  # 4 of 5, 12 of 15, 20 of 25, 80 of 100, 400 of 500 shingles
            text = words_of(rng, long)
            rows += [(100 * i + 2 * at, " ".join(text)), (100 * i + 2 * at + 1, " ".join(text[:short]))]
    assert kept(docs, rows) == plain(rows) == sorted(k for k, _ in rows if k % 2 == 0)


def test_groups_and_common_passages_equal_all_pairs(docs, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 16)
    monkeypatch.setattr(near_copies, "SAMPLE", 50)
    rng = np.random.default_rng(3)
    passage, rows = words_of(rng, 40), [(9000, None), (9001, " "), (9002, "one two"), (9003, "One  TWO"), (9004, "three")]
    for i in range(40):
        rows.append((i, " ".join(words_of(rng, rng.integers(1, 60)) + passage)))
    for group in range(3):
        base = words_of(rng, 120)
        for i in range(40):
            edited = base[: len(base) - int(rng.integers(0, 25))]
            for _ in range(rng.integers(0, 5)):
                edited[rng.integers(len(edited))] = f"x{rng.integers(10_000)}"
            rows.append((1000 * (group + 1) + i, " ".join(edited)))
    want = plain(rows)
    assert kept(docs, rows) == want and len(want) < len(rows) - 60
    monkeypatch.setattr(near_copies, "PAIRS", 0)  # leaders in all rounds
    assert kept(docs, rows) == want


def test_prefix_size():
    for n in range(1, 400):
        assert near_copies.prefix_size(n, 0.8) == n - -(-4 * n // 5) + 1


def test_profiles_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n in (1, 30, 700, 90_000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        for part in (1.0, 0.8, 0.4, 0.0):
            a = np.sort(pool[:n])
            b = np.sort(pool[n - int(part * n) :][:n])
            counts = [np.frombuffer(near_copies.profile(s), np.uint8)[None] for s in (a, b)]
            bound = near_copies.most_shared(*counts, np.array([len(a)]), np.array([len(b)]))[0]
            assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
    assert bound < 90_000 or counts[0].max() == 255


def test_repeated_rows_stay_or_go_together(docs):
    rng = np.random.default_rng(6)
    base = words_of(rng, 60)
    rows = [(1, " ".join(base))] * 3 + [(2, " ".join(base[:58]))] * 4 + [(3, " ".join(words_of(rng, 50)))] * 2
    assert kept(docs, rows) == [1, 1, 1, 3, 3]


def test_sets_do_not_meet_at_a_shingle_that_comes_too_late_in_both(spark):
    rows = [(1, a, 100, a, pos) for a, pos in ((1, 0), (2, 11), (3, 12), (4, 19))]  # 89 of 100 must be shared
    members = spark.createDataFrame(rows, "token long, id long, n int, root long, pos int")
    tokens = spark.createDataFrame([(1, 4)], "token long, many long")
    assert sorted(map(tuple, near_copies._all_pairs(members, tokens, 0.8).collect())) == [(1, 2)]
