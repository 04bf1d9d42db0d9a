"""Bit-plane arithmetic and clustering against whole numbers of Python."""

import hashlib
import math

import numpy as np
import pytest

from repograin.llm import bit_planes as bp


@pytest.mark.parametrize("big", [3, 100, 1 << 20, 1 << 40, 1 << 200])
def test_dot_products_and_distances_are_exact(big):
    rng = np.random.default_rng(big % 97)
    draw = lambda n: [[int(rng.integers(-1000, 1001)) * big // 1000 for _ in range(64)] for _ in range(n)]
    a, b = draw(9), draw(4)
    pa, pb = (bp.to_planes(np.array(v, np.int64 if big < 1 << 50 else object)) for v in (a, b))
    assert bp.numbers_of(pa) == a
    assert bp.dots(pa, pb).tolist() == [[sum(x * y for x, y in zip(v, w)) for w in b] for v in a]
    assert bp.distances(pa, pb).tolist() == [[sum((x - y) ** 2 for x, y in zip(v, w)) for w in b] for v in a]


def test_extreme_numbers_fill_their_planes():
    v = np.array([[-128] + [127] * 63, [0] * 64, [-1] * 64])
    assert bp.to_planes(v).shape == (3, 8) and bp.numbers_of(bp.to_planes(v)) == v.tolist()
    assert bp.whole_numbers(np.array([[-0.001] * 64]))[0, 0] == -1
    assert bp.whole_numbers(np.array([[1e308, -1e308] * 32]))[0].tolist()[:2] == [int(1e308) * 64, -int(1e308) * 64]


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda p: hashlib.sha256(f"1:{'' if kept[p][0] is None else kept[p][0]}".encode()).hexdigest())
    centers = [kept[p][1] for p in order[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in range(len(centers)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            if own:
                centers[c] = [sum(col) // len(own) for col in zip(*own)]
    of = [nearest(v) for _, v in kept]
    away = [far(v, centers[c]) for (_, v), c in zip(kept, of)]
    fits = lambda n: n if n < 1 << 63 else None
    by = {c: sum(d for d, o in zip(away, of) if o == c) for c in set(of)}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, fits(d), fits(by[c]) if all(fits(x) is not None for x, o in zip(away, of) if o == c) else None,
                    fits(sum(away)), shas[c]) for (i, _), c, d in zip(kept, of, away)), key=str)


def result(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "'x' AS planes", "2 AS vector", "3 AS cluster").repartition(parts)
    return sorted(map(tuple, bp.cluster(df).collect()), key=str)


def test_equals_plain_version(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(20, 64))
    rows = [(i, (middles[i % 20] + rng.normal(size=64) * 0.3).tolist()) for i in range(600)]
    rows += [(1000, None), (1001, [0.5] * 63), (1002, [0.5] * 63 + [None]), (1003, [float("nan")] + [0.0] * 63), (1004, [float("-inf")] + [0.0] * 63), (1005, [])]
    assert result(spark, rows) == plain(rows) == result(spark, rows, 1)


def test_ties_repeats_null_keys_and_few_vectors(spark):
    rows = [(1, [0.0] * 64), (1, [0.0] * 64), (None, [1.0] * 64), (2, [-1.0] * 64), (3, [0.0] * 64), (2, [-1.0] * 64)]
    got = result(spark, rows)
    assert got == plain(rows) and len(got) == 6
    many = [(i % 3, [float(i % 3)] * 64) for i in range(90)]  # copies make equal centroids
    assert result(spark, many) == plain(many)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(i * 10**9)] + [float((i * 7) % 5) * 1e300] * 2 + [0.25] * 61) for i in range(40)]
    got = result(spark, rows)
    assert got == plain(rows) and any(r[2] is None for r in got)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, [1.0])]) == []
