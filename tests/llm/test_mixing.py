"""Targets and thresholds against plain Python."""

import re

import numpy as np
import pytest
from tests_llm_helpers import mixed, targets

from repograin.llm import mixing


def result(docs, rows):
    mix, sized = mixing.plan(docs(rows))
    return mix.apply(sized, "key").collect()


def test_equals_plain_version(docs):
    rng = np.random.default_rng(1)
    names = ["b", "a", "ä", "Z", None, "hot", "\U0001f600", "￿"]
    rows = [(i, "w " * int(rng.integers(0, 300)), None, names[i % 8] if i % 3 else "hot") for i in range(400)] + [(1000, None, None, "none"), (1001, "", None, "none"), (1002, "x " * 50_000, None, "big")]
    got = result(docs, rows)
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    copies = mixed([(r[0], r[3], size[r[0]]) for r in rows])
    assert {r.key: r.copies for r in got} == copies and {r.key: r.size for r in got} == size
    total = {}
    for i, _, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    goal = targets(total)
    for s in total:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == total[s] and own[0].target == pytest.approx(goal[s])
        assert abs(sum(r.size * r.copies for r in own) - goal[s]) <= max([r.size for r in own])
    assert max(r.copies for r in got) <= 3
    assert sum(goal.values()) == pytest.approx(sum(total.values()))


def test_repeated_rows_null_keys_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b", None, "x"), (1, "a b", None, "x"), (None, "c", None, "x"), (2, "d e f g", None, "y")]
    df = docs(rows).withColumn("size", F.lit("clash")).withColumn("u", F.lit(1)).withColumn("prefix", F.lit(1))
    mix, sized = mixing.plan(df)
    got = mix.apply(sized, "key").collect()
    assert len(got) == 4 and len({r.copies for r in got if r.key == 1}) == 1


def test_nothing_to_take(docs):
    assert result(docs, []) == []
    assert [(r.target, r.copies) for r in result(docs, [(1, None, None, "a"), (2, " ", None, None)])] == [(0.0, 0)] * 2
