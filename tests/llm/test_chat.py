"""Role repair against all repairs of short conversations; stretches of long ones against one pass."""

import random

import numpy as np
import pytest

from repograin.llm import chat

LEGAL = {"system": {"start"}, "user": {"start", "system", "assistant"}, "assistant": {"user"}}


def legal(roles):
    before = "start"
    for r in roles:
        if before not in LEGAL[r]:
            return False
        before = r
    return True


def brute(roles):
    """Least cost over every choice of label, merge and empty turn."""
    best = [10**9]

    def go(i, out, cost):
        if cost >= best[0] or not legal(out):
            return
        if i == len(roles):
            best[0] = cost
            return
        role = roles[i]
        for then in chat.ROLES if role == "system" else ("user", "assistant"):
            label = 0 if then == role else 1 if role not in chat.ROLES else 2
            go(i + 1, [*out, then], cost + label)
            if out and out[-1] == then:
                go(i + 1, out, cost + label + 1)
            for empty in ("user", "assistant"):
                go(i + 1, [*out, empty, then], cost + label + 3)

    go(0, [], 0)
    return best[0]


def spent(roles, plan, first=chat.START):
    before, cost = first, 0
    for role, (action, state, empty) in zip(roles, plan, strict=True):
        if empty is not None:
            assert empty in chat._NEXT[before]
            before, cost = empty, cost + chat.INSERT
        if action.endswith("merge"):
            assert state == before
            cost += chat.MERGE
        else:
            assert state in chat._NEXT[before]
        if action.startswith("relabel"):
            cost += chat.RELABEL if role in chat.ROLES else chat.UNKNOWN
        else:
            assert chat.ROLES[state - 1] == role
        before = state
    return cost


def test_repair_is_cheapest():
    rng = random.Random(4)
    for _ in range(150):
        roles = [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 5))]
        plan = chat.repair(roles)
        assert spent(roles, plan) == brute(roles) == chat.costs(roles)[chat.START].min(), roles


def test_legal_conversations_are_kept():
    assert {a for a, _, _ in chat.repair(["system", "user", "assistant", "user"])} == {"keep"}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "hello <|end|>"), (2, 0, "assistant", "first"), (3, 5, "tool", None), (3, 1, "system", "be kind"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "lost"), (None, None, None, "no turn"), (5, 0, "user", "x" * 500_000), (5, 1, "assistant", ""),
]


@pytest.mark.parametrize("long", [False, True])
def test_spark_equals_one_pass(spark, long):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = ROWS + ([(77, i, rng.choice(["user", "assistant", "system", None]), f"t{i}") for i in range(3_000)] if long else [])
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("clash")).withColumn("mark", F.lit(1))
    turns = chat.repaired_turns(df)
    got = turns.collect()
    assert sum(r.step for r in got) == len(rows)
    texts = {r.conv_id: r.text for r in chat.as_texts(turns).collect()}
    assert texts[1] == "<|user|>\nhi\nthere<|end|>\n<|assistant|>\nhello < |end|><|end|>\n"
    assert texts[2] in ("<|user|>\n<|end|>\n<|assistant|>\nfirst<|end|>\n", "<|user|>\nfirst<|end|>\n")
    assert texts[3] == "<|system|>\nbe kind<|end|>\n<|user|>\n<|end|>\n" and texts[4] == "<|user|>\nsame\nsame<|end|>\n"
    by_conv = {}
    for c, t, role, _ in rows:
        by_conv.setdefault(c, []).append(((t is not None, t or 0, role or ""), role))
    cost = {"keep": 0, "merge": 1, "insert": 3}
    for c, own in by_conv.items():
        if c == 77:
            want = chat.costs([r for _, r in sorted(own, key=lambda x: x[0])])[chat.START].min()
            role_of = {t: role for x, t, role, _ in rows if x == 77}
            paid = sum(cost.get(r.action, 0) + (("merge" in r.action and r.action != "merge") + (2 if role_of[r.turn] in chat.ROLES else 1) if "relabel" in r.action else 0) for r in got if r.conv_id == 77)
            assert paid == want and texts[77].count("<|end|>") == sum("merge" not in r.action for r in got if r.conv_id == 77)
            assert legal([r.role for r in sorted((r for r in got if r.conv_id == 77), key=lambda r: (r.turn, r.tie, r.step)) if "merge" not in r.action])


def test_stretches_multiply():
    roles = ["user", None, "assistant", "assistant", "system", "user"] * 3
    a, b = chat.costs(roles[:7]), chat.costs(roles[7:])
    assert (np.minimum((a[:, :, None] + b[None]).min(axis=1), chat._FAR) == chat.costs(roles)).all()


def test_partitions_do_not_matter(spark):
    rng = random.Random(5)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool", None]), f"t{i}") for c in ("long", "other", None) for i in range(2_000 if c == "long" else 40)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "8", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted((tuple(r) for r in chat.repaired_turns(df).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got[0] == got[1] == got[2]
    plan = chat.repair([r[2] for r in rows if r[0] == "long"])
    assert [(a, s) for a, s, _ in plan] == [(r[5], chat._STATE[r[4]]) for r in sorted((r for r in got[0] if r[0] == "long" and r[3] == 1), key=lambda r: r[1])]


def test_cuts_do_not_matter():
    rng = random.Random(6)
    for _ in range(500):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randint(2, 12))]
        cut = rng.randrange(1, len(roles))
        after = chat.to_go(roles[cut:])[0]
        left = chat.repair(roles[:cut], chat.START, after)
        assert left + chat.repair(roles[cut:], left[-1][1]) == chat.repair(roles)


def test_empty_table(spark):
    assert chat.repaired_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
