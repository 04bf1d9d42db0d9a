"""Batches by a token budget, and reports in order."""

import random

from pyspark.sql import functions as F

from repograin.operators import scoring


def test_no_batch_is_over_its_budget_and_no_text_is_shortened(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.8 else "cold", i, "x" * rnd.choice([0, 3, 40, 400, 2600, 9000, 60_000]) + str(i)) for i in range(400)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, n int, text string").repartition(7)
    for budget in (400, scoring.BUDGET):
        got = scoring.batches(df, "k", ["n"], budget).collect()
        texts, sums, slots = {}, {}, {}
        for r in sorted(got, key=lambda r: (r["k"], r["n"], r["part"])):
            texts[r["k"], r["n"]] = texts.get((r["k"], r["n"]), "") + r["text"]
            sums[r["k"], r["batch"]] = sums.get((r["k"], r["batch"]), 0) + r["tokens"]
            slots.setdefault((r["k"], r["batch"]), []).append(r["slot"])
            assert r["tokens"] >= len(r["text"]) / scoring.TOKEN_CHARS
        assert texts == {(k, n): t or "" for k, n, t in rows}
        assert max(sums.values()) <= budget and all(s == list(range(len(s))) for s in slots.values())
        full = sorted(sums.values())
        assert full[len(full) // 2] > budget / 2  # most batches are well filled


def test_a_batch_of_many_small_items_has_no_limit_of_items(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.lit("ab").alias("text"))
    sizes = [r["count"] for r in scoring.batches(df, "k", ["n"]).groupBy("batch").count().collect()]
    assert max(sizes) == -(-(scoring.BUDGET - scoring.BUDGET // 4) // 9) and sum(sizes) == 5000


def test_project_prompts_name_their_kinds(spark):
    items = spark.createDataFrame([("r", "endpoint", "/a"), ("r", "endpoint", "/a"), ("r", "file", "b.py"), ("r", "dependency", "flask"), ("r", "dependency", None)], "repo string, kind string, item string")
    segments = spark.createDataFrame([("r", "Class", "Cart")], "repo string, segment_type string, name string")
    batched = scoring.batches(scoring.project_items(items, segments), "repo", ["place", "name"])
    (row,) = scoring.project_prompts(batched, "{segments}").collect()
    assert row["prompt"] == "API endpoints:\n- /a\nDependencies:\n- flask\nFiles:\n- b.py\nSegments:\n- Class Cart" and row["items"] == 4
