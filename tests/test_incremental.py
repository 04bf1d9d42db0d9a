"""Maintained results against full runs, and next values of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from repograin.functions import ranking
from repograin.operators import markers, run_metrics
from repograin.streaming import incremental


@pytest.fixture
def deliver(spark, tmp_path, make_files):
    inbox, target, offsets = (str(tmp_path / n) for n in ("inbox", "kept", "offsets"))

    def run(rows):
        """Rows of (path, content or None to delete, modified), as one batch."""
        files = make_files([("r", p, c) for p, c, _ in rows]).drop("modified")
        times = spark.createDataFrame([(p, c, m) for p, c, m in rows], "path string, content string, modified bigint").distinct()
        joined = files.join(times, (files["path"] == times["path"]) & files["content"].eqNullSafe(times["content"])).select(files["*"], times["modified"]).distinct()
        out = joined.withColumn("deleted", F.col("content").isNull()).select("repo", "path", "ext", "lang", F.col("length").cast("bigint"), "modified", "content", "deleted")
        out.coalesce(1).write.mode("append").parquet(inbox)
        incremental.maintain(incremental.stream_files(spark, inbox, schema=incremental.CHANGES_SCHEMA), markers.scan, target, offsets).awaitTermination(120)
        return {(r["path"], r["line_no"], r["marker"]) for r in incremental.current(spark, target).collect()}

    run.target = target
    return run


def test_edits_deletions_and_replays_leave_what_a_full_run_gives(spark, deliver, tmp_path):
    assert deliver([("a.py", "# TODO one\n# FIXME two\n", 1), ("b.py", "# TODO b\n", 1), ("c.py", "x\n", 1)]) == {("a.py", 1, "TODO"), ("a.py", 2, "FIXME"), ("b.py", 1, "TODO")}
    assert deliver([("a.py", "x\n# TODO one\n", 2), ("c.py", "# HACK c\n", 2)]) == {("a.py", 2, "TODO"), ("b.py", 1, "TODO"), ("c.py", 1, "HACK")}
    assert deliver([("b.py", None, 3), ("c.py", "old\n", 1)]) == {("a.py", 2, "TODO"), ("c.py", 1, "HACK")}  # an older state changes nothing
    assert deliver([("a.py", "# TODO one\n# FIXME two\n", 1), ("b.py", "# TODO b\n", 1), ("c.py", "# HACK c\n", 2)]) == {("a.py", 2, "TODO"), ("c.py", 1, "HACK")}  # delivered again
    held = deliver([("b.py", "# NOTE back\n# BUG b\n", 4), ("a.py", "# TODO x\n", 4), ("a.py", None, 5)])
    assert {p for p, _, _ in held} == {"b.py", "c.py"}
    incremental.compact(spark, deliver.target, str(tmp_path / "compacted"))
    assert {(r["path"], r["line_no"], r["marker"]) for r in incremental.current(spark, str(tmp_path / "compacted")).collect()} == held


def test_next_values_equal_plain_version(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t int, seq int").withColumn("_x", F.lit(1))
    got = {r["seq"]: r["after"] for r in ranking.next_value(df, ["k"], ["t", "seq"], "t", "after").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, s) for key, t, s in rows if key == k)
        want |= {s: own[i + 1][0] if i + 1 < len(own) else None for i, (_, s) in enumerate(own)}
    assert got == want


def test_null_values_follow_as_nulls(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 3, 30)], "k string, t int, v int")
    assert {r["t"]: r["n"] for r in ranking.next_value(df, ["k"], ["t"], "v", "n").collect()} == {1: None, 2: 30, 3: None}


def test_a_day_of_one_phase_spreads_over_tasks(spark):
    n = 200_000
    events = spark.range(n).select(F.lit(1).alias("run"), F.lit("p").alias("phase"), (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("id") % 50_000).cast("timestamp").alias("ts"), F.col("id").alias("seq"))
    ranged, _ = ranking._ranged(events, ["run", "phase"], ["ts", "seq"])
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * n
    gaps = run_metrics.phase_gaps(events)
    assert gaps.count() == n - 1 and gaps.agg(F.sum("seconds")).first()[0] == 49_999.0


def test_the_least_of_several_defaults_counts(spark):
    table = spark.createDataFrame([("default", "z"), ("default", "b"), ("x", "2"), ("x", "1")], "key string, value string")
    rows = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {tuple(r) for r in run_metrics.lookup_default(rows, table, "name").collect()} == {("x", "1"), ("y", "b")}
