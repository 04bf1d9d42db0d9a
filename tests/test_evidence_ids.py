"""Evidence is merged by ids: its texts are fetched for the groups' first rows only."""

from repograin.operators import reality


def test_texts_are_not_shuffled_to_find_their_leaders(spark):
    rows = spark.createDataFrame(
        [("r", "TestingImplemented", f"0:{p}:1", "Partial", 50, d, [1, 2], [s]) for p, d, s in (
            ("a", "one two three four", "unit test"), ("b", "four three two one", "api call"), ("c", "unlike all others", "x"),
            ("d", "same place again", "x"), ("d", "another text here", "x"))],
        "repo string, reality_type string, impl_id string, level string, points int, description string, line_numbers array<int>, snippets array<string>",
    )
    merged = reality.merge(rows)
    got = {(r["impl_id"], r["description"], r["members"], r["hits"]) for r in merged.collect()}
    assert ("0:a:1", "one two three four", 2, 4) in got and ("0:c:1", "unlike all others", 1, 2) in got
    assert ("0:d:1", "another text here", 2, 4) in got  # one identity is one group
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 0  # ids are made before the groups are read, once


def test_tables_of_the_merge_go_when_it_is_done(spark):
    from pathlib import Path

    from repograin.session import shared_dir

    home = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / spark.sparkContext.applicationId
    before = set(home.iterdir()) if home.exists() else set()
    rows = spark.createDataFrame(
        [("r", "TestingImplemented", f"0:{p}:1", "Partial", 50, d, [1], [d]) for p, d in (("a", "one two three four"), ("b", "one two three four five"), ("c", "unlike all others"))],
        "repo string, reality_type string, impl_id string, level string, points int, description string, line_numbers array<int>, snippets array<string>",
    )
    assert {(r.impl_id, r.members) for r in reality.merge(rows).collect()} in ({("0:a:1", 2), ("0:c:1", 1)}, {("0:b:1", 2), ("0:c:1", 1)})
    assert {p.name.split("-")[0] for p in set(home.iterdir()) - before} == {"led"}
