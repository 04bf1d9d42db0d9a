"""Token sets travel by ids: made once per set, and each pair found once."""

from repograin.functions.similarity import set_id, similar_ids, similar_sets

from pyspark.sql import functions as F


def test_ids_are_made_below_the_explode(spark):
    df = spark.createDataFrame([("r", ["a", "b", "c"]), ("r", ["a", "b", "d"])], "repo string, tokens array<string>")
    plan = similar_sets(df, df, ["repo"], 0.3)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [plan[i - 1] for i, line in enumerate(plan) if "Generate explode(tokens" in line]
    assert above and not [line for line in above if "md5(" in line]  # above it, the whole set is hashed again for each of its tokens


def test_sets_that_meet_each_other_give_each_pair_once(spark):
    sets = [["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "x", "y"], ["p", "q"], []]
    df = spark.createDataFrame([("r", s) for s in sets], "repo string, tokens array<string>").withColumn("sid", set_id(F.col("tokens")))
    name = {r.sid: "".join(r.tokens) for r in df.collect()}
    got = [sorted((name[r.l_sid], name[r.r_sid])) for r in similar_ids(df, None, ["repo"], 0.3).collect()]
    assert sorted(got) == [["abc", "abcd"], ["abc", "abxy"], ["abcd", "abxy"]]


def test_only_prefixes_leave_the_row(spark):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([("r", words), ("r", words[1:])], "repo string, tokens array<string>").withColumn("sid", set_id(F.col("tokens")))
    plan = similar_ids(df, None, ["repo"], 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate explode") == 2  # no token is ranked by a shuffle of all tokens
    assert similar_ids(df, None, ["repo"], 0.7).count() == 1
