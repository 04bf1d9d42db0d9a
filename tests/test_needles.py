"""One search for all plain words finds every pattern that could match."""

from pyspark.sql import functions as F

from repograin.functions.needles import folded, may_match, needles
from repograin.operators.reality import RULES

TEXTS = ["oauth", "AUTHORIZATION of a token", "nothing here", "", "un ſeſſion", "LOGİN", "create tableau", "x.deleteOne(y)", "reauthenticated", "github actions ci"]


def test_words_inside_longer_words_count(spark):
    patterns = [p for _, _, p in RULES]
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", folded(F.col("text")).alias("low"))
    for r in df.select("low", may_match(F.col("low"), patterns).alias("rules")).collect():
        assert sorted(r.rules) == [n for n, p in enumerate(patterns) if not needles(p) or any(w in r.low for w in needles(p))]


def test_the_text_meets_words_once(spark):
    df = spark.createDataFrame([("x",)], "low string").select(may_match(F.col("low"), [p for _, _, p in RULES]).alias("rules"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1 and "Contains(" not in plan
