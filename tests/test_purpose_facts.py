"""Purpose facts come with all the items that speak for them."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_facts_hold_every_item_of_a_repository(spark):
    queries, folder = entry.queries(), "/root/testdata/sf0.001"
    facts = queries["b14_purpose_facts"](spark, folder).cache()
    items = {tuple(r) for r in facts.where("item IS NOT NULL").select("repo", "kind", "item").collect()}
    assert items == {tuple(r) for r in queries["b14_purpose_evidence"](spark, folder).select("repo", "kind", "item").collect()}
    assert facts.groupBy("repo").agg((F.max("endpoints") + F.max("dependencies") - F.count("item")).alias("d")).where("d <> 0").count() == 0
