"""Flagship query: files with the most urgent work markers, by topic."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograin.operators import markers


def urgent_files_by_topic(c) -> DataFrame:
    per_file = (
        markers.by_topic(c.todos)
        .groupBy("repo", "category", "path")
        .agg(F.count("*").alias("markers"), F.max("priority_score").alias("max_urgency"), F.sum("priority_score").alias("urgency"))
    )
    w = Window.partitionBy("category").orderBy(F.desc("urgency"), "repo", "path")
    return per_file.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)
