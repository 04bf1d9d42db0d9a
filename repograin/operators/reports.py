"""Reports as ordered rows: written in ranges with a manifest, read in order without gathering a repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.registry import operator

SECTIONS = ["facts", "components", "endpoints", "stories", "tasks"]
_ROWS = "repo string, section int, line string, row bigint, part int"
_MANIFEST = "repo string, section int, part int, first_row bigint, last_row bigint, lines bigint"
_ROW = (1 << 33) - 1  # the part of monotonically_increasing_id that counts inside a partition


@operator("reports.rows")
def rows(facts: DataFrame, components: DataFrame, endpoints: DataFrame, stories: DataFrame, tasks: DataFrame) -> DataFrame:
    """``repo, section, line``: counts and whole lists of a repository's report, one row per line."""
    lines = {
        "facts": (facts, F.concat_ws(": ", "fact", F.col("value").cast("string"))),
        "components": (components, F.format_string("%s (%s, %s)", "name", "component_type", "status")),
        "endpoints": (endpoints, F.concat_ws(" ", "method", "endpoint")),
        "stories": (stories, F.format_string("%s [%s] %s", "title", "priority", "status")),
        "tasks": (tasks, F.format_string("%s [%s]", "name", "effort")),
    }
    out = None
    for i, name in enumerate(SECTIONS):
        df, line = lines[name]
        part = df.select("repo", F.lit(i).alias("section"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Report:
    """A written report: ``path/rows/part=N`` holds ranges in order, ``path/manifest`` says where each repository's sections lie."""

    path: str

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    def numbered(self, spark: SparkSession) -> DataFrame:
        """``repo, line_no, section, line``: every line with its place in its report, from the manifest's counts alone."""
        parts = self.manifest(spark).groupBy("repo", "part").agg(F.min("first_row").alias("first"), F.sum("lines").alias("n"))
        before = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("repo", "part", "first", "ahead")
        return spark.read.schema(_ROWS).parquet(f"{self.path}/rows").join(starts, ["repo", "part"]).select("repo", (F.col("ahead") + F.col("row") - F.col("first") + 1).alias("line_no"), "section", "line")

    def lines(self, spark: SparkSession, repo: str):
        """One repository's lines in order, a part at a time; only parts that hold the repository are opened."""
        for r in self.manifest(spark).where(F.col("repo") == repo).groupBy("part").agg(F.min("first_row").alias("low"), F.max("last_row").alias("high")).sort("part").collect():
            part = spark.read.schema(_ROWS).parquet(f"{self.path}/rows").where((F.col("part") == r["part"]) & F.col("row").between(r["low"], r["high"]))
            for line in part.sort("row").select("line").toLocalIterator():
                yield line["line"]


@operator("reports.write")
def write(report: DataFrame, path: str, parts: int | None = None) -> Report:
    """Write ``repo, section, line`` rows in that order.

    Rows are range-partitioned, so a repository of any size takes as many parts
    as it needs and small ones share a part. Each row has its place in its part,
    given in the same stage that writes it; the manifest is counted from the
    written rows.
    """
    keys = ["repo", "section", "line"]
    by = [F.col(k) for k in keys]
    ranged = report.select(*keys).repartitionByRange(parts, *by) if parts else report.select(*keys).repartitionByRange(*by)
    placed = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *keys).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))
    placed.write.partitionBy("part").parquet(f"{path}/rows")
    spark = report.sparkSession
    held = spark.read.schema(_ROWS).parquet(f"{path}/rows").groupBy("repo", "section", "part").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("lines"))
    held.write.parquet(f"{path}/manifest")
    return Report(path)
