"""Result tables for files, trackers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.registry import operator


@operator("exports.write")
def write(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "repo", mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Write a result table; with ``by`` one folder per key.

    Rows are clustered by key before the write, so a key's folder has one file,
    or one for each ``rows_per_file`` of its rows: a hot key fills several.
    """
    if not by or by not in df.columns:
        getattr(df.write.mode(mode), fmt)(path)
        return
    files = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = df.join(files, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_file", F.pmod(F.xxhash64(*hashed), F.col("_files")))
    getattr(dealt.repartition(by, "_file").drop("_by", "_files", "_file").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(by), fmt)(path)


@operator("exports.feature_status")
def feature_status(components: DataFrame) -> DataFrame:
    """JSON rows per repository: one header with counts, then one row per feature.

    Features stay rows of their own, so no repository is gathered in one value.
    """
    state = F.when(F.col("status") == "Complete", "completed").when(F.col("status") == "InProgress", "in_progress").otherwise("todo")
    n = lambda s: F.count_if(state == s)
    head = components.groupBy("repo").agg(F.to_json(F.struct(n("completed").alias("completed"), n("in_progress").alias("in_progress"), n("todo").alias("todo"))).alias("json"))
    rows = components.select("repo", state.alias("kind"), F.to_json(F.struct("name", "component_type", "complexity")).alias("json"), "path")
    return head.select("repo", F.lit("header").alias("kind"), "json", F.lit("").alias("path")).unionByName(rows)


@operator("exports.tracker")
def tracker(stories: DataFrame, tasks: DataFrame) -> DataFrame:
    """Issues for High and Critical stories, tickets for Critical tasks, each with its body.

    A story's components are rows of their own (``issue_components``), as one story may have any number of them.
    """
    numbered = F.array_join(F.transform("criteria", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    body = F.concat(
        F.lit("**User Story**: "), "description", F.lit("\n\n## Acceptance Criteria\n\n"), numbered,
        F.lit("\n\n**Priority**: "), "priority", F.lit("\n**Complexity**: "), "complexity", F.lit("\n**Status**: "), "status")
    s = stories.where(F.col("priority").isin("High", "Critical")).select(
        "repo", F.lit("issue").alias("kind"), "id", "title",
        F.to_json(F.struct(F.col("title").alias("title"), body.alias("body"), F.array(F.lit("user-story"), F.concat(F.lit("priority:"), F.lower("priority"))).alias("labels"))).alias("payload")
    )
    return s.unionByName(tickets(tasks))


@operator("exports.tickets")
def tickets(tasks: DataFrame) -> DataFrame:
    """``repo, kind, id, title, payload`` of the Critical ones of ``repo, id, name, description, status, effort, priority``."""
    body = F.concat(
        F.lit("*Task Description*: "), "description", F.lit("\n\n*Priority*: "), "priority", F.lit("\n*Status*: "), "status", F.lit("\n*Effort Estimate*: "), "effort")
    return tasks.where(F.col("priority") == "Critical").select(
        "repo", F.lit("ticket").alias("kind"), "id", F.col("name").alias("title"), F.to_json(F.struct(F.col("name").alias("title"), body.alias("body"), F.array(F.lit("task")).alias("labels"))).alias("payload")
    )


@operator("exports.issue_components")
def issue_components(stories: DataFrame, related: DataFrame) -> DataFrame:
    """``repo, id, component, component_path`` of the stories that become issues."""
    issues = stories.where(F.col("priority").isin("High", "Critical")).select("repo", "id")
    return related.join(issues, ["repo", "id"], "left_semi").select("repo", "id", "component", "component_path")


@operator("exports.report_facts")
def report_facts(components: DataFrame, stories: DataFrame, tasks: DataFrame) -> DataFrame:
    """Numbered facts a report is filled from: (repo, section, fact, value)."""
    c = components.groupBy("repo").agg(F.count("*").alias("components"), F.sum("line_count").alias("lines"), F.count_if(F.col("status") == "Complete").alias("complete"))
    s = stories.groupBy("repo").agg(F.count("*").alias("stories"))
    t = tasks.groupBy("repo").agg(F.count("*").alias("tasks"))
    wide = c.join(s, "repo", "left").join(t, "repo", "left").fillna(0)
    return wide.unpivot("repo", ["components", "lines", "complete", "stories", "tasks"], "fact", "value")


@operator("exports.stories_by_status")
def stories_by_status(stories: DataFrame) -> DataFrame:
    group = F.when(F.col("status") == "Complete", "Complete").when(F.col("status") == "InProgress", "InProgress").when(F.col("status") == "Todo", "Todo").otherwise("New")
    return stories.groupBy("repo", group.alias("state")).agg(F.count("*").alias("stories"), F.min("title").alias("first_title"))
