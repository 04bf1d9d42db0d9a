"""Commit history and incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.registry import operator

# Files that make up a project's fingerprint.
KEY_FILES = ["Cargo.toml", "package.json", "pom.xml", "requirements.txt", "README.md", ".gitignore", "tsconfig.json", "setup.py"]
SKIPPED = ["target", "node_modules"]
MAX_AGE_HOURS = 24


@operator("history.contributors")
def contributors(commits: DataFrame) -> DataFrame:
    """Commits by author of each repository, with the author's name in the earliest one."""
    return commits.groupBy("repo", "author_email").agg(F.count("*").alias("commits"), F.min_by("author_name", "seq").alias("author_name"))


@operator("history.recent")
def recent(commits: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest commits of each repository; Spark applies the rank limit before its shuffle."""
    newest = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("seq"))
    return commits.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).drop("place")


@operator("history.recent_commits")
def recent_commits(commits: DataFrame, commit_files: DataFrame, limit: int) -> DataFrame:
    top = recent(commits, limit)
    n = commit_files.join(top.select("repo", "hash"), ["repo", "hash"], "left_semi").groupBy("repo", "hash").agg(F.count("*").alias("files_changed"))
    return top.join(n, ["repo", "hash"], "left").select(
        "repo", F.left("hash", F.lit(8)).alias("short_hash"), "seq", "ts", "author_name", F.substring_index("message", "\n", 1).alias("title"),
        F.coalesce("files_changed", F.lit(0)).alias("files_changed"),
    )


@operator("history.churn")
def churn(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits touching each file of each repository, among all commits that have a parent."""
    parented = commits.where("seq > 0").select("repo", "hash")
    touched = commit_files.select("repo", "hash", "path").distinct().join(parented, ["repo", "hash"], "left_semi")
    return touched.groupBy("repo", "path").agg(F.count("*").alias("commits"))


@operator("history.fingerprint")
def fingerprint(repos: DataFrame, files: DataFrame) -> DataFrame:
    """SHA-256 over name, size and time of the key files and the sorted top directories."""
    rank = F.array_position(F.array(*[F.lit(f) for f in KEY_FILES]), F.col("path"))
    keys = files.where(F.col("path").isin(KEY_FILES)).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat_ws("|", "path", "length", "modified").alias("t")))).alias("ks"))
    first = F.substring_index("path", "/", 1)
    dirs = files.where(F.col("path").contains("/")).select("repo", first.alias("d")).where(~F.col("d").startswith(".") & ~F.col("d").isin(SKIPPED)).distinct()
    listed = dirs.groupBy("repo").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    text = F.concat_ws("|", F.array_join(F.transform("ks", lambda k: k["t"]), "|"), F.array_join("ds", "|"))
    return repos.join(keys, "repo", "left").join(listed, "repo", "left").select("repo", F.sha2(text, 256).alias("fingerprint"))


def state_key(repo: Column, analysis: Column, version: Column) -> Column:
    return F.sha2(F.concat(repo, analysis, version), 256)


@operator("history.fresh")
def fresh(state: DataFrame, current: DataFrame, now: Column, version: str, hours: int = MAX_AGE_HOURS) -> DataFrame:
    """Saved results that are young, of this version, and of the same fingerprint."""
    return state.where((F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("version") == version)).join(current, ["repo", "fingerprint"], "left_semi")


@operator("history.stale")
def stale(current: DataFrame, kept: DataFrame) -> DataFrame:
    """Repositories to analyse again."""
    return current.join(kept.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")
