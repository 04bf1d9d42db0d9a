"""Work markers in comments: extraction, ranking, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.facets import facet_counts
from repograin.functions.scores import r6
from repograin.functions.text import contains_any, first_label, hit_lines_with_context, lines, lookup, words
from repograin.registry import operator
from repograin.rules import languages as L
from repograin.rules import markers as M


def marker_pattern(marker: str) -> str:
    return "(?i)(?:" + "|".join(style % marker for style in M.COMMENT_STYLES) + ")"


ANY_MARKER = "(?i)(?:" + "|".join(style % ("(?:" + "|".join(M.MARKERS) + ")") for style in M.COMMENT_STYLES) + ")"


def priority(marker: Column, text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, M.CRITICAL_WORDS), "Critical")
        .when(contains_any(low, M.HIGH_WORDS), "High")
        .otherwise(lookup(marker, M.PRIORITY_BY_MARKER, "Medium"))
    )


def topic(text: Column) -> Column:
    return first_label(F.lower(text), M.TOPICS, M.DEFAULT_TOPIC)


def effort(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, M.BIG_WORK), F.when(F.size(words(text)) > 10, "Large").otherwise("Medium"))
        .when(contains_any(low, M.SMALL_WORK), "Small")
        .otherwise("Medium")
    )


def urgency(level: Column) -> Column:
    return lookup(level, M.URGENCY) / F.lit(100.0)


def author(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "@([a-zA-Z0-9_-]+)", 1), F.lit(""))


def date_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("#([a-zA-Z0-9_-]+)"), F.lit(1))


@operator("markers.scan")
def scan(files: DataFrame) -> DataFrame:
    """One row per marked line: the first marker of the fixed order that the line holds."""
    hit = F.explode(hit_lines_with_context(F.col("content"), ANY_MARKER, 2, 1, own=False))
    found = files.select("repo", "path", "lang", hit.alias("h")).select(
        "repo", "path", F.col("lang").alias("file_type"), "h.line_no", "h.line", F.col("h.context").alias("context_lines")
    )
    parts = []
    for m in M.MARKERS:
        p = marker_pattern(m)
        text = F.concat(*[F.regexp_extract("line", p, g + 1) for g in range(len(M.COMMENT_STYLES))])
        parts.append(F.when(F.col("line").rlike(p), F.struct(F.lit(m).alias("marker"), F.trim(text).alias("description"))))
    at = F.instr("line", F.col("m.marker"))
    return (
        found.withColumn("m", F.coalesce(*parts))
        .select(
            "repo", "path", "file_type", "line_no",
            F.when(at == 0, 0).otherwise(F.octet_length(F.substring("line", F.lit(1), at - 1))).alias("column_no"),
            "m.marker", "m.description", "context_lines",
        )
        .select(
            "*",
            priority(F.col("marker"), F.col("description")).alias("priority"),
            author(F.col("description")).alias("author"),
            F.try_to_date(date_text(F.col("description")), "yyyy-MM-dd").alias("date_added"),
            tags(F.col("description")).alias("tags"),
        )
    )


@operator("markers.summary")
def summary(todos: DataFrame) -> DataFrame:
    """Totals per repository, and by marker, priority and file type, in one pass."""
    return facet_counts(todos, "repo", {"type": "marker", "priority": "priority", "file_type": "file_type"}, total=True)


@operator("markers.most_marked")
def most_marked(todos: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Files with the most markers, with the true density per 100 lines."""
    top = (
        todos.groupBy("repo", "path")
        .agg(F.count("*").alias("todo_count"), F.count_if(F.col("priority").isin("High", "Critical")).alias("high_priority_count"))
        .orderBy(F.desc("todo_count"), "repo", "path")
        .limit(limit)
    )
    # ``limit`` rows: the join side is bounded by the limit, so it may be broadcast.
    sizes = files.join(F.broadcast(top.select("repo", "path")), ["repo", "path"], "left_semi").select(
        "repo", "path", F.size(lines(F.col("content"))).alias("line_count")
    )
    return (
        top.join(sizes, ["repo", "path"])
        .withColumn("density_per_100_lines", r6(F.col("todo_count") * 100.0 / F.col("line_count")))
    )


@operator("markers.most_marked_per_repo")
def most_marked_per_repo(todos: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("todo_count"), "path")
    return (
        todos.groupBy("repo", "path")
        .agg(F.count("*").alias("todo_count"), F.count_if(F.col("priority").isin("High", "Critical")).alias("high_priority_count"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
    )


@operator("markers.by_topic")
def by_topic(todos: DataFrame) -> DataFrame:
    d = F.col("description")
    return todos.select(
        "repo", "path", "line_no", "description", topic(d).alias("category"),
        urgency(F.col("priority")).alias("priority_score"), effort(d).alias("estimated_effort"),
    )


@operator("markers.placeholders")
def placeholders(todos: DataFrame) -> DataFrame:
    """Open TODOs as placeholder features: the words of their description and an urgency."""
    name = F.array_join(words(F.col("description")), " ")
    return todos.where(F.col("marker") == "TODO").select(
        "repo", "path", "line_no", name.alias("feature_name"), F.col("marker").alias("placeholder_type"),
        "description", urgency(F.col("priority")).alias("urgency_score"),
    )


@operator("markers.placeholder_code")
def placeholder_code(files: DataFrame) -> DataFrame:
    """Lines holding one of the declared not-implemented idioms."""
    tests = lambda l: F.array_compact(F.array(*[F.when(l.contains(p), F.lit(p)) for p in M.PLACEHOLDERS]))
    found = F.filter(
        F.transform(lines(F.col("content")), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line"), tests(l).alias("hits"))),
        lambda x: F.size(x["hits"]) > 0,
    )
    return (
        files.where(contains_any(F.col("content"), M.PLACEHOLDERS))
        .select("repo", "path", F.explode(found).alias("h"))
        .select("repo", "path", "h.line_no", F.explode("h.hits").alias("indicator"), F.trim("h.line").alias("snippet"))
    )


@operator("markers.completion")
def completion(repos: DataFrame, todos: DataFrame) -> DataFrame:
    """Scores from marker counts; repositories without markers score 1."""
    n = todos.groupBy("repo").agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0))
    return repos.join(n, "repo", "left").select(
        "repo", k.alias("todo_count"),
        F.greatest(100 - k, F.lit(10)).cast("double").__truediv__(100.0).alias("completion_score"),
        F.greatest(100 - 5 * k, F.lit(30)).cast("double").__truediv__(100.0).alias("confidence"),
    )


FILE_TYPES = L.LANGUAGE_BY_EXTENSION
