"""Implementation evidence in code: extraction, scoring, merging, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograin.functions.facets import facet_counts
from repograin.functions.needles import folded, may_match
from repograin.functions.scores import r6
from repograin.functions.similarity import set_id, similar_ids
from repograin.functions.text import file_name, let, lines, lookup, rx, words
from repograin.registry import operator
from repograin.rules import reality as R
from repograin.rules.documents import KEYWORD_BONUS
from repograin.session import drop, new_folder, saved

RULES = [(t, i, p) for t, (_, ps) in enumerate(R.EVIDENCE) for i, p in enumerate(ps)]


def level(points: Column) -> Column:
    out = None
    for bound, name in R.LEVELS:
        out = F.when(points >= bound, name) if out is None else out.when(points >= bound, name)
    return out.otherwise(R.LOWEST_LEVEL)


def _hits(content: Column) -> Column:
    """``array<struct<type_no,line_no,pattern_no,snippet>>`` of one file, in line order.

    One search finds the plain words that patterns promise; a line meets only
    the patterns whose words it holds.
    """

    def of_line(x: Column) -> Column:
        snippet = F.regexp_replace(x["line"], r"^\s+|\s+\z", "")
        tests = [
            F.when(
                F.array_contains(x["rules"], F.lit(n)) & x["line"].rlike(rx(p)),
                F.struct(F.lit(t).alias("type_no"), x["line_no"].alias("line_no"), F.lit(i).alias("pattern_no"), snippet.alias("snippet")),
            )
            for n, (t, i, p) in enumerate(RULES)
        ]
        return F.array_compact(F.array(*tests))

    patterns = [p for _, _, p in RULES]
    numbered = F.transform(lines(content), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line"), may_match(folded(l), patterns).alias("rules")))
    return F.flatten(F.transform(F.filter(numbered, lambda x: F.size(x["rules"]) > 0), of_line))


@operator("reality.evidence")
def evidence(files: DataFrame) -> DataFrame:
    """One row per file and evidence type with its hits; no shuffle."""
    types = list(enumerate(t for t, _ in R.EVIDENCE))

    def of_type(hits: Column, n: int) -> Column:
        return F.filter(hits, lambda h: h["type_no"] == n)

    def by_type(hits: Column) -> Column:
        groups = [
            F.struct(F.lit(name).alias("reality_type"), F.lit(n).alias("type_no"), of_type(hits, n).alias("hits")) for n, name in types
        ]
        return F.filter(F.array(*groups), lambda g: F.size(g["hits"]) > 0)

    rows = files.select("repo", "path", F.explode(let(_hits(F.col("content")), by_type)).alias("g")).select("repo", "path", "g.*")
    return scored(
        rows.select(
            "repo", "path", "reality_type", "type_no",
            F.transform("hits", lambda h: F.concat(F.lit("Pattern_"), h["pattern_no"].cast("string"))).alias("patterns"),
            F.transform("hits", lambda h: h["line_no"]).alias("line_numbers"),
            F.transform("hits", lambda h: h["snippet"]).alias("snippets"),
        )
    )


def scored(rows: DataFrame) -> DataFrame:
    """Add points (hundredths), level and description to evidence rows."""
    n = F.size("snippets")
    sizes = F.transform("snippets", lambda s: F.octet_length(s))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    kind = F.col("reality_type")
    points = (
        F.lit(30) + n * 10
        + F.when(F.floor(total / n) > 50, 20).otherwise(0)
        + F.when((kind == "TestingImplemented") & F.col("path").contains("test"), 30).otherwise(0)
        + F.when((kind == "DeploymentReady") & (file_name(F.col("path")) == "Dockerfile"), 40).otherwise(0)
        - F.when(F.array_min(sizes) < 10, 10).otherwise(0)
    )
    features = F.filter(
        F.transform("snippets", lambda s: F.array_join(words(s), " ")), lambda s: s != ""
    )
    named = F.array_distinct(features)
    phrase = lookup(kind, R.PHRASES)
    text = F.when(F.size(named) == 0, F.concat(phrase, F.lit(" implementation found"))).otherwise(F.concat_ws(" ", phrase, F.array_join(named, ", ")))
    return (
        rows.withColumn("points", F.least(F.greatest(points, F.lit(0)), F.lit(100)))
        .withColumn("level", level(F.col("points")))
        .withColumn("description", text)
        .withColumn("impl_id", F.concat_ws(":", F.lit("0"), "path", F.col("type_no").cast("string")))
    )


@operator("reality.dependency_evidence")
def dependency_evidence(deps: DataFrame) -> DataFrame:
    """Declared dependencies of the fixed map as partial evidence."""
    kinds = [t for t, _ in R.EVIDENCE]
    kind = lookup(F.col("name"), R.DEPENDENCY_TYPE)
    return (
        deps.where(F.col("manifest").isin("package.json", "Cargo.toml", "requirements.txt"))
        .withColumn("reality_type", kind)
        .where(F.col("reality_type").isNotNull())
        .select(
            "repo", F.col("manifest").alias("path"), "reality_type",
            (F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("reality_type")) - 1).cast("int").alias("type_no"),
            F.array(F.lit("dependency_analysis")).alias("patterns"), F.array(F.lit(0)).alias("line_numbers"),
            F.array(F.concat(F.lit("Dependency: "), "name")).alias("snippets"),
            F.lit(R.DEPENDENCY_POINTS).alias("points"), F.lit("Partial").alias("level"),
            F.concat(F.lit("Uses "), "name", F.lit(" dependency")).alias("description"),
            F.concat_ws(":", F.lit("1"), "manifest", "name", "scope").alias("impl_id"),
        )
    )


def all_evidence(files: DataFrame, deps: DataFrame) -> DataFrame:
    return evidence(files).unionByName(dependency_evidence(deps))


def _described(rows: DataFrame) -> DataFrame:
    """Rows with ``tokens`` of the description, a sorted set, and its id."""
    return rows.withColumn("tokens", F.array_sort(F.array_distinct(words(F.col("description"))))).withColumn("sid", set_id(F.col("tokens")))


def _leading(rows: DataFrame, threshold: float, made: list[str] | None = None) -> DataFrame:
    """(repo, reality_type, sid, leader) of each token set; texts are shuffled once, to be reduced to distinct sets.

    The saved tables that the result reads, and those of the rounds, are noted in ``made``.
    """
    spark = rows.sparkSession
    keys = ["repo", "reality_type"]
    distinct = _described(rows).groupBy(*keys, "sid").agg(F.first("tokens").alias("tokens"), F.min("impl_id").alias("id"))  # equal ids, equal sets
    made = [] if made is None else made
    sets = saved(distinct, "sets", made)
    least = sets.select(*keys, "sid", F.struct(F.md5(F.col("id")).alias("place"), F.col("id")).alias("id"))
    l_ids, r_ids = (least.withColumnsRenamed({"sid": f"{side}_sid", "id": side}) for side in ("l", "r"))
    edges = (
        similar_ids(sets.select(*keys, "sid", "tokens"), None, keys, threshold)
        .join(l_ids, [*keys, "l_sid"]).join(r_ids, [*keys, "r_sid"])
        .select(*keys, F.greatest("l", "r").alias("id"), F.least("l", "r").alias("earlier"))
    )
    edges = saved(edges, "edges", made)  # the first round reads them three times
    settled = new_folder(spark, "leaders")
    made.append(settled)
    member = T.StructType([edges.schema["repo"], edges.schema["reality_type"], edges.schema["id"], T.StructField("leader", edges.schema["id"].dataType)])
    edges.select(*keys, "id", F.col("id").alias("leader")).limit(0).write.parquet(settled)
    open_edges = edges
    while True:
        # A partner that is itself open is not settled yet; all others lead.
        ids = open_edges.select(*keys, F.col("id").alias("earlier")).distinct().withColumn("open", F.lit(True))
        state = open_edges.join(ids, [*keys, "earlier"], "left").groupBy(*keys, "id").agg(
            F.bool_or(F.coalesce("open", F.lit(False))).alias("waits"), F.min("earlier").alias("leader")
        )
        left = Observation()
        marked = saved(open_edges.join(state, [*keys, "id"]).observe(left, F.count("*").alias("edges")), made=made)
        if not left.get["edges"]:
            break
        joined = marked.where(~F.col("waits")).select(*keys, "id", "leader").distinct()
        joined.write.mode("append").parquet(settled)
        # A member cannot lead: its edges go; an id left without edges leads.
        open_edges = (
            marked.where("waits").select(*keys, "id", "earlier")
            .join(joined.select(*keys, F.col("id").alias("earlier")), [*keys, "earlier"], "left_anti")
        )
    members = spark.read.schema(member).parquet(settled)
    return least.join(members, [*keys, "id"], "left").select(*keys, "sid", F.coalesce("leader", "id")["id"].alias("leader"))


def leaders(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Greedy groups of alike descriptions: (repo, reality_type, description, leader).

    In the order of the MD5 of their identities, a description joins the first
    earlier leader it resembles, or becomes a leader itself. That order is as
    good as random, so a chain of descriptions that wait for each other is
    short, and so is the number of rounds. Descriptions without a resembling
    partner never enter the loop; each round settles every description whose
    earlier partners are settled and appends it to one saved table.
    """
    keys = ["repo", "reality_type"]
    return _described(rows).select(*keys, "sid", "description").distinct().join(_leading(rows, threshold), [*keys, "sid"]).select(*keys, "description", "leader")


@operator("reality.merge")
def merge(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Merged evidence, one row per leader.

    Members are combined by aggregates only; the member table keeps files,
    lines and snippets, so a group never gathers in one array.
    """
    keys = ["repo", "reality_type"]
    low = F.lower(F.array_join("snippets", "\n"))
    mark = F.xxhash64("description").alias("mark")  # tells texts of one identity apart
    narrow = _described(rows).select(
        *keys, "sid", "impl_id", "level", mark, "points", F.size("line_numbers").alias("hits"),
        *[low.contains(k).alias(f"k{i}") for i, k in enumerate(KEYWORD_BONUS)],
    )
    made: list[str] = []
    led = saved(narrow.join(_leading(rows, threshold, made), [*keys, "sid"]).drop("sid"), "led")
    drop(rows.sparkSession, made)  # the token sets are as large as the texts
    grouped = led.groupBy(*keys, "leader").agg(
        F.count("*").alias("members"),
        F.max("points").alias("points"),
        F.bool_or(F.col("level") == "Complete").alias("any_complete"),
        F.bool_or(F.col("level") == "Partial").alias("any_partial"),
        F.min(F.struct("impl_id", "level")).alias("own"),
        F.sum("hits").alias("hits"),
        *[F.bool_or(f"k{i}").alias(f"k{i}") for i in range(len(KEYWORD_BONUS))],
    )
    # the text of each group's first row is fetched last; of rows of one identity and level the least counts
    firsts = led.join(grouped.select(*keys, "leader", "own.impl_id", "own.level"), [*keys, "leader", "impl_id", "level"]).select(*keys, "leader", "impl_id", "level", "mark").distinct()
    texts = rows.select(*keys, "impl_id", "level", mark, "description")
    told = firsts.join(texts, [*keys, "impl_id", "level", "mark"]).groupBy(*keys, "leader").agg(F.min("description").alias("description"))
    found = F.array_compact(F.array(*[F.when(F.col(f"k{i}"), F.lit(k)) for i, k in enumerate(KEYWORD_BONUS)]))
    return grouped.join(told, [*keys, "leader"]).select(
        "repo", "reality_type", F.col("leader").alias("impl_id"), "description", "points",
        F.when(F.col("any_complete"), "Complete").when(F.col("any_partial"), "Partial").otherwise(F.col("own.level")).alias("level"),
        "members", "hits", found.alias("snippet_keywords"),
    )


def membership(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Evidence rows with the identity of the group's leader."""
    return _described(rows).drop("tokens").join(_leading(rows, threshold), ["repo", "reality_type", "sid"]).drop("sid")


@operator("reality.summary")
def summary(merged: DataFrame) -> DataFrame:
    facets = facet_counts(merged, "repo", {"type": "reality_type", "level": "level"})
    return facets.join(score(merged), "repo")


@operator("reality.score")
def score(merged: DataFrame) -> DataFrame:
    full, part = F.count_if(F.col("level") == "Complete"), F.count_if(F.col("level") == "Partial")
    return merged.groupBy("repo").agg(
        F.count("*").alias("total_implementations"), full.alias("fully_implemented"), part.alias("partially_implemented"),
        F.count_if(F.col("level") == "Placeholder").alias("placeholders"),
        r6((full * 2 + part) / (F.count("*") * 2)).alias("implementation_score"),
    )
