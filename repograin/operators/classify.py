"""Project classification, entry points and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.automaton import Rule, hits, scores
from repograin.functions.scores import r6
from repograin.functions.text import contains_any, lookup
from repograin.registry import operator
from repograin.rules import domains as B


TYPE_RULES = [
    Rule("analysis_tool", ("name",), tuple(B.NAME_PATTERNS), 0.3),
    Rule("analysis_tool", ("dependency",), tuple(B.ANALYSIS_DEPS), 0.25, share=True),
    Rule("analysis_tool", ("dependency",), tuple(B.ANALYSIS_CLI), 0.1, share=True),
    Rule("analysis_tool", ("readme",), tuple(B.ANALYSIS_README), 0.2, share=True),
    Rule("web_application", ("dependency",), tuple(B.WEB_DEPS), 0.25, share=True),
]


def manifest_deps(preferred: DataFrame, deps: DataFrame) -> DataFrame:
    """Dependencies of each repository's chosen manifest, in lower case."""
    return preferred.select("repo", "manifest").join(deps.select("repo", "manifest", F.lower("name").alias("dep"), "scope"), ["repo", "manifest"])


@operator("classify.facts")
def facts(repos: DataFrame, preferred: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: its chosen manifest, what its dependencies show, and the README's first line."""
    dep = F.col("dep")
    direct = F.when(~F.col("scope").isin("devDependencies", "dev-dependencies"), dep)
    agg = manifest_deps(preferred, deps).groupBy("repo").agg(
        F.bool_or(F.coalesce(contains_any(direct, B.HEURISTIC_WEB), F.lit(False))).alias("is_web"), F.bool_or(contains_any(dep, B.HEURISTIC_CLI)).alias("is_cli"), F.count("*").alias("n_deps"),
    )
    readme = files.where("path = 'README.md'").select("repo", F.regexp_extract("content", r"^([^\r\n]*)", 1).alias("readme"))
    return preferred.join(agg, "repo", "left").join(readme, "repo", "left").fillna(0, ["n_deps"]).fillna(False, ["is_web", "is_cli"])


@operator("classify.type_texts")
def type_texts(preferred: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, scope, text``: what type rules look at; READMEs are read where they are scanned."""
    named = preferred.select("repo", F.lit("name").alias("scope"), F.lower("name").alias("text"))
    needed = manifest_deps(preferred, deps).select("repo", F.lit("dependency").alias("scope"), F.col("dep").alias("text"))
    readme = files.where("path = 'README.md'").select("repo", F.lit("readme").alias("scope"), F.lower("content").alias("text"))
    return named.unionByName(needed).unionByName(readme)


@operator("classify.weighted")
def weighted(preferred: DataFrame, texts: DataFrame, rules: Sequence[Rule] = TYPE_RULES) -> DataFrame:
    """(repo, project_type, score) of the types with a positive score, by rules that may be loaded at run time."""
    found = hits(texts, rules, ["repo"]).join(preferred.select("repo"), "repo", "left_semi")
    return scores(found, rules, ["repo"]).select("repo", F.col("subject").alias("project_type"), r6(F.col("score")).alias("score")).where(F.col("score") > 0)


@operator("classify.heuristic")
def heuristic(fact: DataFrame) -> DataFrame:
    return fact.select("repo", F.when(F.col("is_web"), "web_application").when(F.col("is_cli"), "cli_tool").otherwise("library").alias("project_type"), F.lit(0.5).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "project_type")
    return scores.withColumn("rank", F.row_number().over(w))


@operator("classify.project_type")
def project_type(fact: DataFrame, scored: DataFrame) -> DataFrame:
    """Weighted result if strong, else heuristic."""
    best = scored.groupBy("repo").agg(F.min(F.struct((-F.col("score")).alias("neg"), "project_type")).alias("m"))
    both = heuristic(fact).join(best, "repo", "left")
    strong = -F.col("m.neg") > 0.3
    return both.select(
        "repo", F.when(strong, F.col("m.project_type")).otherwise(F.col("project_type")).alias("project_type"),
        F.when(strong, -F.col("m.neg")).otherwise(F.col("score")).alias("confidence"),
    )


@operator("classify.alternatives")
def alternatives(scored: DataFrame) -> DataFrame:
    """All types but the best, by rank."""
    return ranked(scored).where(F.col("rank") >= 2)


@operator("classify.entry_points")
def entry_points(files: DataFrame, preferred: DataFrame) -> DataFrame:
    """Known entry files of the repository's package manager."""
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(c).alias("c")) for m, p, t, c in B.ENTRY_POINTS])
    here = files.where(F.col("path").isin([p for _, p, _, _ in B.ENTRY_POINTS])).select("repo", "path").join(preferred.select("repo", "package_manager"), "repo")
    hit = F.filter(keys, lambda k: (k["m"] == F.col("package_manager")) & (k["p"] == F.col("path")))
    return here.select("repo", "path", F.explode(hit).alias("h")).select("repo", "path", F.col("h.t").alias("entry_type"), (F.col("h.c") / 100.0).alias("confidence"))


@operator("classify.keywords")
def keywords(files: DataFrame) -> DataFrame:
    """README words of the project-type and domain vocabularies."""
    low = F.lower("content")
    vocab = [("purpose", w) for w in B.ANALYSIS_README] + [("domain", w) for _, _, ws, _ in B.CONFIG.values() for w in ws]
    hits = F.array_compact(F.array(*[F.when(low.contains(w), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("keyword"))) for k, w in dict.fromkeys(vocab)]))
    return files.where("path = 'README.md'").select("repo", F.explode(hits).alias("h")).select("repo", "h.kind", "h.keyword")


def labels(column: Column) -> list[Column]:
    return [
        lookup(column, {k: v[0] for k, v in B.PROJECT_TYPES.items()}, "Unknown").alias("display_name"),
        lookup(column, {k: v[1] for k, v in B.PROJECT_TYPES.items()}, B.PROJECT_TYPES["unknown"][1]).alias("analysis_focus"),
    ]


@operator("classify.profile")
def profile(fact: DataFrame, types: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """Metadata, type, purpose sentence, domain hints and counts."""
    first = F.trim(F.regexp_replace("readme", "^#+", ""))
    n = entries.groupBy("repo").agg(F.count("*").alias("entry_points"))
    kw = words.groupBy("repo").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "domain", F.col("keyword")))).alias("domain_keywords"))
    hints = None
    for t, (_, _, hs) in B.PROJECT_TYPES.items():
        value = F.array(*[F.lit(h) for h in hs]) if hs else F.col("domain_keywords")
        hints = F.when(F.col("project_type") == t, value) if hints is None else hints.when(F.col("project_type") == t, value)
    out = fact.join(types, "repo").join(n, "repo", "left").join(kw, "repo", "left")
    purpose = F.when(F.col("readme").isNotNull(), F.when(F.col("description").isNotNull(), F.concat_ws(" - ", "description", first)).otherwise(first)).otherwise(
        F.coalesce("description", labels(F.col("project_type"))[0])
    )
    return out.select(
        "repo", "name", "package_manager", "project_type", "confidence", *labels(F.col("project_type")), purpose.alias("purpose"),
        F.coalesce(hints, F.array().cast("array<string>")).alias("domain_hints"), F.coalesce("entry_points", F.lit(0)).alias("entry_points"), "n_deps", "description",
    )
