"""Domain grounding: business terms in segments, insights, relations, roadmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.scores import r6
from repograin.functions.text import contains_any, lookup
from repograin.registry import operator
from repograin.rules import context as X


@operator("grounding.evidence")
def evidence(segments: DataFrame) -> DataFrame:
    """Business keywords per segment, counted per repository."""
    low = F.lower("content")
    hits = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in X.KEYWORDS]))
    return segments.select("repo", F.explode(hits).alias("keyword")).groupBy("repo", "keyword").agg(F.count("*").alias("segments"))


@operator("grounding.names")
def grounded_names(adjusted: DataFrame) -> DataFrame:
    return adjusted.select("repo", lookup(F.col("domain"), X.GROUND_NAMES, F.col("domain")).alias("name"), "confidence")


@operator("grounding.totals")
def totals(repos: DataFrame, kw: DataFrame, segments: DataFrame) -> DataFrame:
    """Per repository: keyword rows, segment file names, file-name terms."""
    terms = list(dict.fromkeys(t for _, ts, _ in X.GROUNDS.values() for t in ts))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    n = segments.groupBy("repo").agg(F.count("*").alias("files"), F.array_sort(F.collect_set(F.lit(None).cast("string"))).alias("none"))
    in_names = segments.select("repo", F.explode(F.array_compact(F.array(*[F.when(name.contains(t), F.lit(t)) for t in terms]))).alias("term")).groupBy("repo").agg(F.array_sort(F.collect_set("term")).alias("file_terms"))
    per = kw.groupBy("repo").agg(F.sum("segments").alias("patterns"), F.array_sort(F.collect_set("keyword")).alias("keywords"))
    none = F.array().cast("array<string>")
    return repos.join(n.drop("none"), "repo", "left").join(in_names, "repo", "left").join(per, "repo", "left").select(
        "repo", F.coalesce("patterns", F.lit(0)).alias("patterns"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("file_terms", none).alias("file_terms")
    )


@operator("grounding.terms")
def term_hits(names: DataFrame, total: DataFrame) -> DataFrame:
    """(repo, name, pattern): a domain's terms that a found keyword or file name holds."""
    j = names.join(total, "repo")
    out = None
    for n, (text, terms, _) in X.GROUNDS.items():
        value = F.array_compact(F.array(*[_term(t, text) for t in terms]))
        out = F.when(F.col("name") == n, value) if out is None else out.when(F.col("name") == n, value)
    return j.select("repo", "name", F.explode(out).alias("pattern"))


def _term(term: str, text: str) -> Column:
    shown = [k for k in X.KEYWORDS if term in f"business_keyword:{k}"]
    held = F.arrays_overlap("keywords", F.array(*[F.lit(k) for k in shown])) if shown else F.lit(False)
    return F.when(held | F.array_contains("file_terms", term), F.lit(text % term))


def capabilities(name: Column) -> Column:
    out = None
    for n, (_, _, caps) in X.GROUNDS.items():
        value = F.array(*[F.lit(c) for c in caps])
        out = F.when(name == n, value) if out is None else out.when(name == n, value)
    return out.otherwise(F.array(F.concat(name, F.lit(" Operations"))))


def _steps(name: Column, steps, default: int) -> Column:
    out = None
    for points, ws in steps:
        test = contains_any(F.lower(name), ws)
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(default)


@operator("grounding.insights")
def insights(names: DataFrame, total: DataFrame, kw: DataFrame, terms: DataFrame) -> DataFrame:
    """Patterns, capabilities, completeness (thousandths) and business value per domain."""
    found = terms.groupBy("repo", "name").agg(F.count("*").alias("n_patterns"))
    named = names.select("repo", "name").join(kw, "repo").where(F.contains(F.concat(F.lit("business_keyword:"), "keyword"), F.lower("name"))).groupBy("repo", "name").agg(F.sum("segments").alias("support"))
    j = names.join(total.select("repo", "patterns", "files"), "repo").join(found, ["repo", "name"], "left").join(named, ["repo", "name"], "left").fillna(0, ["n_patterns", "support"])
    value = F.least(F.lit(50) + _steps(F.col("name"), X.BUSINESS_VALUE_STEPS, 0) + F.col("patterns"), F.lit(100))
    return j.select("repo", "name", "confidence", "n_patterns", "support", "patterns", "files", capabilities(F.col("name")).alias("capabilities"), F.least(F.col("support"), F.lit(10)).alias("tenths"), (value / 100.0).alias("business_value"))


@operator("grounding.relations")
def relations(ins: DataFrame, terms: DataFrame) -> DataFrame:
    """Unordered domain pairs of a repository whose patterns share a word.

    A repository holds a short fixed list of domains, so its pairs are few; the
    words of a domain's patterns are a small set.
    """
    words = terms.select("repo", "name", "pattern", F.split("pattern", " ").alias("w"))
    sets = words.select("repo", "name", F.explode("w").alias("word")).groupBy("repo", "name").agg(F.collect_set("word").alias("words"))
    n = ins.select("repo", "name", "n_patterns")
    a = words.withColumnsRenamed({"name": "a"})
    b = sets.withColumnsRenamed({"name": "b", "words": "b_words"})
    common = a.join(b, "repo").where((F.col("a") < F.col("b")) & F.arrays_overlap("w", "b_words")).groupBy("repo", "a", "b").agg(F.count("*").alias("common"))
    j = common.join(n.withColumnsRenamed({"name": "a", "n_patterns": "na"}), ["repo", "a"]).join(n.withColumnsRenamed({"name": "b", "n_patterns": "nb"}), ["repo", "b"])
    pair = lambda x: (F.col("a") == x) | (F.col("b") == x)
    kind = F.when((F.col("a") == "E-commerce") & (F.col("b") == "User Management"), "Authentication Integration").when(pair("Analytics"), "Data Flow").when(pair("API"), "Service Integration").otherwise("Functional Dependency")
    return j.select("repo", "a", "b", kind.alias("relation"), r6(F.least(F.col("common") / (F.col("na") + F.col("nb")), F.lit(1.0))).alias("strength"))


@operator("grounding.coherence")
def coherence(repos: DataFrame, rel: DataFrame) -> DataFrame:
    agg = rel.groupBy("repo").agg((F.sum("strength") / F.count("*")).alias("c"))
    return repos.join(agg, "repo", "left").select("repo", r6(F.coalesce("c", F.lit(0.5))).alias("coherence"))


@operator("grounding.integration_points")
def integration_points(terms: DataFrame) -> DataFrame:
    p = F.col("pattern")
    agg = terms.groupBy("repo", "name").agg(F.bool_or(contains_any(p, ["api", "service"])).alias("s"), F.bool_or(contains_any(p, ["auth", "user"])).alias("u"))
    rows = F.array_compact(F.array(F.when(F.col("s"), "Service integration capabilities"), F.when(F.col("u"), "User context integration")))
    return agg.select("repo", "name", F.explode(rows).alias("point"))


@operator("grounding.conflicts")
def conflicting(ins: DataFrame) -> DataFrame:
    """Domain pairs sharing more than half of the first one's capabilities."""
    a = ins.select("repo", F.col("name").alias("a"), F.col("capabilities").alias("ca"))
    b = ins.select("repo", F.col("name").alias("b"), F.col("capabilities").alias("cb"))
    return a.join(b, "repo").where("a < b").where(F.size(F.array_intersect("ca", "cb")) > F.floor(F.size("ca") / 2)).select("repo", "a", "b")


@operator("grounding.validate")
def validate(ins: DataFrame) -> DataFrame:
    """Mean of three rule scores (hundredths) and the issues behind the deductions."""
    few, none, little = F.col("n_patterns") < 2, F.col("support") == 0, F.col("support") < 3
    low, thin = F.col("tenths") < 3, F.col("n_patterns") * 2 < F.size("capabilities")
    points = (F.lit(80) - F.when(few, 30).otherwise(0)) + (F.lit(70) - F.when(none, 40).when(little, 20).otherwise(0) - F.when(low, 20).otherwise(0)) + (F.lit(80) - F.when(thin, 30).otherwise(0))
    named = lambda t: F.concat(F.lit(t), "name")
    issues = F.array_compact(F.array(
        F.when(few, named("Insufficient patterns found for ")), F.when(none, named("No supporting evidence found for ")).when(little, named("Limited evidence for ")),
        F.when(low, named("Low implementation completeness for ")), F.when(thin, "Inconsistency between detected patterns and claimed capabilities"),
    ))
    return ins.select("repo", "name", r6(F.greatest(points, F.lit(0)) / 300.0).alias("validation"), issues.alias("issues"))


@operator("grounding.grounded")
def grounded(ins: DataFrame, val: DataFrame, total: DataFrame) -> DataFrame:
    """Domains whose validation exceeds 0.6, with strength and status."""
    t = F.col("tenths")
    status = F.when(t > 8, "Complete").when(t > 5, "In Progress").when(t > 2, "Partial").otherwise("Planned")
    return ins.join(val, ["repo", "name"]).where(F.col("validation") > 0.6).select("repo", "name", "confidence", "validation", "capabilities", (F.least(F.col("support"), F.lit(10)) / 10.0).alias("strength"), status.alias("status"))


@operator("grounding.roadmap")
def roadmap(ground: DataFrame, rel: DataFrame) -> DataFrame:
    """Domains by priority with effort, value and related domains."""
    both = rel.select("repo", F.col("a").alias("name"), F.col("b").alias("other")).unionByName(rel.select("repo", F.col("b").alias("name"), F.col("a").alias("other")))
    linked = both.groupBy("repo", "name").agg(F.array_sort(F.collect_set("other")).alias("related"))
    priority = r6(F.col("confidence") * 0.4 + F.col("strength") * 0.3 + lookup(F.col("status"), X.STATUS_WEIGHT) / 100.0 * 0.3)
    w = Window.partitionBy("repo").orderBy(F.desc("priority"), "name")
    value = F.least(_steps(F.col("name"), X.ROADMAP_VALUES, 50) / 100.0 * F.col("confidence") * F.col("strength"), F.lit(1.0))
    return ground.withColumn("priority", priority).join(linked, ["repo", "name"], "left").select(
        "repo", F.row_number().over(w).alias("step"), "name", "priority", lookup(F.col("status"), X.EFFORTS).alias("effort"), r6(value).alias("business_value"), F.coalesce("related", F.array().cast("array<string>")).alias("related")
    )


@operator("grounding.summary")
def summary(total: DataFrame, names: DataFrame) -> DataFrame:
    d = names.groupBy("repo").agg(F.count("*").alias("domains"), F.min(F.struct((-F.col("confidence")).alias("neg"), "name")).alias("m"))
    n = F.coalesce("domains", F.lit(0))
    q = (F.least(F.col("patterns") / 20, F.lit(1.0)) + F.least(F.col("files") / 10, F.lit(1.0)) + F.least(n / 5, F.lit(1.0))) / 3
    return total.join(d, "repo", "left").select("repo", "patterns", "files", n.alias("domains"), F.coalesce("m.name", F.lit("None")).alias("strongest"), r6(q).alias("quality"))
