"""Confidence fusion of rule, segment and domain tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.scores import r6
from repograin.functions.text import contains_any, lookup
from repograin.registry import operator
from repograin.rules import context as X


def layer(ctx: DataFrame) -> Column:
    return F.when(F.col("segment_type") == "Database", "Data").when(contains_any(F.lower("path"), X.PRESENTATION_WORDS), "Presentation").otherwise("Business")


@operator("fusion.segments")
def fuse_segments(ctx: DataFrame, projects: DataFrame) -> DataFrame:
    """.4 project + .2 structure + .3 business + .1 architecture per segment, in ten-thousandths."""
    j = ctx.join(projects, "repo", "left").withColumn("layer", layer(ctx))
    pc = F.coalesce("project_confidence", F.lit(0.0))
    project = (
        F.when(pc > 0.7, 40).when(pc > 0.5, 30).when(pc > 0.3, 20).otherwise(0) + F.when(F.coalesce("n_domains", F.lit(0)) > 0, 30).otherwise(0)
        + F.when(F.coalesce("entry_points", F.lit(0)) > 0, 20).otherwise(0) + F.when(F.coalesce("n_deps", F.lit(0)) > 0, 10).otherwise(0)
    )
    has = lambda c: F.when(c, 1).otherwise(0)
    structure = (F.col("points") * 6 / 10).cast("int") + has(F.col("purpose").isNotNull()) * 20 + has(F.col("deps") > 0) * 10 + has(F.col("dependents") > 0) * 10
    business = F.least(F.size("hints") * 20, F.lit(100))
    arch = F.least(lookup(F.col("layer"), X.LAYER_SCORE) + has(F.col("framework").isNotNull()) * 30 + has(F.col("purpose").isNotNull()) * 20, F.lit(100))
    fused = project * 40 + F.least(structure, F.lit(100)) * 20 + business * 30 + arch * 10
    quality = F.least(fused * 7 + has(F.col("deps") > 0) * 10000 + has(F.col("dependents") > 0) * 10000, F.lit(100000)) / 100000.0
    aware = has(F.coalesce("n_domains", F.lit(0)) > 0) * 3 + has(F.size("hints") > 0) * 3 + has(F.col("dependents") > 0) * 2 + has(F.col("deps") > 0) * 2
    return j.select(
        "repo", "segment_id", "path", "layer", "framework", "hints", "purpose", project.alias("project"), structure.alias("structure"), business.alias("business"), arch.alias("architecture"),
        fused.alias("fused"), r6(quality).alias("quality"), aware.alias("awareness"),
    )


@operator("fusion.breakdown")
def breakdown(fused: DataFrame) -> DataFrame:
    p = F.col("fused")
    hi, mid, low = F.count_if(p > 7000), F.count_if((p > 4000) & (p <= 7000)), F.count_if(p <= 4000)
    return fused.groupBy("repo").agg(
        hi.alias("high"), mid.alias("medium"), low.alias("low"), F.count("*").alias("segments"), r6((hi * 85 + mid * 55 + low * 25) / F.count("*") / 100.0).alias("tier2_confidence"),
        r6(F.sum("awareness") / F.count("*") / 10.0).alias("awareness"),
    )


@operator("fusion.tier1")
def tier1(repos: DataFrame, detected: DataFrame) -> DataFrame:
    agg = detected.groupBy("repo").agg(F.sum("confidence").alias("s"), F.count("*").alias("n"), F.sum("n_evidence").alias("e"), F.array_sort(F.collect_set(lookup(F.col("framework"), X.ARCHITECTURE_OF, X.OTHER_ARCHITECTURE))).alias("patterns"))
    return repos.join(agg, "repo", "left").select(
        "repo", F.coalesce("n", F.lit(0)).alias("frameworks"), r6(F.coalesce(F.col("s") / F.col("n"), F.lit(0.5))).alias("tier1_confidence"),
        r6(F.coalesce(F.least(F.col("e") / F.col("n") / 10, F.lit(1.0)), F.lit(0.0))).alias("evidence_quality"), F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"),
    )


@operator("fusion.frameworks")
def framework_consensus(detected: DataFrame, fused: DataFrame, grounded: DataFrame) -> DataFrame:
    """Weighted consensus .3/.4/.3; tiers 2 and 3 count only where they speak."""
    n = fused.groupBy("repo").agg(F.count("*").alias("segments"))
    hit = fused.where(F.col("framework").isNotNull()).groupBy("repo", "framework").agg(F.count("*").alias("hits"))
    doms = grounded.groupBy("repo").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    j = detected.join(n, "repo", "left").join(hit, ["repo", "framework"], "left").join(doms, "repo", "left")
    t1, t2 = F.col("confidence"), F.coalesce(F.col("hits") / F.col("segments"), F.lit(0.0))
    names = F.coalesce("names", F.array().cast("array<string>"))
    tenths = None
    for fw, ws in X.ALIGNMENT.items():
        value = _aligned(names, ws) * 3
        tenths = F.when(F.col("framework") == fw, value) if tenths is None else tenths.when(F.col("framework") == fw, value)
    t3 = F.least(tenths.otherwise(F.size(names)), F.lit(10)) / 10.0
    num = t1 * 0.3 + F.when(t2 > 0, t2 * 0.4).otherwise(0.0) + F.when(F.col("t3") > 0, F.col("t3") * 0.3).otherwise(0.0)
    den = t1 * 0.3 + F.when(t2 > 0, 0.4).otherwise(0.0) + F.when(F.col("t3") > 0, 0.3).otherwise(0.0)
    agree_n = F.when(t1 > 0, t1 * 0.4).otherwise(0.0) + F.when(t2 > 0, t2 * 0.4).otherwise(0.0) + F.when(F.col("t3") > 0, F.col("t3") * 0.2).otherwise(0.0)
    agree_d = F.when(t1 > 0, 0.4).otherwise(0.0) + F.when(t2 > 0, 0.4).otherwise(0.0) + F.when(F.col("t3") > 0, 0.2).otherwise(0.0)
    return j.withColumn("t3", t3).select(
        "repo", "framework", r6(t1).alias("tier1"), r6(t2).alias("tier2"), r6(F.col("t3")).alias("tier3"),
        r6(F.when(den > 0, num / den).otherwise(t1)).alias("consensus"), r6(F.when(agree_d > 0, agree_n / agree_d).otherwise(0.0)).alias("agreement"),
    )


def _aligned(names: Column, ws: list[str]) -> Column:
    return F.size(F.filter(names, lambda d: contains_any(d, ws)))


@operator("fusion.domains")
def domain_consensus(grounded: DataFrame, fused: DataFrame, project_domains: DataFrame) -> DataFrame:
    """(.3 tier 3 + .4 tier 2) over the weights that speak; tier 2 is the share of fused confidence."""
    total = fused.groupBy("repo").agg(F.count("*").alias("n"), F.sum("fused").alias("all_points"))
    hinted = fused.select("repo", "fused", F.explode("hints").alias("name")).groupBy("repo", "name").agg(F.sum("fused").alias("hint_points"))
    listed = project_domains.select("repo", "name").distinct().withColumn("listed", F.lit(True))
    j = grounded.join(total, "repo", "left").join(hinted, ["repo", "name"], "left").join(listed, ["repo", "name"], "left")
    points = F.when(F.col("listed"), F.col("all_points")).otherwise(F.coalesce("hint_points", F.lit(0)))
    t2 = F.least(F.coalesce(points / F.col("n") / 10000.0, F.lit(0.0)), F.lit(1.0))
    t3 = F.col("confidence")
    score = (t3 * 0.3 + t2 * 0.4) / (F.lit(0.3) + F.when(t2 > 0, 0.4).otherwise(0.0))
    return j.select("repo", "name", r6(t2).alias("tier2"), r6(t3).alias("tier3"), r6(score).alias("consensus"), "status")


@operator("fusion.validated")
def validated(frameworks: DataFrame, domains: DataFrame) -> DataFrame:
    """Accepted frameworks and domains, and an issue row for each rejected one."""
    f = frameworks.select(
        "repo", F.lit("framework").alias("kind"), F.col("framework").alias("name"), "consensus",
        F.when(F.col("consensus") < 0.6, "low confidence").when(F.col("agreement") < 0.4, "low tier agreement").otherwise("accepted").alias("verdict"),
    )
    d = domains.select("repo", F.lit("domain").alias("kind"), "name", "consensus", F.when(F.col("consensus") >= 0.5, "accepted").otherwise("low confidence").alias("verdict"))
    return f.unionByName(d)


@operator("fusion.picks")
def picks(checked: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo", "kind").orderBy(F.desc("consensus"), "name")
    return checked.where("verdict = 'accepted'").withColumn("rank", F.row_number().over(w)).withColumn("role", F.when(F.col("rank") == 1, "primary").otherwise("secondary"))


@operator("fusion.assessment")
def assessment(t1: DataFrame, brk: DataFrame, fused: DataFrame, checked: DataFrame, tier3: DataFrame, detected: DataFrame) -> DataFrame:
    """Readiness, complexity, maintainability, scalability labels and next steps."""
    layers = fused.groupBy("repo").agg(F.count_distinct("layer").alias("layers"))
    ok = checked.where("kind = 'framework' AND verdict = 'accepted'").groupBy("repo").agg((F.sum("consensus") / F.count("*")).alias("framework_readiness"))
    scale = detected.groupBy("repo").agg(F.array_sort(F.collect_set(lookup(F.col("framework"), X.SCALABILITY))).alias("labels"))
    j = t1.join(brk, "repo", "left").join(layers, "repo", "left").join(ok, "repo", "left").join(tier3, "repo", "left").join(scale, "repo", "left")
    fr, aw, t3 = F.coalesce("framework_readiness", F.lit(0.0)), F.coalesce("awareness", F.lit(0.0)), F.coalesce("tier3_confidence", F.lit(0.5))
    n = F.coalesce("segments", F.lit(0))
    ready = fr * 0.4 + aw * 0.3 + t3 * 0.3
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    many = F.when(F.coalesce("layers", F.lit(0)) >= 3, F.array(F.lit("Multi-layer architecture supports horizontal scaling"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(labels, many)
    return j.select(
        "repo", r6(ready).alias("readiness"), r6((F.coalesce("layers", F.lit(0)) / 5 + F.least(n / 100, F.lit(1.0))) / 2).alias("complexity"),
        r6((F.when(F.size("patterns") > 0, 0.8).otherwise(0.4) + aw) / 2).alias("maintainability"),
        F.when(F.size(both) == 0, F.array(F.lit("Standard scalability patterns detected"))).otherwise(both).alias("scalability"),
        F.when(ready >= 0.8, F.array(F.lit("Project is ready for implementation")))
        .when(ready >= 0.6, F.array(F.lit("Address remaining framework configuration"), F.lit("Finalize business requirements")))
        .otherwise(F.array(F.lit("Improve framework detection confidence"), F.lit("Enhance business context understanding"), F.lit("Validate architectural decisions"))).alias("next_steps"),
    )


@operator("fusion.quality")
def quality(t1: DataFrame, brk: DataFrame, tier3: DataFrame, picked: DataFrame, assess: DataFrame, fused: DataFrame, grounded: DataFrame) -> DataFrame:
    """.3 alignment + .25 distribution + .25 consensus + .2 completeness, and the gain over tier 1."""
    has = picked.groupBy("repo").agg(
        *[F.bool_or((F.col("kind") == k) & (F.col("role") == r)).alias(f"{k}_{r}") for k in ("framework", "domain") for r in ("primary", "secondary")], (F.sum("consensus") / F.count("*")).alias("overall")
    )
    hints = fused.select("repo", "segment_id", F.explode("hints").alias("name")).join(grounded.select("repo", "name"), ["repo", "name"], "left_semi").select("repo", "segment_id").distinct().groupBy("repo").agg(F.count("*").alias("aligned"))
    j = t1.join(brk, "repo", "left").join(tier3, "repo", "left").join(has, "repo", "left").join(assess.select("repo", "readiness"), "repo", "left").join(hints, "repo", "left")
    a, b, c = F.col("tier1_confidence"), F.coalesce("tier2_confidence", F.lit(0.0)), F.coalesce("tier3_confidence", F.lit(0.5))
    aw = F.coalesce("awareness", F.lit(0.0))
    share = F.when(F.coalesce("segments", F.lit(0)) == 0, 0.5).otherwise(F.coalesce("aligned", F.lit(0)) / F.col("segments"))
    align = (F.sqrt(a * aw) + share) / 2
    mean = (a + b + c) / 3
    sq = lambda x: (x - mean) * (x - mean)
    dist = F.least(F.greatest(mean * (1 - F.sqrt((sq(a) + sq(b) + sq(c)) / 3)), F.lit(0.0)), F.lit(1.0))
    overall = F.coalesce("overall", F.lit(0.0))
    flag = lambda n, w: F.when(F.coalesce(F.col(n), F.lit(False)), w).otherwise(0)
    complete = (flag("framework_primary", 3) + flag("framework_secondary", 1) + flag("domain_primary", 3) + flag("domain_secondary", 1) + F.when(F.size("patterns") > 0, 1).otherwise(0) + F.when(F.col("readiness") > 0.5, 1).otherwise(0)) / 10.0
    consistent = (3 - F.abs(a - b) - F.abs(a - c) - F.abs(b - c)) / 3
    gain = F.when(a > 0, F.greatest((overall - a) / a, F.lit(0.0))).otherwise(overall)
    return j.select(
        "repo", r6(align).alias("alignment"), r6(dist).alias("distribution"), r6(overall).alias("consensus"), r6(complete).alias("completeness"), r6(consistent).alias("consistency"),
        r6(align * 0.3 + dist * 0.25 + overall * 0.25 + complete * 0.2).alias("quality"), r6(gain).alias("improvement"),
    )
