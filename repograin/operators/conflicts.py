"""Claims against evidence: matches, three kinds of conflict, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.facets import facet_counts
from repograin.functions.scores import r6
from repograin.functions.similarity import set_id, similar_ids
from repograin.functions.text import lookup
from repograin.registry import operator
from repograin.rules import reality as R
from repograin.session import saved


def description_tokens(text: Column, min_bytes: int = 3) -> Column:
    """Sorted distinct lower-cased words of at least ``min_bytes`` bytes."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.octet_length(w) >= min_bytes)))


def first_alike(claims: DataFrame, reality: DataFrame, threshold: float, min_bytes: int) -> DataFrame:
    """Per claim token set, by its id, the first evidence row with a similar description.

    Evidence is reduced to its first row per distinct token set before the
    join, so repeated descriptions meet a claim once.
    """

    def sets(df: DataFrame, *also: str) -> DataFrame:
        named = df.select("repo", description_tokens(F.col("description"), min_bytes).alias("tokens"), *also)
        return named.withColumn("sid", set_id(F.col("tokens")))

    c = sets(claims).groupBy("repo", "sid").agg(F.first("tokens").alias("tokens"))  # equal ids, equal sets
    e = saved(sets(reality, "impl_id").groupBy("repo", "sid").agg(F.first("tokens").alias("tokens"), F.min("impl_id").alias("impl_id")), "sets")
    pairs = similar_ids(saved(c, "sets"), e.select("repo", "sid", "tokens"), ["repo"], threshold)
    return (
        pairs.join(e.select("repo", F.col("sid").alias("r_sid"), "impl_id"), ["repo", "r_sid"])
        .groupBy("repo", F.col("l_sid").alias("sid")).agg(F.min("impl_id").alias("sim_id"))
    )


@operator("conflicts.matches")
def matches(claims: DataFrame, reality: DataFrame) -> DataFrame:
    """Each claim with its first evidence row, by mapped type or similar text.

    "First" is a minimum per (repo, type) and per token set, so no claim is
    ever paired with all evidence of its type.
    """
    by_type = reality.groupBy("repo", "reality_type").agg(F.min("impl_id").alias("type_id"))
    mapped = claims.withColumn("reality_type", lookup(F.col("claim_type"), R.CLAIM_TO_EVIDENCE)).withColumn(
        "sid", set_id(description_tokens(F.col("description")))
    )
    both = mapped.join(by_type, ["repo", "reality_type"], "left").join(first_alike(claims, reality, 0.7, 3), ["repo", "sid"], "left")
    return both.withColumn("impl_id", F.least("type_id", "sim_id")).drop("sid", "reality_type", "type_id", "sim_id")


def expected_level(claim_type: Column, priority: Column, points: Column) -> Column:
    strong = (points > 80) & priority.isin("Critical", "High")
    return F.when(strong | claim_type.isin("Security", "Api"), "Complete").otherwise("Partial")


def mismatch_severity(priority: Column, claim_points: Column, impl_points: Column, level: Column) -> Column:
    """Score in ten-thousandths, so thresholds compare whole numbers."""
    score = lookup(priority, R.PRIORITY_WEIGHT) * 100 + (claim_points + impl_points) * 15 + lookup(level, R.LEVEL_GAP) * 100
    return F.when(score >= 9000, "Critical").when(score >= 7000, "High").when(score >= 5000, "Medium").otherwise("Low")


def claim_severity(claim_type: Column, priority: Column, points: Column) -> Column:
    up = {"Low": "Medium", "Medium": "High", "High": "Critical", "Critical": "Critical"}
    return F.when((points > 80) & claim_type.isin("Security", "Api"), lookup(priority, up)).otherwise(priority)


_COLUMNS = [
    "repo", "conflict_type", "severity", "claim_id", "impl_id", "points2", "strategy", "description",
    "claim_text", "claim_type", "claim_priority", "impl_text", "impl_level", "keywords", "snippet_keywords",
]


def _finish(df: DataFrame) -> DataFrame:
    none = {"claim_id": "string", "impl_id": "string", "claim_text": "string", "claim_type": "string", "claim_priority": "string",
            "impl_text": "string", "impl_level": "string", "keywords": "array<string>", "snippet_keywords": "array<string>"}
    for name, kind in none.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    strategy = F.when(F.col("severity") == "Critical", "FlagAsInconsistent").otherwise(F.col("strategy"))
    return (
        df.withColumn("strategy", strategy).select(*_COLUMNS)
        .withColumn("confidence", F.col("points2") / 200.0).withColumn("action", lookup(F.col("strategy"), R.ACTIONS)).drop("points2")
    )


@operator("conflicts.level_mismatch")
def level_mismatch(matched: DataFrame, reality: DataFrame) -> DataFrame:
    impl = reality.select(
        "repo", "impl_id", F.col("level").alias("impl_level"), F.col("points").alias("impl_points"), F.col("description").alias("impl_text"), "snippet_keywords"
    )
    expected = expected_level(F.col("claim_type"), F.col("priority"), F.col("points"))
    text = F.concat(F.lit("Implementation level mismatch: claimed as "), F.lower(expected), F.lit(" but implemented as "), "impl_level")
    return _finish(
        matched.join(impl, ["repo", "impl_id"]).where(F.col("impl_level") != expected).select(
            "repo", F.lit("ImplementationMismatch").alias("conflict_type"),
            mismatch_severity(F.col("priority"), F.col("points"), F.col("impl_points"), F.col("impl_level")).alias("severity"),
            "claim_id", "impl_id", (F.col("points") + F.col("impl_points")).alias("points2"), F.lit("PreferCode").alias("strategy"),
            text.alias("description"), F.col("description").alias("claim_text"), "claim_type", F.col("priority").alias("claim_priority"),
            "impl_text", "impl_level", "keywords", "snippet_keywords",
        )
    )


@operator("conflicts.claimed_not_implemented")
def claimed_not_implemented(matched: DataFrame) -> DataFrame:
    """Claims without a match; weak low-severity ones are dropped."""
    sev = claim_severity(F.col("claim_type"), F.col("priority"), F.col("points"))
    return _finish(
        matched.where(F.col("impl_id").isNull()).drop("impl_id").withColumn("severity", sev)
        .where(~((F.col("severity") == "Low") & (F.col("points") < 80)))
        .select(
            "repo", F.lit("ClaimedButNotImplemented").alias("conflict_type"), "severity", "claim_id", (F.col("points") * 2).alias("points2"),
            F.when(F.col("points") > 80, "FlagAsInconsistent").otherwise("PreferCode").alias("strategy"),
            F.concat(F.lit("Feature claimed in documentation but not found in code: "), "description").alias("description"),
            F.col("description").alias("claim_text"), "claim_type", F.col("priority").alias("claim_priority"), "keywords",
        )
    )


@operator("conflicts.implemented_not_claimed")
def implemented_not_claimed(matched: DataFrame, reality: DataFrame) -> DataFrame:
    """Evidence that no claim matched, if complete or partial."""
    used = matched.where(F.col("impl_id").isNotNull()).select("repo", "impl_id").distinct()
    return _finish(
        reality.where(F.col("level").isin("Complete", "Partial")).join(used, ["repo", "impl_id"], "left_anti").select(
            "repo", F.lit("ImplementedButNotClaimed").alias("conflict_type"),
            F.when(F.col("level") == "Complete", "Medium").otherwise("Low").alias("severity"), "impl_id", (F.col("points") * 2).alias("points2"),
            F.lit("Merge").alias("strategy"), F.concat(F.lit("Feature implemented in code but not documented: "), "description").alias("description"),
            F.col("description").alias("impl_text"), F.col("level").alias("impl_level"), "snippet_keywords",
        )
    )


@operator("conflicts.all")
def resolve(matched: DataFrame, reality: DataFrame) -> DataFrame:
    return (
        level_mismatch(matched, reality).unionByName(claimed_not_implemented(matched)).unionByName(implemented_not_claimed(matched, reality))
    )


@operator("conflicts.scores")
def scores(repos: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Totals and consistency per repository; 1 without conflicts."""
    n, crit = F.coalesce("n", F.lit(0)), F.coalesce("crit", F.lit(0))
    agg = conflicts.groupBy("repo").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("crit"),
        F.count_if(F.col("strategy") == "FlagAsInconsistent").alias("flagged"),
    )
    return repos.join(agg, "repo", "left").select(
        "repo", n.alias("total_conflicts"), crit.alias("critical_conflicts"), F.coalesce("flagged", F.lit(0)).alias("flagged_for_review"),
        (n - F.coalesce("flagged", F.lit(0))).alias("resolved_conflicts"),
        (F.greatest(10 - n - crit * 3, F.lit(0)) / 10.0).alias("consistency_score"),
    )


@operator("conflicts.summary")
def summary(conflicts: DataFrame) -> DataFrame:
    return facet_counts(conflicts, "repo", {"type": "conflict_type", "severity": "severity", "strategy": "strategy"})


def mean_confidence(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("repo", "conflict_type").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))
