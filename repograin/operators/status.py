"""Unified status: features, backlog, priorities, actions, overall completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.scores import r6
from repograin.functions.text import lookup
from repograin.operators import markers
from repograin.operators.conflicts import description_tokens, first_alike
from repograin.functions.ranking import running_number
from repograin.functions.similarity import set_id
from repograin.registry import operator
from repograin.rules import reality as R


@operator("status.incomplete_features")
def incomplete_features(conflicts: DataFrame) -> DataFrame:
    """Conflicts with both sides at partial or skeleton level, and what they lack."""
    lacking = F.filter("keywords", lambda k: ~F.array_contains(F.col("snippet_keywords"), k))
    named = F.transform(lacking, lambda k: F.concat(F.lit("Missing "), k))
    return conflicts.where(F.col("claim_id").isNotNull() & F.col("impl_level").isin("Partial", "Skeleton")).select(
        "repo", "claim_id", F.col("claim_text").alias("feature_name"), F.col("impl_text").alias("actual_implementation"),
        F.when(F.col("impl_level") == "Partial", 0.5).otherwise(0.2).alias("completion"),
        F.when(F.size(named) == 0, F.array(F.lit("Unknown missing components"))).otherwise(named).alias("missing_components"),
    )


@operator("status.missing_implementations")
def missing_implementations(conflicts: DataFrame) -> DataFrame:
    return conflicts.where(F.col("conflict_type") == "ClaimedButNotImplemented").select(
        "repo", "claim_id", F.col("claim_text").alias("feature_name"),
        F.concat(F.lit("Implementation for "), F.lower("claim_type")).alias("expected_implementation"), F.col("confidence").alias("priority_score"),
    )


@operator("status.partial_implementations")
def partial_implementations(reality: DataFrame) -> DataFrame:
    return reality.where(F.col("level") == "Partial").select(
        "repo", "impl_id", F.col("description").alias("feature_name"),
        F.when(F.col("points") > 80, "Development").when(F.col("points") > 50, "Prototype").otherwise("Skeleton").alias("quality"),
        (F.col("points") / 100.0).alias("completion_estimate"),
    )


@operator("status.feature_board")
def feature_board(claims: DataFrame, reality: DataFrame) -> DataFrame:
    """Every claim with its first alike evidence, and evidence no claim describes."""
    first = first_alike(claims, reality, 0.3, 1)
    impl = reality.select("repo", F.col("impl_id").alias("sim_id"), F.col("points").alias("ip"), F.col("level").alias("il"), F.col("description").alias("impl_text"))
    board = (
        claims.withColumn("sid", set_id(description_tokens(F.col("description"), 1)))
        .join(first, ["repo", "sid"], "left").join(impl, ["repo", "sim_id"], "left")
    )
    status = F.when(F.col("il") == "Complete", "CompletelyImplemented").when(F.col("il") == "Partial", "PartiallyImplemented").otherwise("PlannedNotImplemented")
    ip = F.col("ip")
    done = (
        F.when(ip >= 90, "Complete").when(ip >= 70, "NearComplete").when(ip >= 30, "Partial").when(ip >= 10, "Minimal").otherwise("NotStarted")
    )
    claimed = board.select(
        "repo", F.col("claim_id").alias("item_id"), F.col("description").alias("feature_name"), status.alias("status"), done.alias("completion"),
        F.coalesce(ip, F.col("points")).alias("p"), "impl_text",
    )
    # Descriptions in use; a description is compared as text, as claims of one wording share it.
    used = claimed.where(F.col("impl_text").isNotNull()).select("repo", F.col("impl_text").alias("description")).distinct()
    level_done = {"Complete": "Complete", "Partial": "Partial", "Skeleton": "Minimal", "Placeholder": "NotStarted"}
    rest = (
        reality.groupBy("repo", "description").agg(F.min(F.struct("impl_id", "level", "points")).alias("m"))
        .join(used, ["repo", "description"], "left_anti")
        .select(
            "repo", F.col("m.impl_id").alias("item_id"), F.col("description").alias("feature_name"), F.lit("UnplannedImplemented").alias("status"),
            lookup(F.col("m.level"), level_done).alias("completion"), F.col("m.points").alias("p"), F.col("description").alias("impl_text"),
        )
    )
    both = claimed.unionByName(rest)
    return both.select("repo", "item_id", "feature_name", "status", "completion", (F.col("p") / 100.0).alias("confidence"), actions(F.col("status"), F.col("completion")).alias("next_actions"))


def actions(status: Column, completion: Column) -> Column:
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(status == "PlannedNotImplemented", lit("Implement this feature"))
        .when((status == "PartiallyImplemented") & (completion == "Partial"), lit("Complete the implementation", "Add error handling", "Add tests"))
        .when(status == "CompletelyImplemented", lit("Consider enhancements"))
        .when(status == "UnplannedImplemented", lit("Document this feature"))
        .otherwise(lit("Review implementation status"))
    )


@operator("status.priorities")
def priorities(conflicts: DataFrame) -> DataFrame:
    """Missing claims with impact, ease and confidence, best first when sorted by score."""
    impact, hard = F.col("claim_priority"), lookup(F.col("claim_type"), R.COMPLEXITY_BY_CLAIM, R.DEFAULT_COMPLEXITY)
    timeline = lookup(F.concat_ws("/", impact, "complexity"), {f"{a}/{b}": v for (a, b), v in R.TIMELINE.items()})
    # ten-thousandths: impact x .4, ease x .2, confidence x .2
    score = lookup(impact, R.IMPACT_SCORE) * 40 + lookup(F.col("complexity"), R.EASE_SCORE) * 20 + F.round(F.col("confidence") * 100).cast("int") * 20
    return (
        conflicts.where(F.col("conflict_type") == "ClaimedButNotImplemented").withColumn("complexity", hard)
        .select(
            "repo", "claim_id", F.col("claim_text").alias("feature_name"), impact.alias("business_impact"), "complexity",
            lookup(F.col("complexity"), R.EFFORT_BY_COMPLEXITY).alias("estimated_effort"), timeline.alias("timeline"), (score / 10000.0).alias("priority_score"),
        )
    )


@operator("status.recommended_actions")
def recommended_actions(conflicts: DataFrame, todos: DataFrame, limit: int | None = None) -> DataFrame:
    """Critical conflicts first, then urgent markers, ranked in each repository; all of them, or the first ``limit``."""
    kinds = {"ClaimedButNotImplemented": "Implement", "ImplementedButNotClaimed": "Document", "ImplementationMismatch": "Complete"}
    group = {"ImplementationMismatch": 0, "ClaimedButNotImplemented": 1, "ImplementedButNotClaimed": 2}
    first = conflicts.where(F.col("severity") == "Critical").select(
        "repo", lookup(F.col("conflict_type"), group).alias("g"), F.coalesce("claim_id", "impl_id").alias("o1"), F.lit(0).alias("o2"),
        lookup(F.col("conflict_type"), kinds, "Fix").alias("action_type"), F.col("action").alias("description"),
        F.coalesce("claim_text", "impl_text").alias("target_feature"), F.lit("Urgent").alias("priority"), F.lit("Medium").alias("effort"),
    )
    d = F.col("description")
    then = todos.where(F.col("priority").isin("Critical", "High")).select(
        "repo", F.lit(3).alias("g"), F.col("path").alias("o1"), F.col("line_no").alias("o2"), F.lit("Implement").alias("action_type"),
        F.concat(F.lit("Address TODO: "), d).alias("description"), d.alias("target_feature"),
        F.when(F.col("priority") == "Critical", "Urgent").otherwise("High").alias("priority"), markers.effort(d).alias("effort"),
    )
    every = first.unionByName(then)
    if limit is None:
        return running_number(every, ["repo"], ["g", "o1", "o2"], "rank").drop("g", "o1", "o2")
    # A rank limit is cut per task before the shuffle.
    w = Window.partitionBy("repo").orderBy("g", "o1", "o2")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("g", "o1", "o2")


@operator("status.accuracy")
def accuracy(repos: DataFrame, matched: DataFrame, reality: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Share of claims that hold, share of evidence that is documented."""
    c = matched.groupBy("repo").agg(F.count("*").alias("claims"), F.count("impl_id").alias("matched"))
    e = reality.groupBy("repo").agg(F.count("*").alias("evidence"))
    f = conflicts.where(F.col("conflict_type") == "ClaimedButNotImplemented").groupBy("repo").agg(F.count("*").alias("false_claims"))
    out = repos.join(c, "repo", "left").join(e, "repo", "left").join(f, "repo", "left").fillna(0)
    return out.select(
        "repo", "claims", "matched", "evidence", "false_claims",
        r6(F.when(F.col("claims") == 0, 1.0).otherwise(1 - F.col("false_claims") / F.col("claims"))).alias("documentation_accuracy"),
        r6(F.when(F.col("evidence") == 0, 0.0).otherwise(F.least(F.col("matched") / F.col("evidence"), F.lit(1.0)))).alias("implementation_coverage"),
    )


@operator("status.discrepancies")
def discrepancies(conflicts: DataFrame) -> DataFrame:
    return conflicts.where(F.col("severity").isin("Critical", "High")).select(
        "repo", "conflict_type", "severity", "claim_id", "impl_id", "description", lookup(F.col("conflict_type"), R.IMPACTS, R.DEFAULT_IMPACT).alias("impact"),
        F.col("action").alias("recommendation"),
    )


@operator("status.recommendations")
def recommendations(matched: DataFrame, reality: DataFrame) -> DataFrame:
    """Rows that say how many features to implement and how many to document."""
    claims = matched.where(F.col("impl_id").isNull()).groupBy("repo").agg(F.count("*").alias("n"))
    used = matched.where(F.col("impl_id").isNotNull()).select("repo", "impl_id").distinct()
    impls = reality.join(used, ["repo", "impl_id"], "left_anti").groupBy("repo").agg(F.count("*").alias("n"))
    return claims.select(
        "repo", F.lit("ImplementFeature").alias("kind"), F.format_string("Implement %d features claimed in documentation", "n").alias("description"), F.lit("High").alias("priority")
    ).unionByName(impls.select(
        "repo", F.lit("UpdateDocumentation").alias("kind"), F.format_string("Document %d implemented features", "n").alias("description"), F.lit("Medium").alias("priority")
    ))


@operator("status.overall")
def overall(completion: DataFrame, reality_score: DataFrame, conflict_scores: DataFrame) -> DataFrame:
    """.4 explicit + .3 inferred + .2 implementation per repository."""
    score = F.coalesce("implementation_score", F.lit(0.0))
    inferred = F.greatest(score - F.col("critical_conflicts") * 0.1, F.lit(0.0))
    return completion.join(reality_score, "repo", "left").join(conflict_scores, "repo", "left").select(
        "repo", "completion_score", r6(inferred).alias("inferred_score"), r6(score).alias("implementation_score"),
        r6(F.col("completion_score") * 0.4 + inferred * 0.3 + score * 0.2).alias("overall_completion"), F.col("consistency_score").alias("confidence"),
    )
