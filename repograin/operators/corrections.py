"""Human corrections over analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.scores import bucket, r6
from repograin.registry import operator

# Default labels, before/after confidences, stage bounds.
DEFAULTS = {"market_segment": "General market", "business_model": "Not specified", "target_market": "Not specified"}
CHANGES = {"business_context": (None, 0.85), "user_personas": (None, 0.90), "feature_priorities": (0.5, None)}
OVERALL_GAIN = 0.25
STAGES = [
    (0.9, "Production-ready with minor enhancements"),
    (0.7, "Feature-complete with optimization opportunities"),
    (0.5, "Active development with partial implementation"),
    (0.2, "Early development stage"),
]
FIRST_STAGE = "Initial analysis or planning stage"


@operator("corrections.overlay")
def overlay(original: DataFrame, fixes: DataFrame) -> DataFrame:
    """Corrected product type where given, else the inferred one; default labels."""
    return original.join(fixes, "repo", "left").select(
        "repo", F.coalesce("fixed_type", "product_type").alias("product_type"), F.coalesce("market", F.lit(DEFAULTS["market_segment"])).alias("market_segment"),
        F.coalesce("model", F.lit(DEFAULTS["business_model"])).alias("business_model"), F.col("fixed_type").isNotNull().alias("corrected"),
    )


@operator("corrections.batch_personas")
def batch_personas(batch: DataFrame) -> DataFrame:
    """One persona row per named user of a comma-separated list."""
    return batch.select("repo", "context", F.posexplode(F.split("users", ",")).alias("pos", "user")).select(
        "repo", (F.col("pos") + 1).alias("n"), F.trim("user").alias("persona"), F.concat(F.lit("Primary user of "), "context").alias("description"), F.lit("High").alias("priority")
    )


@operator("corrections.confidence_change")
def confidence_change(original: DataFrame, has_priorities: Column) -> DataFrame:
    return original.select(
        "repo", r6(F.col("confidence")).alias("context_before"), F.lit(CHANGES["business_context"][1]).alias("context_after"), F.when(F.col("personas") == 0, 0.0).otherwise(0.6).alias("personas_before"),
        F.lit(CHANGES["user_personas"][1]).alias("personas_after"), F.lit(0.5).alias("priorities_before"), F.when(has_priorities, 0.85).otherwise(0.5).alias("priorities_after"), F.lit(OVERALL_GAIN).alias("overall"),
    )


@operator("corrections.compare")
def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("repo", F.col("confidence").alias("before"), F.col("items").alias("items_before"))
    a = after.select("repo", F.col("confidence").alias("after"), F.col("items").alias("items_after"))
    gain = F.col("after") - F.col("before")
    return b.join(a, "repo").select("repo", "items_before", "items_after", r6(gain).alias("gain"), F.when(r6(gain) > 0.2, "significant").when(r6(gain) > 0.1, "good").otherwise("minimal").alias("verdict"))


@operator("corrections.readiness")
def readiness(counts: DataFrame) -> DataFrame:
    """Ten-point context score, stage and grades; ``counts(repo, complete, total, patterns, debt, validated)``."""
    share = F.when(F.col("total") == 0, 0.5).otherwise(F.col("complete") / F.col("total"))
    score = F.least(share * 3 + F.when(F.col("patterns") > 0, 2.5).otherwise(0.0) + 2.0 + F.when(F.col("validated"), 1.5).otherwise(0.5) + F.when(F.col("debt") > 0, 1.0).otherwise(0.5), F.lit(10.0))
    return counts.select(
        "repo", r6(share).alias("completion"), r6(score).alias("context_score"), bucket(share, STAGES, FIRST_STAGE).alias("stage"),
        bucket(score / 10, [(0.8, "excellent"), (0.6, "good")], "low").alias("grade"), bucket(score / 10, [(0.9, "HIGH"), (0.7, "MEDIUM")], "LOW").alias("confidence_level"),
    )
