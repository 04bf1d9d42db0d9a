"""Templates, lookups and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.ranking import next_value
from repograin.functions.scores import r6
from repograin.functions.text import lookup
from repograin.registry import operator

# Advice per phase, grade bounds, time targets.
ADVICE = {
    "Framework Detection": "Consider caching framework detection results or implementing parallel processing",
    "AST Analysis": "Enable incremental AST parsing and cache parsed trees",
    "LLM Analysis": "Optimize prompts, use model caching, or reduce context size",
    "Business Context Extraction": "Cache business domain classifications and implement fast-path detection",
}
DEFAULT_ADVICE = "Consider optimization opportunities for this phase"
GRADES = [(10.0, 0.8, "A+"), (5.0, 0.6, "A"), (2.0, 0.4, "B"), (1.0, 0.2, "C")]
TARGETS = [(100, 30), (500, 120)]
LAST_TARGET = 300


def render(template: Column, variables: Column) -> Column:
    """Replace every ``{key}`` that has a value; unknown placeholders stay."""
    return F.aggregate(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


@operator("templates.lookup_default")
def lookup_default(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Row of the key, else the row named ``default``; of several rows of a name the least value counts."""
    least = table.groupBy("key").agg(F.min("value").alias("value"))
    own = least.select(F.col("key").alias(key), F.col("value").alias("own"))
    # One row, so it may be broadcast; rows without a value of their own look it up by name.
    default = least.where("key = 'default'").select(F.col("key").alias("_wanted"), F.col("value").alias("fallback")).limit(1)
    wanted = F.when(F.col("own").isNull(), "default")
    joined = rows.join(own, key, "left").withColumn("_wanted", wanted).join(F.broadcast(default), "_wanted", "left")
    return joined.select(*rows.columns, F.coalesce("own", "fallback").alias("value"))


@operator("metrics.phase_gaps")
def phase_gaps(events: DataFrame) -> DataFrame:
    """(run, phase, started, seconds): time from each event to the phase's next one, of whatever day.

    Events are range-partitioned, so one phase of one day may hold any number.
    """
    gaps = next_value(events.select("run", "phase", "ts", "seq"), ["run", "phase"], ["ts", "seq"], "ts", "ended")
    return gaps.where("ended IS NOT NULL").select(
        "run", "phase", "seq", F.col("ts").alias("started"), (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("ended")) / 1000000.0).alias("seconds")
    )


@operator("metrics.phase_durations")
def phase_durations(gaps: DataFrame) -> DataFrame:
    """The last duration of each phase wins."""
    return gaps.groupBy("run", "phase").agg(F.max_by("seconds", F.struct("started", "seq")).alias("seconds"), F.count("*").alias("times"))


@operator("metrics.bottlenecks")
def bottlenecks(durations: DataFrame) -> DataFrame:
    """Phases above a fifth of their run's total."""
    total = durations.groupBy("run").agg(F.sum("seconds").alias("total"))
    share = F.col("seconds") / F.col("total") * 100
    return durations.join(total, "run").where(share > 20).select("run", "phase", r6(F.col("seconds")).alias("seconds"), r6(share).alias("share"), lookup(F.col("phase"), ADVICE, DEFAULT_ADVICE).alias("advice"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses == 0, 0.0).otherwise(hits / (hits + misses))


def grade(files_per_second: Column, rate: Column) -> Column:
    out = None
    for fps, hr, g in GRADES:
        test = (files_per_second > fps) & (rate > hr)
        out = F.when(test, g) if out is None else out.when(test, g)
    return out.otherwise("D")


def meets_target(files: Column, seconds: Column) -> Column:
    limit = F.when(files < TARGETS[0][0], TARGETS[0][1]).when(files < TARGETS[1][0], TARGETS[1][1]).otherwise(LAST_TARGET)
    return F.floor(seconds) < limit
