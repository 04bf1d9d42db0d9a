"""Mixing sources to target weights by hash-threshold histograms.

Each row has a fixed 60-bit hash of its key. Sizes are summed by source and
leading hash bits; the budget of a source falls into one bucket of that
histogram, and only that bucket is looked at again with the next bits, until
the threshold is a single hash. A row is taken once more if its hash lies under
the threshold: no sort, no sampling, the same rows on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.ranking import running_number
from repograin.llm.store import WHITE, hinted, saved

WEIGHTS = (1, 2, 3)  # by the order of the sources' names, repeating
MOST = 3  # times a row is taken at most
HASH_BITS = 60
LEVEL_BITS = 12  # 4,096 buckets per source and level
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, w: n + (w != "").cast("long"))


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources share the total by weight; none gets more than ``MOST`` times its
    size, and what is over is shared again by weight among the rest. Only two
    sums come to the driver in each round.
    """
    ranked = running_number(sizes, [], [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    ranked = saved(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    full = F.col("source_size") * MOST
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, budget, weights = F.lit(False), total, ranked.agg(F.sum("weight")).first()[0] or 1
    known = 0
    while True:
        capped = full.cast("double") <= F.col("weight") * F.lit(budget).cast("double") / F.lit(weights)
        n, spent, left = ranked.agg(F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, full)), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == known or not left:
            break
        known, budget, weights = n, total - spent, left
    share = (F.col("weight") * F.lit(budget)).cast("double") / F.lit(weights).cast("double")
    return ranked.withColumn("target", F.when(capped, full.cast("double")).otherwise(share))


@dataclass
class Mix:
    """Targets and thresholds by source."""

    sources: DataFrame
    count: int

    def apply(self, df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
        """``df`` with ``source_size, target, copies``; the rows keep their places.

        Columns of ``df`` with one of these three names are replaced; all others pass, whatever their names.
        """
        rest = [F.col(f"`{c}`") for c in df.columns if c not in ("source_size", "target", "copies")]
        packed = df.select(key_hash(F.col(key)).alias("u"), F.col(source).alias("own"), F.struct(*rest).alias("row"))
        joined = packed.join(hinted(self.sources, self.count, BROADCAST_SOURCES), F.col("own").eqNullSafe(F.col("source")), "left")
        under = (F.col("u") < F.col("threshold")) | ((F.col("u") == F.col("threshold")) & F.col("closed"))
        return joined.select("row.*", "source_size", "target", (F.col("rounds") + F.coalesce(under, F.lit(False)).cast("long")).alias("copies"))


def _narrow(rows: DataFrame, states: DataFrame, count: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Rows of each source's open bucket, and the bucket of the next level in which its budget runs out."""
    behind = HASH_BITS - LEVEL_BITS * level
    inside = rows.join(hinted(states.select(F.col("source").alias("_s"), "prefix"), count, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("u", behind) == F.col("prefix"))).drop("_s", "prefix")
    if level:
        inside = saved(inside, "boundary")
    sums = inside.groupBy("source", F.shiftright("u", behind - LEVEL_BITS).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("u").alias("low"), F.max("u").alias("high"))
    up_to = Window.partitionBy("source").orderBy("bucket")  # at most 2 ** LEVEL_BITS rows
    runs = sums.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    here = runs.join(states.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s"))).where("before <= left and before + words > left")
    return inside, saved(here.select("source", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "words", "low", "high"), "states")


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[Mix, DataFrame]:
    """The mix of all rows, and the saved ``key, source, size, u`` it was made from.

    A source of null is a source of its own, the last. Rows of one key stand or
    fall together, so repeated keys only make a target's approximation coarser.
    An empty table, or one without words, takes nothing.
    """
    rows = saved(df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("u")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = saved(targets.withColumn("rounds", rounds), "targets")
    count = targets.count()
    states = targets.where("source_size > 0").select("source", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("rounds") * F.col("source_size")).alias("left")).where("left > 0")
    settled, open_rows = None, rows
    for level in range(HASH_BITS // LEVEL_BITS):
        open_rows, found = _narrow(open_rows, states, count, level)
        done = found.where("low = high").select("source", F.col("low").alias("threshold"), (F.col("left") * 2 > F.col("words")).alias("closed"))
        settled = done if settled is None else settled.unionByName(done)
        states = found.where("low < high").select("source", "prefix", "left")
        if states.isEmpty():
            break
    thresholds = saved(settled, "thresholds").withColumnRenamed("source", "_s")
    sources = targets.join(thresholds, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return Mix(saved(sources, "mix"), count), rows
