"""Running numbers and next values that do not gather a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.session import cut_lineage


def _ranged(df: DataFrame, keys: list[str], order: list[Column | str]) -> tuple[DataFrame, list[str]]:
    """The rows range-partitioned by key and order, with ``_part``; the saved copy fixes the partition ids."""
    ordered = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    cols = [f"_o{i}" for i in range(len(order))]
    return cut_lineage(ordered.repartitionByRange(*keys, *cols).withColumn("_part", F.spark_partition_id())), cols


def next_value(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """``value`` of the key's next row by ``order`` (which must be unique), null for the last one.

    As in :func:`running_number` a hot key spreads over the partitions of a
    range; the last row of each looks up the first value of the key's next
    partition, so only one row per key and partition crosses.
    """
    ranged, cols = _ranged(df, keys, order)
    firsts = ranged.groupBy(*keys, "_part").agg(F.min(F.struct(*cols, F.col(value).alias("_v"))).alias("_f"))
    along = Window.partitionBy(*keys).orderBy("_part")  # one row per partition
    following = firsts.select(*keys, "_part", F.lead("_f").over(along).alias("_next"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*cols)
    marked = ranged.withColumn("_lead", F.lead(F.struct(F.col(value).alias("_v"))).over(inside))
    found = F.when(F.col("_lead").isNotNull(), F.col("_lead._v")).otherwise(F.col("_next._v"))
    return marked.join(following, [*keys, "_part"]).withColumn(name, found).drop("_part", "_lead", "_next", *cols)


def running_number(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """1-based position of each row inside its key, by ``order`` (which must be unique).

    Rows are range-partitioned by key and order, so a hot key spreads over many
    partitions; each partition numbers its own rows and adds the count of the
    key's rows in earlier partitions. The saved copy fixes the partition ids.
    """
    ranged, cols = _ranged(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*keys, "_part", "_offset")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*cols)
    return (
        ranged.join(offsets, [*keys, "_part"])
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_part", "_offset", *cols)
    )


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], size: str, name: str) -> DataFrame:
    """Sum of ``size`` over the key's rows before each row, by ``order`` (which must be unique); spread as in :func:`running_number`."""
    ranged, cols = _ranged(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part").agg(F.sum(size).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*keys, "_part", "_offset")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, [*keys, "_part"])
        .withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_part", "_offset", *cols)
    )
