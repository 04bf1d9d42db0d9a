"""Counts along several single dimensions in one grouping-sets pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, key: str, dimensions: dict[str, str], total: bool = False) -> DataFrame:
    """``(key, dimension, label, n)`` for each named dimension column.

    The aggregate combines on the map side, so a key holding most of the rows
    shuffles only its few counts.
    """
    cols = list(dimensions.values())
    sets = ([[key]] if total else []) + [[key, c] for c in cols]
    counted = df.select(key, *cols).groupingSets(sets, key, *cols).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in cols]
    )
    dim, label, known = F.lit("total"), F.lit("all"), F.lit(True)
    for name, c in dimensions.items():
        on = F.col(f"g_{c}") == 0
        dim = F.when(on, name).otherwise(dim)
        label = F.when(on, F.col(c)).otherwise(label)
        known = F.when(on, F.col(c).isNotNull()).otherwise(known)
    return counted.where(known).select(key, dim.alias("dimension"), label.alias("label"), "n")
