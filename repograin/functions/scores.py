"""Score arithmetic shared by all operators.

Weights are summed as whole hundredths or thousandths and divided once, so a
sum does not depend on the order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Six decimals, halves up, with plain double arithmetic."""
    return F.floor(value * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def bucket(value: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """First step whose lower bound the value reaches."""
    out = None
    for bound, label in steps:
        test = value >= F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def ratio(num: Column, den: Column, if_zero: float) -> Column:
    return F.when(den == 0, F.lit(if_zero)).otherwise(num / den)
