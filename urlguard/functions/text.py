"""Numbers as text, rounded the way the reports round: exactly, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """A non-negative double with one decimal, from its exact binary value.

    Twenty times x is summed as 16x + 4x, both exact, and the rounding error of the sum
    tells on which side of a tie x lies.
    """
    a, b = x * 16, x * 4
    twenty = a + b
    back = twenty - a
    error = (a - (twenty - back)) + (b - back)
    tie = (twenty == F.floor(twenty)) & (F.pmod(twenty, F.lit(2.0)) == 1)
    below = (twenty - 1) / 2
    up = F.when(error > 0, 1).when(error < 0, 0).otherwise(F.pmod(below, F.lit(2.0)))
    return F.format_string("%.1f", F.when(tie, below + up).otherwise(F.rint(x * 10)) / 10)


def percent(share: Column) -> Column:
    return F.concat(one_decimal(share * 100), F.lit("%"))
