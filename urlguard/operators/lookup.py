"""Joins with look-up tables when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Joins ``rows`` with a ``table`` that has one row per ``key`` (a column or several).

    Spark broadcasts the table when its measured size is below the threshold. Beyond it
    both sides are shuffled, and AQE splits the partition of a hot key on the row side.
    It does so only when each side comes straight from its own exchange. A table that
    was just made distinct on the key would not, so the join is on the key's hash and
    the key: the table gets its own exchange, and the sort compares numbers first.
    """
    keys = [key] if isinstance(key, str) else key
    h = F.xxhash64(*keys)
    joined = rows.withColumn("_h", h).join(table.withColumn("_h", h), ["_h", *keys], how)
    return joined.drop("_h")
