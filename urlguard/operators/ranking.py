"""Exact ranks and samples of any size without a one-task window or a driver limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the hash that name a bucket: 16**4 = 65,536 buckets per stratum.
BUCKET_DIGITS = 4


def seeded_hash(seed: int, key: Column) -> Column:
    """Hash that orders rows the same way on every engine and partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_rank(
    df: DataFrame, key: str, seed: int, strata: list[str] | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Adds ``rank``, 1..n in hash order within each stratum, and ``stratum_rows``.

    The hash spreads every stratum over 16**digits buckets. Rows are counted per bucket
    (map-side combined), the counts are summed up in bucket order, and only inside one
    bucket are rows sorted. A stratum with a third of all rows is thus as parallel as
    the rest. ``strata`` must be columns with few values, such as a label. Spark broadcasts
    the bucket table when its measured size allows; otherwise both sides meet by
    (stratum, bucket), which is also the partitioning of the final window.
    """
    strata = strata or []
    keyed = df.withColumn("_hash", seeded_hash(seed, F.col(key))).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*strata)
    offsets = counts.select(
        *strata, "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("stratum_rows"),
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    return (
        keyed.join(offsets, [*strata, "_bucket"])
        .withColumn("rank", F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset")
        .select(*df.columns, "rank", "stratum_rows")
    )
