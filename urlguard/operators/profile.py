"""Profiling of feature tables.

Most profiles come from one table of value counts (column, value, rows): it is
aggregated on the map side and stays small however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlguard.operators.timelines import in_slices

# Of a pair of columns: rows, sums, sums of squares and of products.
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, row count."""
    rows = df.agg(F.count("*").alias("rows"))
    fields = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)]
    items = F.array(
        *[
            F.struct(F.lit(k).alias("position"), F.lit(n).alias("name"), F.lit(t).alias("type"))
            for k, n, t in fields
        ]
    )
    return rows.select(F.explode(items).alias("c"), "rows").select("c.*", "rows")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value); nulls are a value."""
    return (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def nunique(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, columns).groupBy("column").agg(F.count("value").alias("nunique"))


# --- fixed value: the quartiles of a description ---------------------------------------
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_t(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; NaN is a value, null is not.

    Mean and spread merge partial means, so large values do not cancel. Quartiles (linear between
    neighbours) are exact order statistics: values with their counts are cut into ranges, the
    counts of the ranges tell which of them hold a wanted rank, and only those are sorted.
    """
    v = F.col("value")
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").filter(v.isNotNull())
    base = known.groupBy("column").agg(
        F.count("*").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    ranged = in_slices(known.groupBy("column", "value").agg(F.count("*").alias("n")), "column", "value")

    # Where each range's ranks begin; a column has at most as many ranges as there are partitions.
    sizes = ranged.groupBy("column", "_slice").agg(F.sum("n").alias("size"))
    everything = Window.partitionBy("column")
    upto = F.sum("size").over(everything.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.select("column", "_slice", "size", (upto - F.col("size")).alias("before"), F.sum("size").over(everything).alias("total"))
    wanted = []
    for name, q in QUARTILES.items():
        position = (F.col("total") - 1) * q
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), rank.alias("rank"), (position - F.floor(position)).alias("part")))
    asked = placed.select("column", "_slice", "before", "size", F.explode(F.array(*wanted)).alias("w"))
    asked = asked.filter((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("size")))
    asked = asked.select("column", "_slice", "w.q", "w.side", "w.part", (F.col("w.rank") - F.col("before")).alias("place"))

    # Only the ranges that hold a wanted rank are sorted.
    holding = ranged.join(F.broadcast(asked.select("column", "_slice").distinct()), ["column", "_slice"])
    inside = Window.partitionBy("column", "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = holding.withColumn("upto", F.sum("n").over(inside))
    met = counted.join(F.broadcast(asked), ["column", "_slice"]).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    ends = met.groupBy("column", "q").agg(
        *[F.max(F.when(F.col("side") == side, v)).alias(side) for side in ("low", "high")], F.max("part").alias("part")
    )
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    quartiles = ends.groupBy("column").agg(*[F.max(F.when(F.col("q") == name, between)).alias(name) for name in QUARTILES])
    return base.join(quartiles, "column").select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair in long form; null for a constant column.

    A pair uses the rows where both are known. Each task gives its sums of products as one row
    for each pair; values are taken from their column's mean, so that large ones do not cancel.
    """
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = known.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] or 0.0 for c in columns])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(columns), len(columns)))
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) - centre
            there = (~np.isnan(values)).astype(float)
            values = np.nan_to_num(values)
            squares = values * values
            total += [there.T @ there, values.T @ there, there.T @ values, squares.T @ there, there.T @ squares, values.T @ values]
        i, j = np.indices(total.shape[1:])
        arrays = [i.ravel(), j.ravel(), *total.reshape(len(SUMS), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["i", "j", *SUMS])

    schema = ", ".join(["i long", "j long", *[f"{s} double" for s in SUMS]])
    sums = known.mapInArrow(products, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    n = F.nullif("n", F.lit(0.0))
    spread_x, spread_y = F.col("xx") - F.col("x") ** 2 / n, F.col("yy") - F.col("y") ** 2 / n
    # Rounding leaves a trace of spread in a constant column.
    varies = (spread_x > F.col("xx") * 1e-14) & (spread_y > F.col("yy") * 1e-14)
    corr = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread_x * spread_y)
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"),
        F.when(varies, corr).alias("corr"),
    )


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def pair_counts(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """Rows per combination of two columns and the class."""
    return df.groupBy(a, b, label).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per column, one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot(
        [], columns, "column", "missing"
    )
