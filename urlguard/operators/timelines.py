"""Long timelines in slices: what happens in one depends on what came before, but no task reads it all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlguard.session import new_folder

FANOUT = 256  # slices, or groups of slices, that one window reads


def in_slices(df: DataFrame, *order: str) -> DataFrame:
    """The rows written in order, with ``_slice``: ranges of about equal size, numbered in order.

    Spark's range partitioning samples the order columns, so many rows at one instant are cut by the
    columns that follow.
    """
    path = new_folder(df.sparkSession, "slices")
    ranged = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id().cast("long"))
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def carried_forward(slices: DataFrame, value: str, levels: int = 4) -> DataFrame:
    """(_slice, carried): the last known ``value`` of the slices before each.

    ``slices`` has one row for each slice number. Slices form groups of FANOUT, these groups
    again, and so on, ``levels`` times (enough for 2^32 slices); a window reads one group only.
    """
    node = slices.select(F.col("_slice").alias("_node0"), F.col(value).alias("_value0"))
    tables = [node]
    for level in range(1, levels + 1):
        below = tables[-1]
        parent = F.floor(F.col(f"_node{level - 1}") / FANOUT)
        last = F.max_by(f"_value{level - 1}", F.when(F.col(f"_value{level - 1}").isNotNull(), F.col(f"_node{level - 1}")))
        tables.append(below.groupBy(parent.alias(f"_node{level}")).agg(last.alias(f"_value{level}")))
    top = tables[-1]
    carried = top.select(f"_node{levels}", F.lit(None).cast(slices.schema[value].dataType).alias("carried"))
    for level in range(levels - 1, -1, -1):
        inside = Window.partitionBy(f"_node{level + 1}").orderBy(f"_node{level}").rowsBetween(Window.unboundedPreceding, -1)
        below = tables[level].withColumn(f"_node{level + 1}", F.floor(F.col(f"_node{level}") / FANOUT))
        before = below.withColumn("_before", F.last(f"_value{level}", ignorenulls=True).over(inside))
        carried = before.join(carried, f"_node{level + 1}").select(f"_node{level}", F.coalesce("_before", "carried").alias("carried"))
    return carried.withColumnRenamed("_node0", "_slice")


# ------------------------------------------------------------------ entries that live for a while

# A slice of a key's looks is a function from the time at which the entry that is there ends to the
# number of entries made and the time at which the last one ends. It changes at few places: rows
# (begin, made, end) say that an entry that ends after the row before and up to ``begin`` gives ``made``
# and ``end``. One that ends after all rows outlives the slice's looks.
ENTRIES = "k string, slice long, begin long, made long, end long"
NAMES = [field.split()[0] for field in ENTRIES.split(", ")]


def _merged(begin: np.ndarray, made: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows without those that the next one says as well."""
    if not len(begin):
        return begin, made, end
    keep = np.append((made[1:] != made[:-1]) | (end[1:] != end[:-1]), True)
    return begin[keep], made[keep], end[keep]


def looks_as_function(times: np.ndarray, ttl: int, last_start: int) -> tuple[np.ndarray, ...]:
    """The function of sorted looks. An entry from before the slice ends before ``last_start``."""
    n = len(times)
    if n == 1:
        return times, np.ones(1, np.int64), times + ttl
    follow = np.append(np.searchsorted(times, times + ttl), n)
    made, end = np.append(np.ones(n, np.int64), 0), np.append(times + ttl, 0)
    # Chains of entries, twice as long each round.
    while (follow[:n] < n).any():
        going = np.flatnonzero(follow[:n] < n)
        to = follow[going]
        made[going], end[going], follow[going] = made[going] + made[to], end[to], follow[to]
    starts = min(n, int(np.searchsorted(times, last_start)) + 1)
    return _merged(times[:starts], made[:starts], end[:starts])


def chained(first: tuple[np.ndarray, ...], rest: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One function for neighbouring slices, in order."""
    if not rest:
        return first
    begin, made, end = first
    for k, (other_begin, other_made, other_end) in enumerate(rest):
        # An entry that outlives the first looks meets the first look of the next slice.
        if k == 0 or not len(begin) or other_begin[0] > begin[-1]:
            begin = np.append(begin, other_begin[0])
            made, end = np.append(made, 0), np.append(end, other_begin[0])
        at = np.searchsorted(other_begin, end)
        hit = at < len(other_begin)
        at = np.minimum(at, len(other_begin) - 1)
        made, end = made + np.where(hit, other_made[at], 0), np.where(hit, other_end[at], end)
    return _merged(begin, made, end)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Runs of rows with equal first columns, and their other columns."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            key = tuple(c[start] for c in columns[:keys])
            if key != now and parts:
                yield now, parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
                parts = []
            now = key
            parts.append([c[start:stop] for c in columns[keys:]])
    if parts:
        yield now, [np.concatenate(c) for c in zip(*parts)]


GATHERED = 4_096  # rows of functions handed on at once


def _rows(held: list[tuple[str, int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
    lengths = [len(function[0]) for _, _, function in held]
    keys = pa.array([key for key, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), lengths)))
    pieces = np.repeat(np.array([piece for _, piece, _ in held], np.int64), lengths)
    columns = [np.concatenate(c) for c in zip(*(function for _, _, function in held))]
    return pa.RecordBatch.from_arrays([keys, *map(pa.array, (pieces, *columns))], NAMES)


def _gathered(functions: Iterator[tuple[str, int, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Functions of many slices in one batch: most slices hold a look or two."""
    held, n = [], 0
    for key, piece, function in functions:
        held.append((key, piece, function))
        n += len(function[0])
        if n >= GATHERED:
            yield _rows(held)
            held, n = [], 0
    if held:
        yield _rows(held)


def entries_made(instants: DataFrame, ttl: int, width: int, fanout: int = 32, levels: int = 2) -> DataFrame:
    """One row ``made``: how many looks find no entry and make one that lives ``ttl`` microseconds.

    ``instants(k, t)`` has one row for each key and instant. Slices of ``width`` (at least ``ttl``) become
    functions, ``fanout`` neighbours one function, ``levels`` times over; only the functions that remain
    of a key are read in its order. So a task reads one slice, or ``fanout`` functions, each with at
    most the looks of its first ``ttl``, whatever share of all looks the key has.
    """
    if width < ttl:
        raise ValueError("a slice is at least as long as an entry lives")

    def of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(
            (key, piece, looks_as_function(times, ttl, piece * width + ttl)) for (key, piece), (times,) in runs(batches, 2)
        )

    def grouped_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, tuple[np.ndarray, ...]]]:
        for (key, group), (slices, *function) in runs(batches, 2):
            edges = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
            parts = [tuple(c[a:b] for c in function) for a, b in zip(edges, edges[1:])]
            yield key, group, chained(parts[0], parts[1:])

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(grouped_functions(batches))

    def of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, ends = 0, None, 0
        for (key, _), (begin, count, end) in runs(batches, 2):
            if key != now:
                now, ends = key, np.iinfo(np.int64).min
            at = int(np.searchsorted(begin, ends))
            if at < len(begin):
                made, ends = made + int(count[at]), int(end[at])
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    sliced = instants.select("k", F.floor(F.col("t") / width).alias("slice"), "t")
    functions = sliced.repartition("k", "slice").sortWithinPartitions("k", "slice", "t").mapInArrow(of_slices, ENTRIES)
    for _ in range(levels):
        grouped = functions.select("k", F.floor(F.col("slice") / fanout).alias("group"), "slice", "begin", "made", "end")
        functions = grouped.repartition("k", "group").sortWithinPartitions("k", "group", "slice", "begin").mapInArrow(of_groups, ENTRIES)
    ordered = functions.repartition("k").sortWithinPartitions("k", "slice", "begin")
    return ordered.mapInArrow(of_keys, "made long").agg(F.coalesce(F.sum("made"), F.lit(0)).alias("made"))
