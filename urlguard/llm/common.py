"""Helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.session import configure, new_folder

# White space as Unicode's White_Space property has it, for Python patterns.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole given table."""
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """SQL settings for the jobs run inside."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared work folder and reads it back, which cuts its lineage.

    The shuffle files of the write go with it, so a job's disk is that of its largest step.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    with settings(spark, {CLEANUP: "true"}):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that needs no Python worker to make."""
    kinds = [field.split() for field in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
    items = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*items)).alias("row")).select("row.*")


def private(*names: str) -> list[str]:
    """Column names that cannot clash with the caller's."""
    mark = uuid.uuid4().hex[:8]
    return [f"_{name}_{mark}" for name in names]


def others(frame: DataFrame, *added: str) -> list[str]:
    """The columns that stay beside added ones: an added column replaces one of the same name."""
    return [c for c in frame.columns if c.lower() not in {a.lower() for a in added}]


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of neighbouring texts of about this many characters: (start, end)."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


@functools.cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Gives free memory back to the system: Python workers wait for their next task beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def text_slices(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column without nulls in runs of about this many bytes: (first row, texts)."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, column.slice(start, end - start).to_pylist()
        start, before = end, int(ends[end - 1])
    let_go()
