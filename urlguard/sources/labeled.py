"""Labelled URL files and pre-extracted feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard import fixed_values as fv


def first_column(names: list[str], candidates, purpose: str) -> str:
    """The first candidate that the file has; an error when it has none."""
    for candidate in candidates:
        if candidate in names:
            return candidate
    raise ValueError(f"no {purpose} column among {names}; looked for {list(candidates)}")


def file_position() -> Column:
    """Orderable position of a row: file, block, then row inside the block.

    A block is read by one task in order, so the position does not depend on how the
    files are packed into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _read(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def read_labeled_urls(
    spark: SparkSession,
    path: str,
    source: str,
    url_candidates=fv.URL_COLUMNS,
    label_candidates=fv.LABEL_COLUMNS,
    encoding: str | None = None,
) -> DataFrame:
    """(url, label_text, source, row_no) from a CSV with a header; all text.

    Without an encoding, values that are valid UTF-8 are read as that and others as latin-1,
    each value for itself and in one read.
    """
    rows = _read(spark, path, encoding or "ISO-8859-1")
    if encoding is None:  # a byte order mark, as latin-1 shows it
        rows = rows.withColumnsRenamed({c: c.removeprefix("\u00ef\u00bb\u00bf") for c in rows.columns})

    def text(name: str) -> Column:
        value = F.col(f"`{name}`")
        if encoding is not None:
            return value
        return F.coalesce(F.try_validate_utf8(F.encode(value, "ISO-8859-1").cast("string")), value)

    url = first_column(rows.columns, url_candidates, "URL")
    label = first_column(rows.columns, label_candidates, "label")
    return rows.select(
        text(url).alias("url"),
        text(label).alias("label_text"),
        F.lit(source).alias("source"),
        file_position().alias("row_no"),
    )


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature file under the older column names; failure columns are 0, no index."""
    rows = spark.read.option("header", True).csv(path)
    known = {old: new for old, new in fv.CSV_COLUMNS.items() if old in rows.columns}
    return (
        rows.select(
            *[F.col(f"`{old}`").cast("int").alias(new) for old, new in known.items()],
            *[F.col(f"`{c}`") for c in rows.columns if c not in known and c != "Index"],
        )
        .withColumns({name: F.lit(0) for name in fv.FAILURE_NAMES})
    )
