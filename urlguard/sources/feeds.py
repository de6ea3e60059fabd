"""URL feeds: line lists, CSV feeds, ranked domain lists, and their union."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.functions.urls import normalize_url, strip


def read_url_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Line-oriented feed: blank and ``#`` lines skipped, normalised, distinct."""
    line = strip(F.col("value"))
    return (
        spark.read.text(path)
        .filter((line != "") & ~F.startswith(line, F.lit("#")))
        .select(normalize_url(line).alias("url"), F.lit(source).alias("source"))
        .distinct()
    )


def read_csv_feed(spark: SparkSession, path: str, source: str, url_column: int = 1) -> DataFrame:
    """CSV feed with a header; the URL stands in one column and starts with ``http``."""
    rows = spark.read.option("header", True).option("quote", '"').csv(path)
    url = strip(F.col(f"`{rows.columns[url_column]}`"))
    return (
        rows.filter(F.startswith(url, F.lit("http")))
        .select(normalize_url(url).alias("url"), F.lit(source).alias("source"))
        .distinct()
    )


def read_ranked_domains(spark: SparkSession, path: str, n: int) -> DataFrame:
    """URLs of the first ``n`` domains of a ``rank,domain`` list."""
    rows = spark.read.schema("rank INT, domain STRING").csv(path)
    return rows.filter((F.col("rank") <= n) & F.col("domain").isNotNull()).select(
        "rank", F.concat(F.lit("https://"), F.col("domain")).alias("url")
    )


@dataclass(frozen=True)
class Feed:
    """One blocklist source: kind is ``url_list`` or ``csv``."""

    name: str
    path: str
    kind: str = "url_list"
    url_column: int = 1


def load_blocklist(spark: SparkSession, feeds: list[Feed]) -> tuple[DataFrame, DataFrame]:
    """(blocklist, counts). A feed whose path cannot be read contributes 0 rows."""
    frames = []
    for feed in feeds:
        try:
            if feed.kind == "csv":
                frames.append(read_csv_feed(spark, feed.path, feed.name, feed.url_column))
            else:
                frames.append(read_url_feed(spark, feed.path, feed.name))
        except AnalysisException:
            continue
    empty = spark.createDataFrame([], "url string, source string")
    blocklist = reduce(DataFrame.unionByName, frames, empty)
    names = spark.createDataFrame([(f.name,) for f in feeds], "source string")
    counted = blocklist.groupBy("source").agg(F.count("*").alias("n"))
    counts = names.join(counted, "source", "left").fillna(0, ["n"])
    return blocklist, counts
