"""Look-up tables prepared once and kept up, for scans of many small batches.

A crawl is parsed and grouped when it arrives, not with every batch of URLs that asks for a page.
The prepared rows lie in the work folder by bucket of their key; an update rewrites the buckets that
its keys fall into and leaves the others where they are.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.functions import features as fx
from urlguard.plans.scan import Tables
from urlguard.session import new_folder

BUCKETS = 64


class KeyedTable:
    """One row for each key, in buckets; each bucket is in the folder of the update that wrote it last."""

    def __init__(self, spark: SparkSession, key: str, name: str, buckets: int = BUCKETS):
        self.spark, self.key, self.name, self.buckets = spark, key, name, buckets
        self.folders: dict[int, str] = {}  # bucket -> folder: as many entries as there are buckets
        self.schema = None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; only their files are read."""
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in self.folders.items():
            if buckets is None or bucket in buckets:
                by_folder.setdefault(folder, []).append(bucket)
        frames = [
            self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).filter(F.col("bucket").isin(held)).drop("bucket")
            for folder, held in sorted(by_folder.items())
        ]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.schema)

    def update(self, changes: DataFrame, newest: Column | None = None) -> None:
        """Takes up rows. Of a key's old and new rows the one with the largest ``newest`` counts, or the new one."""
        self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema.fields)
        touched = {r.bucket for r in changes.select(self._bucket().alias("bucket")).distinct().collect()}
        columns = [c for c in changes.columns if c != self.key]
        both = changes.withColumn("_new", F.lit(1)).unionByName(self.rows(touched).withColumn("_new", F.lit(0)))
        order = F.struct(*([newest] if newest is not None else []), F.col("_new"))
        kept = both.groupBy(self.key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(self.key, "row.*")
        folder = new_folder(self.spark, self.name)
        kept.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket").sortWithinPartitions(
            "bucket", self.key
        ).write.partitionBy("bucket").parquet(folder)
        self.folders |= dict.fromkeys(touched, folder)


class StoredLookups:
    """Page features and host facts of a scan's tables, prepared and kept up."""

    def __init__(self, tables: Tables, buckets: int = BUCKETS):
        spark = tables.crawl.sparkSession
        self.tables = tables
        self.pages = KeyedTable(spark, "_page", "stored-pages", buckets)
        self.hosts = KeyedTable(spark, "host", "stored-hosts", buckets)
        self.pages.update(fx.page_table(tables.crawl, tables.every_crawl))
        self.hosts.update(fx.host_facts(tables.whois, tables.dns, tables.certs))

    def crawled(self, crawl: DataFrame) -> None:
        """Takes up newly crawled pages; they replace earlier ones of their URL."""
        self.pages.update(fx.page_table(crawl, self.tables.every_crawl))

    def looked_up(self, whois: DataFrame, dns: DataFrame, certs: DataFrame) -> None:
        """Takes up new records of hosts; they replace all earlier facts of these hosts."""
        self.hosts.update(fx.host_facts(whois, dns, certs))

    def current(self) -> Tables:
        return replace(self.tables, pages=self.pages.rows(), hosts=self.hosts.rows())
