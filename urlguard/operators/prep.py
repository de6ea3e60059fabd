"""Training-set preparation: merge, dedup, balance, sample, split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlguard import fixed_values as fv
from urlguard.functions.urls import normalize_label, strip, valid_rows, with_canonical
from urlguard.operators.ranking import hash_rank, seeded_hash
from urlguard.operators.timelines import in_slices

SEED = 42
MAX_SHARE = 0.65


def prepare(df: DataFrame, polarity: str = "default") -> DataFrame:
    """Rows (url, label_text, ...) with normalised label, lower-case URL, canonical URL."""
    rows = df.withColumns(
        {
            "url": strip(F.col("url").cast("string")),
            "label": normalize_label(F.col("label_text"), polarity),
        }
    )
    lowered = valid_rows(rows).drop("label_text").withColumn("url", F.lower("url"))
    return with_canonical(lowered)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources as one table. ``ord`` orders rows by source, then by row number."""
    ranked = [
        f.withColumn("ord", F.struct(F.lit(rank).alias("source_rank"), F.col("row_no")))
        for rank, f in enumerate(frames)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def dedup(df: DataFrame) -> DataFrame:
    """One row per canonical URL: the first row's URL and source; conflicts are phishing.

    Partial aggregation on the map side reduces a URL with many copies before the
    shuffle.
    """
    first = F.min_by(F.struct("url", "source"), F.col("ord"))
    return (
        df.groupBy("canonical_url")
        .agg(first.alias("_first"), F.max("label").alias("label"))
        .select("canonical_url", "_first.url", "_first.source", "label")
    )


def dedup_stats(df: DataFrame) -> DataFrame:
    """One row: rows before, duplicates removed, conflicting URLs."""
    per_url = df.groupBy("canonical_url").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return per_url.agg(
        F.sum("n").alias("total_before_dedup"),
        (F.sum("n") - F.count("*")).alias("duplicates_removed"),
        F.count_if(F.col("low") != F.col("high")).alias("conflicts_resolved"),
    )


def merge_keep_last(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Both tables; of rows with one URL the last stays, new rows after old ones.

    Without a URL column on both sides nothing is removed.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    if "url" not in old.columns or "url" not in new.columns:
        return both.drop("_side")
    names = [c for c in both.columns if c not in ("url", "_side")]
    last = F.max_by(F.struct(*names), F.struct("_side", order))
    return both.groupBy("url").agg(last.alias("_row")).select("url", "_row.*")


def class_counts(df: DataFrame) -> dict:
    """Rows per label; a handful of values."""
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def balance_quota(counts: dict, max_share: float = MAX_SHARE) -> dict:
    """Rows to keep per label so that the majority share is about ``max_share``."""
    if len(counts) < 2:
        raise ValueError("class balancing needs two classes")
    majority = max(counts, key=lambda label: (counts[label], -label))
    if counts[majority] / sum(counts.values()) <= max_share:
        return dict(counts)
    minority_rows = min(counts.values())
    return {**counts, majority: int(minority_rows * (max_share / (1 - max_share)))}


def keep_quota(df: DataFrame, quota: dict, seed: int, key: str) -> DataFrame:
    """The first ``quota[label]`` rows of each label in hash order."""
    ranked = hash_rank(df, key, seed, ["label"])
    allowed = F.lit(False)
    for label, rows in quota.items():
        allowed = allowed | ((F.col("label") == label) & (F.col("rank") <= rows))
    return ranked.filter(allowed).drop("rank", "stratum_rows")


def balance(
    df: DataFrame, max_share: float = MAX_SHARE, seed: int = SEED, key: str = "canonical_url"
) -> DataFrame:
    """Downsamples the majority class; never oversamples."""
    counts = class_counts(df)
    quota = balance_quota(counts, max_share)
    return df if quota == counts else keep_quota(df, quota, seed, key)


def balance_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per label before and after balancing, and rows removed."""
    left = before.groupBy("label").agg(F.count("*").alias("before"))
    right = after.groupBy("label").agg(F.count("*").alias("after"))
    return left.join(right, "label", "left").select(
        "label", "before", F.coalesce("after", F.lit(0)).alias("after"),
        (F.col("before") - F.coalesce("after", F.lit(0))).alias("downsampled"),
    )


def sample_quota(counts: dict, n: int) -> dict:
    """Largest-remainder share of ``n`` rows per label."""
    total = sum(counts.values())
    quota = {label: n * rows // total for label, rows in counts.items()}
    rest = sorted(counts, key=lambda label: (-(n * counts[label] % total), label))
    for label in rest[: n - sum(quota.values())]:
        quota[label] += 1
    return quota


def stratified_sample(
    df: DataFrame, n: int, seed: int = SEED, key: str = "canonical_url"
) -> DataFrame:
    """Exactly ``n`` rows with the label shares kept; all rows when there are no more."""
    counts = class_counts(df)
    if n >= sum(counts.values()):
        return df
    return keep_quota(df, sample_quota(counts, n), seed, key)


def shuffle(df: DataFrame, seed: int = SEED, key: str = "canonical_url") -> DataFrame:
    """Rows in a fixed random order: a range-partitioned sort by hash."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key)


def positions(df: DataFrame, seed: int = SEED, key: str = "canonical_url") -> DataFrame:
    """Adds ``position``, 1..n in the shuffled order.

    The ranges of that order are written once; a row's place is that of its range, from the
    ranges' sizes, plus its place inside it.
    """
    order = ["_hash", key]
    ranged = in_slices(df.withColumn("_hash", seeded_hash(seed, F.col(key))), *order)
    sizes = ranged.groupBy("_slice").agg(F.count("*").alias("_n"))
    # One row for each range partition.
    upto = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    placed = ranged.join(F.broadcast(upto), "_slice").withColumn("position", F.col("_before") + inside)
    return placed.select(*df.columns, "position")


def split(
    df: DataFrame,
    percents: dict[str, int] | None = None,
    seed: int = SEED,
    key: str = "canonical_url",
) -> DataFrame:
    """Adds ``split``: exact percentages of each label, the same on every run."""
    percents = percents or {"train": 70, "val": 15, "test": 15}
    ranked = hash_rank(df, key, seed, ["label"])
    names = list(percents)
    upper, ladder = 0, F.when(F.lit(False), "")
    for name in names[:-1]:
        upper += percents[name]
        ladder = ladder.when(F.col("rank") * 100 <= F.col("stratum_rows") * upper, name)
    return ranked.withColumn("split", ladder.otherwise(names[-1])).drop("rank", "stratum_rows")


def leakage(df: DataFrame) -> DataFrame:
    """URLs shared by each pair of splits; one shuffle for the three pairs."""
    def seen(name: str):
        return F.max((F.col("split") == name).cast("int"))

    per_url = df.groupBy("canonical_url").agg(
        seen("train").alias("train"), seen("val").alias("val"), seen("test").alias("test")
    )
    pairs = {"train_val": "train * val", "train_test": "train * test", "val_test": "val * test"}
    return per_url.agg(
        *[F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(n) for n, e in pairs.items()]
    ).unpivot([], list(pairs), "pair", "overlap")


def require_no_leakage(df: DataFrame) -> DataFrame:
    """The frame itself, or an error when a URL is in two splits."""
    bad = leakage(df).filter("overlap > 0").collect()
    if bad:
        raise ValueError(f"splits share URLs: {[(r['pair'], r['overlap']) for r in bad]}")
    return df


def label_feeds(phishing: DataFrame, legitimate: DataFrame) -> DataFrame:
    """A phishing feed (-1) and a ranked list of legitimate URLs (1) as one table."""
    return phishing.select("url", F.lit(-1).alias("label")).unionByName(
        legitimate.select("url", F.lit(1).alias("label"))
    )


def fill_schema(df: DataFrame, names: tuple[str, ...] = fv.VECTOR_NAMES) -> DataFrame:
    """All named columns as integers; missing ones and nulls become 0."""
    empty = df.sparkSession.createDataFrame(
        [], T.StructType([T.StructField(n, T.IntegerType()) for n in names])
    )
    return df.unionByName(empty, allowMissingColumns=True).fillna(0, list(names))


def extraction_report(features: DataFrame) -> DataFrame:
    """One row: URLs extracted, URLs with a failed look-up, success rate."""
    failed = F.col("http_failed") | F.col("whois_failed") | F.col("dns_failed")
    return features.agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("failed"),
        F.avg((~failed).cast("double")).alias("success_rate"),
    )


def failed_urls(features: DataFrame) -> DataFrame:
    """The rows with a failed look-up, and ``failed``: which of http, whois, dns."""
    parts = [F.when(F.col(f"{name}_failed"), F.lit(name)) for name in ("http", "whois", "dns")]
    return features.withColumn("failed", F.array_compact(F.array(*parts))).filter(F.size("failed") > 0)


def head_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows of a feed: the row limit is the feature."""
    return df.orderBy(order).limit(n)
