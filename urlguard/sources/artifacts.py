"""Tables and documents the jobs write and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.operators import prep
from urlguard.operators.telemetry import audit_rows

# --- fixed values: schema of the scan log ----------------------------------------------
SCAN_SCHEMA = """
scan_day DATE, url STRING, verdict STRING, risk_score DOUBLE, is_trusted BOOLEAN,
ml_bypassed BOOLEAN, calibrated_probability DOUBLE, features ARRAY<INT>,
failures STRUCT<http_failed: BOOLEAN, whois_failed: BOOLEAN, dns_failed: BOOLEAN>,
explanation STRUCT<summary: STRING, positive: ARRAY<STRING>, risk: ARRAY<STRING>,
  inconclusive: ARRAY<STRING>, analysis_complete: BOOLEAN, allowlist_override: BOOLEAN>,
warnings ARRAY<STRING>"""
METRICS_SCHEMA = """
calibration_status STRING, brier_score DOUBLE, calibration_error DOUBLE,
reliability_curve STRUCT<bins: ARRAY<DOUBLE>, observed_frequency: ARRAY<DOUBLE>, expected_confidence: ARRAY<DOUBLE>,
  samples_per_bin: ARRAY<BIGINT>>,
timestamp STRING, model_version STRING, sample_count BIGINT,
thresholds STRUCT<brier_score_healthy_max: DOUBLE, brier_score_degraded_max: DOUBLE, calibration_error_healthy_max: DOUBLE,
  calibration_error_degraded_max: DOUBLE, collapse_variance_threshold: DOUBLE>,
warnings ARRAY<STRING>"""
TELEMETRY_SCHEMA = """
total_scans BIGINT, scans_by_verdict MAP<STRING, BIGINT>, scans_with_complete_analysis BIGINT,
scans_with_incomplete_analysis BIGINT, scans_with_allowlist_override BIGINT, scans_without_allowlist_override BIGINT,
scans_by_drift_status MAP<STRING, BIGINT>, total_risk_signals BIGINT, total_positive_signals BIGINT,
total_inconclusive_signals BIGINT, collection_start STRING, last_updated STRING,
top_risk_signals MAP<STRING, BIGINT>, top_inconclusive_checks MAP<STRING, BIGINT>"""


def write_features(df: DataFrame, path: str) -> None:
    """Feature cache, one folder per split. Rows of a split go to many files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The cached features; naming a split reads its folder only."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def write_merged(df: DataFrame, path: str) -> None:
    """Merged data set as CSV (url, label, source)."""
    df.select("url", "label", "source").write.mode("overwrite").option("header", True).csv(path)


def dataset_stats(raw: DataFrame, deduped: DataFrame, balanced: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (metric, n): per source, dedup, conflicts, classes and splits."""
    def counts(df: DataFrame, prefix: str, column: str) -> DataFrame:
        name = F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))
        return df.groupBy(name.alias("metric")).agg(F.count("*").alias("n"))

    dedup = prep.dedup_stats(raw)
    return (
        counts(raw, "source", "source")
        .unionByName(dedup.unpivot([], dedup.columns, "metric", "n"))
        .unionByName(counts(deduped, "before", "label"))
        .unionByName(counts(balanced, "after", "label"))
        .unionByName(counts(parts, "split", "split"))
    )


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics record (calibration or telemetry) as JSON, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_metrics(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """A record as written; a missing or broken file gives one with status ``unknown`` and nothing else."""
    fields = spark.createDataFrame([], schema).schema.fields
    try:
        rows = spark.read.schema(schema).json(path).dropna("all")
        if not rows.isEmpty():
            return rows
    except AnalysisException:
        pass
    return spark.range(1).select(
        *[F.lit("unknown" if f.name == "calibration_status" else None).cast(f.dataType).alias(f.name) for f in fields]
    )


def append_verdict_audit(scans: DataFrame, path: str) -> None:
    """Appends one JSON line per scan, in one folder per day."""
    audit_rows(scans).write.mode("append").partitionBy("day").text(path)


def write_scan_log(results: DataFrame, path: str) -> None:
    """Appends scan results, one folder per day."""
    names = [f.name for f in results.sparkSession.createDataFrame([], SCAN_SCHEMA).schema.fields]
    results.select(*names).write.mode("append").partitionBy("scan_day").parquet(path)


def read_scan_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_SCHEMA).parquet(path)
