"""Calibration monitoring over predictions (y_true 1 = phishing, y_prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.text import percent


def squared_error() -> Column:
    return F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(squared_error()).alias("brier_score"))


def edges(n: int) -> list[float]:
    """Bin edges as multiples of the bin width, the doubles a linear spacing gives."""
    return [k * (1 / n) for k in range(n)] + [1.0]


def bin_of(p: Column, n: int) -> Column:
    """Bin number by comparison with the edges; the last bin is closed on the right."""
    ladder = F.when((p < 0) | (p > 1), None)
    for k, upper in enumerate(edges(n)[1:-1]):
        ladder = ladder.when(p < upper, k)
    return ladder.when(p <= 1, n - 1)


def reliability(df: DataFrame, n: int = fv.RELIABILITY_BINS) -> DataFrame:
    """n rows: bin, upper edge, observed frequency, expected confidence, samples.

    An empty bin has observed 0 and expects its mid-point.
    """
    bounds = edges(n)
    bins = F.array(
        *[
            F.struct(
                F.lit(k).alias("bin"),
                F.lit(bounds[k + 1]).alias("upper"),
                F.lit((bounds[k] + bounds[k + 1]) / 2).alias("middle"),
            )
            for k in range(n)
        ]
    )
    counted = df.groupBy(bin_of(F.col("y_prob"), n).alias("bin")).agg(
        F.avg("y_true").alias("observed"),
        F.avg("y_prob").alias("expected"),
        F.count("*").alias("samples"),
    )
    grid = df.sparkSession.range(1).select(F.explode(bins).alias("b")).select("b.*")
    return grid.join(counted, "bin", "left").select(
        "bin", "upper",
        F.coalesce("observed", F.lit(0.0)).alias("observed"),
        F.coalesce("expected", "middle").alias("expected"),
        F.coalesce("samples", F.lit(0)).alias("samples"),
    )


def ece(curve: DataFrame) -> DataFrame:
    """Mean absolute gap of the reliability curve, weighted by samples."""
    gap = F.col("samples") * F.abs(F.col("observed") - F.col("expected"))
    total = F.sum("samples")
    return curve.agg(
        F.when(total > 0, F.sum(gap) / total).otherwise(0.0).alias("calibration_error")
    )


def is_extreme(p: Column) -> Column:
    return (p < fv.EXTREME_LOW) | (p > fv.EXTREME_HIGH)


def health(variance: Column, extreme: Column, score: Column, error: Column) -> Column:
    """healthy or degraded; the first broken limit decides."""
    return (
        F.when(variance < fv.COLLAPSE_VARIANCE, "degraded")
        .when(extreme > fv.EXTREME_SHARE, "degraded")
        .when(score > fv.BRIER_DEGRADED_MAX, "degraded")
        .when(error > fv.ERROR_DEGRADED_MAX, "degraded")
        .otherwise("healthy")
    )


def health_warnings(variance: Column, extreme: Column, score: Column, error: Column) -> Column:
    """Messages up to the limit that decided."""
    collapsed = variance < fv.COLLAPSE_VARIANCE
    extremes = ~collapsed & (extreme > fv.EXTREME_SHARE)
    scored = ~collapsed & ~extremes
    bad_score = scored & (score > fv.BRIER_DEGRADED_MAX)
    high_score = scored & ~bad_score & (score > fv.BRIER_HEALTHY_MAX)
    bad_error = scored & ~bad_score & (error > fv.ERROR_DEGRADED_MAX)
    high_error = scored & ~bad_score & ~bad_error & (error > fv.ERROR_HEALTHY_MAX)
    tolerated = (high_score & ~bad_error) | high_error

    def text(pattern: str, *values) -> Column:
        return F.format_string(pattern, *values)

    return F.array_compact(
        F.array(
            F.when(collapsed, text("Probability collapse detected: variance=%.4f", variance)),
            F.when(
                extremes,
                text("Extreme probability concentration: %s at extremes", percent(extreme)),
            ),
            F.when(
                bad_score,
                text(f"Brier score critically high: %.4f > {fv.BRIER_DEGRADED_MAX}", score),
            ),
            F.when(
                high_score, text(f"Brier score elevated: %.4f > {fv.BRIER_HEALTHY_MAX}", score)
            ),
            F.when(bad_error, text("Calibration error critically high: %.4f", error)),
            F.when(high_error, text("Calibration error elevated: %.4f", error)),
            F.when(
                tolerated, F.lit("Calibration metrics are elevated but within acceptable range")
            ),
        )
    )


def calibration_status(df: DataFrame) -> DataFrame:
    """One row: status, Brier score, error, variance, extreme share, samples, warnings.

    Without samples the status is ``unknown``. Everything comes from one pass: per-bin
    partial sums give the totals too.
    """
    p, y = F.col("y_prob"), F.col("y_true")
    per_bin = df.groupBy(bin_of(p, fv.RELIABILITY_BINS).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum("y_true").alias("sy"),
        F.sum("y_prob").alias("sp"),
        F.sum(p * p).alias("spp"),
        F.sum(squared_error()).alias("se"),
        F.count_if(is_extreme(p)).alias("extreme"),
    )
    n = F.sum("n")
    binned = F.col("bin").isNotNull()
    in_bins = F.sum(F.when(binned, F.col("n")).otherwise(0))
    gap = F.sum(F.when(binned, F.abs(F.col("sy") - F.col("sp"))).otherwise(0.0))
    totals = per_bin.agg(
        F.coalesce(n, F.lit(0)).alias("sample_count"),
        (F.sum("se") / n).alias("brier_score"),
        F.when(in_bins > 0, gap / in_bins).otherwise(0.0).alias("calibration_error"),
        (F.sum("spp") / n - F.pow(F.sum("sp") / n, F.lit(2.0))).alias("variance"),
        (F.sum("extreme") / n).alias("extreme_share"),
    )
    limits = [F.col(c) for c in ("variance", "extreme_share", "brier_score", "calibration_error")]
    empty = F.col("sample_count") == 0
    return totals.withColumns(
        {
            "calibration_status": F.when(empty, "unknown").otherwise(health(*limits)),
            "warnings": F.when(
                empty, F.array(F.lit("No samples provided for calibration"))
            ).otherwise(health_warnings(*limits)),
        }
    )


# --- fixed values: names under which a record keeps the thresholds it was judged by ----------
THRESHOLDS = {
    "brier_score_healthy_max": fv.BRIER_HEALTHY_MAX,
    "brier_score_degraded_max": fv.BRIER_DEGRADED_MAX,
    "calibration_error_healthy_max": fv.ERROR_HEALTHY_MAX,
    "calibration_error_degraded_max": fv.ERROR_DEGRADED_MAX,
    "collapse_variance_threshold": fv.COLLAPSE_VARIANCE,
}


def calibration_record(df: DataFrame, as_of: str, model_version: str = "") -> DataFrame:
    """The full record of a calibration check, one row: status, curve, time, model, thresholds, warnings."""
    inside = F.array_sort(F.collect_list(F.struct("bin", "upper", "observed", "expected", "samples")))
    names = {"upper": "bins", "observed": "observed_frequency", "expected": "expected_confidence", "samples": "samples_per_bin"}

    curve = reliability(df).agg(inside.alias("c")).select(
        F.struct(*[F.col(f"c.{column}").alias(name) for column, name in names.items()]).alias("curve")
    )
    return calibration_status(df).select(
        "calibration_status", F.round("brier_score", 4).alias("brier_score"), F.round("calibration_error", 4).alias("calibration_error"),
        curve.scalar().alias("reliability_curve"), F.lit(as_of).alias("timestamp"), F.lit(model_version).alias("model_version"),
        "sample_count", F.struct(*[F.lit(v).alias(k) for k, v in THRESHOLDS.items()]).alias("thresholds"), "warnings",
    )


def per_window(df: DataFrame, window: str, slide: str | None = None) -> DataFrame:
    """Rows, population variance and extreme share per time window."""
    return df.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count("*").alias("n"),
        F.var_pop("y_prob").alias("variance"),
        F.avg(is_extreme(F.col("y_prob")).cast("double")).alias("extreme_share"),
    ).select(F.col("w.start").alias("window_start"), "n", "variance", "extreme_share")


def overconfidence(df: DataFrame, window: str) -> DataFrame:
    """Windows of ten or more rows with over 80 % of probabilities at the extremes."""
    return per_window(df, window).select(
        "window_start", "n", "extreme_share",
        ((F.col("n") >= fv.MIN_DRIFT_ROWS) & (F.col("extreme_share") > fv.EXTREME_SHARE)).alias("drift"),
    )


def collapse(df: DataFrame, window: str) -> DataFrame:
    """Windows of ten or more rows whose probabilities hardly vary."""
    return per_window(df, window).select(
        "window_start", "n", "variance",
        ((F.col("n") >= fv.MIN_DRIFT_ROWS) & (F.col("variance") < fv.COLLAPSE_VARIANCE)).alias("collapsed"),
    )


def confidence_penalty(status: Column) -> Column:
    return (
        F.when(status == "healthy", fv.CALIBRATION_PENALTY["healthy"])
        .when(status == "degraded", fv.CALIBRATION_PENALTY["degraded"])
        .otherwise(fv.CALIBRATION_PENALTY["unknown"])
    )


# --- fixed values: recommendations of the report -------------------------------------
DEGRADED_ADVICE = (
    "Consider retraining the model with fresh data",
    "Review feature distribution for drift",
)


def calibration_report(df: DataFrame) -> DataFrame:
    """Status row with the confidence penalty and recommendations."""
    status = F.col("calibration_status")
    none = F.array().cast("array<string>")
    advice = F.when(status == "degraded", F.array(*map(F.lit, DEGRADED_ADVICE))).otherwise(none)
    return calibration_status(df).withColumns(
        {
            "penalty": confidence_penalty(status),
            "recommendations": F.concat(advice, "warnings"),
        }
    )
