"""From a probability and the gate flags to a three-state verdict with explanation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.features import any_failed


def verdict(p: Column) -> Column:
    return (
        F.when(p >= fv.PHISHING_THRESHOLD, "PHISHING")
        .when(p >= fv.SUSPICIOUS_THRESHOLD, "SUSPICIOUS")
        .when(p.isNotNull(), "SAFE")
    )


def failure_penalty() -> Column:
    """Share of confidence lost to failed look-ups."""
    parts = [
        F.when(F.col(flag), fv.FAILURE_PENALTY * share).otherwise(0.0)
        for flag, share in fv.FAILURE_SHARES.items()
    ]
    return reduce(Column.__add__, parts)


def penalize(df: DataFrame, p_col: str = "p") -> DataFrame:
    """Adds ``verdict``, ``risk_score`` (0-100) and ``downgraded``.

    The penalty touches PHISHING rows only, and can only lower them.
    """
    p, penalty = F.col(p_col), failure_penalty()
    first = verdict(p)
    hit = (first == "PHISHING") & (penalty > 0)
    risk = F.when(hit, p * 100 * (1 - penalty)).otherwise(p * 100)
    lowered = F.coalesce(hit & (risk / 100 < fv.PHISHING_THRESHOLD), F.lit(False))
    return df.withColumns(
        {
            "risk_score": risk,
            "downgraded": lowered,
            "verdict": F.when(lowered, "SUSPICIOUS").otherwise(first),
        }
    )


def decide(df: DataFrame) -> DataFrame:
    """Final verdict by precedence: trusted, blocked, invalid, then the model.

    Needs ``is_trusted, is_blocked, confidence, ssrf_status`` and, for rows that pass
    the gates, ``verdict`` and ``risk_score`` of :func:`penalize`. A row that passes the
    gates without a score becomes ``ERROR``.
    """
    invalid = F.col("ssrf_status") != "ok"
    return df.withColumns(
        {
            "verdict": F.when(F.col("is_trusted"), "SAFE")
            .when(F.col("is_blocked"), "PHISHING")
            .when(invalid, "SUSPICIOUS")
            .otherwise(F.coalesce(F.col("verdict"), F.lit("ERROR"))),
            "risk_score": F.when(F.col("is_trusted"), fv.TRUSTED_RISK)
            .when(F.col("is_blocked") & (F.col("confidence") > 0.9), fv.BLOCKED_RISK_URL)
            .when(F.col("is_blocked"), fv.BLOCKED_RISK_DOMAIN)
            .when(invalid, fv.INVALID_RISK)
            .otherwise(F.col("risk_score")),
            "ml_bypassed": F.col("is_trusted") | F.col("is_blocked"),
        }
    )


# --- fixed values: texts of the explanation ------------------------------------------
TRUSTED_SUMMARY = "This domain is on a trusted allowlist. ML checks were bypassed."
BLOCKED_SUMMARY = "This URL is on a known phishing blocklist."
INVALID_SUMMARY = "Could not analyze URL due to validation failure."
SAFE_SUMMARY = (
    "No significant phishing indicators detected. Found %d safety indicators."
)
SUSPICIOUS_SUMMARY = (
    "Some concerning patterns detected (%d warnings). "
    "Exercise caution when visiting this site."
)
PHISHING_SUMMARY = (
    "Multiple phishing indicators detected (%d warnings). "
    "This site may be attempting to steal your information."
)
INCOMPLETE_WARNING = (
    "Some security checks could not complete due to network issues. Analysis may be incomplete."
)
DOWNGRADE_WARNING = (
    "Verdict downgraded from PHISHING to SUSPICIOUS due to incomplete analysis."
)
INCONCLUSIVE_INVALID = "Full URL analysis could not be completed"
INVALID_REASONS = {
    "no_hostname": "Invalid URL: no hostname",
    "blocked": "SSRF Protection: Blocked local/private IP address",
}


def summary() -> Column:
    """One sentence by verdict with the signal counts of ``explain``."""
    return (
        F.when(F.col("verdict") == "SAFE", F.format_string(SAFE_SUMMARY, "total_safe"))
        .when(F.col("verdict") == "SUSPICIOUS", F.format_string(SUSPICIOUS_SUMMARY, "total_phishing"))
        .when(F.col("verdict") == "PHISHING", F.format_string(PHISHING_SUMMARY, "total_phishing"))
    )


def warnings() -> Column:
    return F.array_compact(
        F.array(
            F.when(any_failed(), INCOMPLETE_WARNING),
            F.when(F.col("downgraded"), DOWNGRADE_WARNING),
        )
    )


def model_explanation() -> Column:
    """Explanation struct of a row decided by the model; needs the output of ``explain``."""
    texts = F.transform("safe_signals", lambda s: s["description"])
    risks = F.transform("phishing_signals", lambda s: s["description"])
    failed = F.transform(
        "failed_features",
        lambda s: F.concat(s["name"], F.lit(": Network failure during extraction")),
    )
    return F.struct(
        summary().alias("summary"),
        F.slice(texts, 1, 5).alias("positive"),
        F.slice(risks, 1, 5).alias("risk"),
        failed.alias("inconclusive"),
        (~any_failed()).alias("analysis_complete"),
        F.lit(False).alias("allowlist_override"),
    )


def gate_explanation() -> Column:
    """Explanation struct of a row decided by a gate or by validation."""
    none = F.array().cast("array<string>")
    invalid = F.concat(
        F.lit("URL validation failed: "),
        F.when(F.col("ssrf_status") == "blocked", INVALID_REASONS["blocked"]).otherwise(
            INVALID_REASONS["no_hostname"]
        ),
    )
    trusted, blocked = F.col("is_trusted"), F.col("is_blocked")
    return F.struct(
        F.when(trusted, TRUSTED_SUMMARY)
        .when(blocked, BLOCKED_SUMMARY)
        .otherwise(INVALID_SUMMARY)
        .alias("summary"),
        F.when(trusted, F.array("trust_reason")).otherwise(none).alias("positive"),
        F.when(trusted, none)
        .when(blocked, F.array(F.concat(F.lit("Matched blocklist: "), "block_source")))
        .otherwise(F.array(invalid))
        .alias("risk"),
        F.when(trusted | blocked, none)
        .otherwise(F.array(F.lit(INCONCLUSIVE_INVALID)))
        .alias("inconclusive"),
        (trusted | blocked).alias("analysis_complete"),
        trusted.alias("allowlist_override"),
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: total and rows per verdict."""
    def count(name: str) -> Column:
        return F.count_if(F.col("verdict") == name)

    return scored.agg(
        F.count("*").alias("total"),
        count("PHISHING").alias("phishing_count"),
        count("SAFE").alias("safe_count"),
        count("SUSPICIOUS").alias("suspicious_count"),
    )


def restrict(df: DataFrame, status: DataFrame) -> DataFrame:
    """Verdicts under a calibration status: PHISHING is SUSPICIOUS unless healthy.

    ``status`` holds one row with ``calibration_status``; it joins as a scalar subquery
    value, not as a cross join.
    """
    state = F.coalesce(status.select("calibration_status").scalar(), F.lit("unknown"))
    penalty = (
        F.when(state == "healthy", fv.CALIBRATION_PENALTY["healthy"])
        .when(state == "degraded", fv.CALIBRATION_PENALTY["degraded"])
        .otherwise(fv.CALIBRATION_PENALTY["unknown"])
    )
    limited = (state != "healthy") & (F.col("verdict") == "PHISHING")
    return df.withColumns(
        {
            "restricted_verdict": F.when(limited, "SUSPICIOUS").otherwise(F.col("verdict")),
            "confidence_penalty": penalty,
        }
    )


def invariant_violations(scored: DataFrame) -> DataFrame:
    """Trusted rows that are not SAFE. Must be empty."""
    return scored.filter(F.col("is_trusted") & (F.col("verdict") != "SAFE"))


def to_result(df: DataFrame) -> DataFrame:
    """Scores rounded for display."""
    return df.withColumns(
        {
            "risk_score": F.round("risk_score", 1),
            "calibrated_probability": F.round("calibrated_probability", 4),
        }
    )
