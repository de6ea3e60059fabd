"""Scan-log analytics: counters, signals, history, threats, service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.text import percent
from urlguard.functions.times import micros
from urlguard.functions.urls import sanitize_signal, scan_key, validate_url
from urlguard.operators.timelines import entries_made

VERDICTS = ("SAFE", "SUSPICIOUS", "PHISHING")


def drift_status() -> Column:
    """warning when the scan has any warning, else none."""
    return F.when(F.size("warnings") > 0, "warning").otherwise("none")


def telemetry(df: DataFrame) -> DataFrame:
    """Rows (counter, n). One pass, mergeable partial counts."""
    drift = drift_status()
    counters = {"total_scans": F.count("*")}
    counters |= {f"verdict_{v}": F.count_if(F.col("verdict") == v) for v in VERDICTS}
    counters |= {
        "complete_analysis": F.count_if(F.col("analysis_complete")),
        "incomplete_analysis": F.count_if(~F.col("analysis_complete")),
        "allowlist_override": F.count_if(F.col("allowlist_override")),
        "no_allowlist_override": F.count_if(~F.col("allowlist_override")),
    }
    counters |= {f"drift_{d}": F.count_if(drift == d) for d in ("none", "warning", "significant")}
    return df.agg(*[c.alias(n) for n, c in counters.items()]).unpivot(
        [], list(counters), "counter", "n"
    )


def signal_totals(df: DataFrame) -> DataFrame:
    """One row: all risk, positive and inconclusive signals."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.size(name)), F.lit(0))

    return df.agg(
        total("risk").alias("risk_signals"),
        total("positive").alias("positive_signals"),
        total("inconclusive").alias("inconclusive_signals"),
    )


def signal_counts(df: DataFrame) -> DataFrame:
    """Rows (part, signal_type, n) for risk and inconclusive signals."""
    def part(name: str) -> Column:
        return F.transform(
            name, lambda s: F.struct(F.lit(name).alias("part"), sanitize_signal(s).alias("signal_type"))
        )

    return (
        df.select(F.explode(F.concat(part("risk"), part("inconclusive"))).alias("s"))
        .groupBy("s.part", "s.signal_type")
        .agg(F.count("*").alias("n"))
    )


def top_signals(df: DataFrame, n: int = fv.TOP_SIGNALS) -> DataFrame:
    """The n most frequent signal types of each part, exact.

    There are fourteen types, so the ranked table has at most 28 rows.
    """
    order = Window.partitionBy("part").orderBy(F.desc("n"), "signal_type")
    return (
        signal_counts(df).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    )


def telemetry_record(df: DataFrame) -> DataFrame:
    """All counters of a scan log as one record, with its ten top signals and the time it covers."""
    drift = drift_status()

    def by(names, condition) -> Column:
        pairs = [part for n in names for part in (F.lit(n), F.count_if(condition == n))]
        return F.create_map(*pairs)

    def top(part: str) -> Column:
        rows = top_signals(df).filter(F.col("part") == part)
        return rows.agg(F.map_from_entries(F.collect_list(F.struct("signal_type", "n"))).alias("m")).scalar()

    totals = {name: F.coalesce(F.sum(F.size(name)), F.lit(0)) for name in ("risk", "positive", "inconclusive")}
    return df.agg(
        F.count("*").alias("total_scans"), by(VERDICTS, F.col("verdict")).alias("scans_by_verdict"),
        F.count_if(F.col("analysis_complete")).alias("scans_with_complete_analysis"),
        F.count_if(~F.col("analysis_complete")).alias("scans_with_incomplete_analysis"),
        F.count_if(F.col("allowlist_override")).alias("scans_with_allowlist_override"),
        F.count_if(~F.col("allowlist_override")).alias("scans_without_allowlist_override"),
        by(("none", "warning", "significant"), drift).alias("scans_by_drift_status"),
        *[total.alias(f"total_{name}_signals") for name, total in totals.items()],
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("collection_start"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"),
    ).withColumns({"top_risk_signals": top("risk"), "top_inconclusive_checks": top("inconclusive")})


def telemetry_summary(df: DataFrame) -> DataFrame:
    """One row: shares as percent text, mean risk signals per scan, top five signals."""
    total = F.greatest(F.count("*"), F.lit(1))

    def share(condition: Column) -> Column:
        return percent(F.count_if(condition) / total)

    top = (
        top_signals(df, 5).filter("part = 'risk'")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "signal_type"))), lambda s: s["signal_type"]), ",").alias("v"))
        .scalar()
    )
    return df.agg(
        F.count("*").alias("total_scans"),
        *[share(F.col("verdict") == v).alias(f"share_{v}") for v in VERDICTS],
        share(~F.col("analysis_complete")).alias("incomplete_analysis_rate"),
        share(F.col("allowlist_override")).alias("allowlist_override_rate"),
        F.round(F.coalesce(F.sum(F.size("risk")), F.lit(0)) / total, 2).alias(
            "avg_risk_signals_per_scan"
        ),
    ).withColumn("top_risk_signals", top)


def top3() -> Column:
    """array<struct<feature, impact>>: three risks as High, else three positives."""
    def tagged(name: str, impact: str) -> Column:
        return F.transform(
            F.slice(name, 1, 3),
            lambda s: F.struct(s.alias("feature"), F.lit(impact).alias("impact")),
        )

    return F.when(F.size("risk") > 0, tagged("risk", "High")).otherwise(
        tagged("positive", "Positive")
    )


def audit_rows(df: DataFrame) -> DataFrame:
    """One JSON record per scan: ts, verdict, drift, top_3. No URL."""
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "verdict",
        drift_status().alias("drift"),
        top3().alias("top_3"),
    )
    return df.select(F.to_date("ts").alias("day"), F.to_json(record).alias("value"))


def history(
    df: DataFrame, verdict: str | None = None, search: str | None = None,
    page: int = 1, page_size: int = 10,
) -> DataFrame:
    """One page of the scan history, newest first.

    The page is taken from a top-k of ``page * page_size`` rows, not from a full sort.
    """
    return (
        matching_history(df, verdict, search)
        .orderBy(F.desc("ts"), "scan_id")
        .offset((page - 1) * page_size)
        .limit(page_size)
    )


def matching_history(df: DataFrame, verdict: str | None, search: str | None) -> DataFrame:
    rows = df
    if verdict:
        rows = rows.filter(F.col("verdict") == verdict)
    if search:
        rows = rows.filter(F.contains(F.lower("url"), F.lit(search.lower())))
    return rows


def history_pages(
    df: DataFrame, verdict: str | None = None, search: str | None = None, page_size: int = 10
) -> DataFrame:
    """Number of matching rows and pages."""
    return matching_history(df, verdict, search).agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / page_size).alias("pages")
    )


def threat_regions(df: DataFrame, n: int = 5) -> DataFrame:
    """Regions with most threats."""
    return (
        df.groupBy("region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(n)
    )


def threat_filter(df: DataFrame, types: list[str], vectors: list[str]) -> DataFrame:
    return df.filter(F.col("type").isin(types) & F.col("attack_vector").isin(vectors))


def live_threats(df: DataFrame, n: int = 5) -> DataFrame:
    """Newest threats first."""
    return df.orderBy(F.desc("ts"), "threat_id").limit(n)


def requests_total(df: DataFrame) -> DataFrame:
    """Requests by verdict and source, with totals; ``ALL`` marks a total."""
    def name(c: str) -> Column:
        return F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c))

    return df.rollup("verdict", "source").agg(
        name("verdict").alias("v"), name("source").alias("s"), F.count("*").alias("n")
    ).select(F.col("v").alias("verdict"), F.col("s").alias("source"), "n")


def latency_hist(df: DataFrame) -> DataFrame:
    """Cumulative rows per upper bound: one count per bound in one pass."""
    bounds = [*fv.LATENCY_BUCKETS, float("inf")]
    counts = [F.count_if(F.col("latency") <= b) for b in bounds]
    names = [*map(str, fv.LATENCY_BUCKETS), "+Inf"]
    return df.agg(*[c.alias(n) for n, c in zip(names, counts)]).unpivot(
        [], [f"`{n}`" for n in names], "le", "n"
    )


def cache_hits(df: DataFrame, ttl: int = 3600) -> DataFrame:
    """One row: lookups, hits, hit rate. An entry lives ``ttl`` seconds from the look that made it.

    A hit does not renew its entry. Trusted and invalid input is looked up and never kept. Looks
    at one instant are merged first. A key's timeline is cut into days (or a longer life of an entry),
    which are put together as functions, so a hot key is many tasks (see ``timelines.entries_made``).
    """
    kept = validate_url(F.col("url"))["ok"]
    if "is_trusted" in df.columns:
        kept = kept & ~F.coalesce("is_trusted", F.lit(False))
    looks = df.select(F.coalesce(kept, F.lit(False)).alias("kept"), scan_key(F.col("url")).alias("k"), micros("ts").alias("t"))
    instants = looks.filter("kept").select("k", "t").distinct()
    made = entries_made(instants, ttl * 1_000_000, max(ttl, 86_400) * 1_000_000)
    totals = looks.agg(F.count("*").alias("lookups"), F.count_if("kept").alias("_kept"))
    return totals.select(
        "lookups", (F.col("_kept") - made.scalar()).alias("hits"),
    ).withColumn("hit_rate", F.col("hits") / F.greatest("lookups", F.lit(1)))


def ops_counters(df: DataFrame) -> DataFrame:
    """Rows (counter, n) from scan results: bypasses, blocklist matches, failures."""
    def named(condition: Column, name) -> Column:
        return F.when(condition, name)

    names = F.array_compact(
        F.array(
            named(F.col("is_trusted"), F.lit("trusted_bypass")),
            named(F.col("block_source").isNotNull(), F.concat(F.lit("match:"), "block_source")),
            *[
                named(F.coalesce(F.col(f"failures.{k}_failed"), F.lit(False)), F.lit(f"failure:{k}"))
                for k in ("http", "whois", "dns")
            ],
        )
    )
    return df.select(F.explode(names).alias("counter")).groupBy("counter").agg(
        F.count("*").alias("n")
    )


def over_limit(df: DataFrame, limit: int, window: str) -> DataFrame:
    """Callers with more than ``limit`` requests in a fixed window."""
    return (
        df.groupBy("caller", F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .select("caller", F.col("w.start").alias("window_start"), "n")
    )
