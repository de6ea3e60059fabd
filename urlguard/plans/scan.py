"""The scan job: gates, features, score, verdict, explanation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions import features as fx
from urlguard.functions.domains import with_domain
from urlguard.functions.urls import (
    address_check,
    host_before_port,
    sanitize_url,
    strip,
    validate_url,
)
from urlguard.operators import verdict as vd
from urlguard.operators.gates import block_gate, trust_gate


@dataclass
class Tables:
    """What a scan joins with."""

    crawl: DataFrame
    whois: DataFrame
    dns: DataFrame
    certs: DataFrame
    psl: DataFrame
    allowlist: DataFrame
    blocklist: DataFrame
    # Prepared look-ups (plans/stored.py): page features by page key, host facts by host.
    pages: DataFrame | None = None
    hosts: DataFrame | None = None
    # A URL is judged by all its crawls together, not by the latest one.
    every_crawl: bool = False

    def meet_hosts(self, rows: DataFrame, batch: DataFrame) -> DataFrame:
        """Adds host facts to rows made from a batch of URLs."""
        if self.hosts is None:
            return fx.with_host_facts(rows, self.whois, self.dns, self.certs)
        return fx.meet_hosts(rows, fx.wanted(self.hosts, "host", batch, fx.host_key()))

    def meet_pages(self, rows: DataFrame, batch: DataFrame) -> DataFrame:
        """Adds page features to rows made from a batch of URLs."""
        if self.pages is None:
            return fx.with_pages(rows, self.crawl, self.every_crawl)
        return fx.meet_pages(rows, fx.wanted(self.pages, "_page", batch, fx.page_key()))


def signal_score(df: DataFrame) -> DataFrame:
    """Score without a trained model: phishing signals over decided signals."""
    return df.withColumn("p", fx.signal_share("_crawls" in df.columns))


def gate(urls: DataFrame, tables: Tables) -> DataFrame:
    """Adds domain columns, the trust and blocklist checks, host facts and address check."""
    located = with_domain(urls, tables.psl)
    trusted = trust_gate(located, tables.allowlist, tables.psl)
    blocked = block_gate(trusted, tables.blocklist, tables.psl)
    facts = tables.meet_hosts(blocked, urls)
    status = address_check(host_before_port(sanitize_url(F.col("url"))), F.get("a_records", F.lit(0)))
    return facts.withColumn("ssrf_status", status)


GATE_COLUMNS = (
    "registered_domain", "is_trusted", "matched_domain", "trust_reason", "is_blocked",
    "block_source", "matched_url", "blocked_domain", "confidence", "ssrf_status",
)


def scan(
    urls: DataFrame,
    tables: Tables,
    as_of: str,
    score: Callable[[DataFrame], DataFrame] = signal_score,
) -> DataFrame:
    """One row per URL with verdict, risk score, explanation and warnings.

    One pass: every row goes through the gates once and meets each look-up table once.
    A gated row then carries a page key that matches nothing and is spread evenly, so
    it costs no page look-up and makes no hot key. ``urls`` keeps its other columns.
    """
    gated = gate(urls, tables)
    passed = ~F.col("is_trusted") & ~F.col("is_blocked") & (F.col("ssrf_status") == "ok")
    nowhere = F.concat(F.lit("https://gated/"), F.pmod(F.xxhash64("url"), F.lit(1 << 20)))
    url = F.col("_scanned")
    keyed = fx.url_features(gated, tables.psl).withColumns(
        {
            "_passed": passed,
            "_scanned": F.col("url"),
            "url": F.when(passed, F.col("url")).otherwise(nowhere),
        }
    )
    paged = tables.meet_pages(keyed, urls).withColumn("url", url)
    featured = fx.host_features(paged, as_of)
    scored = vd.decide(vd.penalize(score(fx.explain(featured))))
    by_model = F.col("_passed")
    nothing = F.array().cast("array<string>")
    return scored.select(
        *urls.columns, *GATE_COLUMNS, "verdict", "risk_score", "ml_bypassed",
        F.when(by_model, F.array(*fv.FEATURE_NAMES)).alias("features"),
        F.when(by_model, F.struct("http_failed", "whois_failed", "dns_failed")).alias("failures"),
        F.when(by_model, vd.model_explanation())
        .otherwise(vd.gate_explanation())
        .alias("explanation"),
        F.when(by_model, vd.warnings())
        .when(F.col("ml_bypassed"), nothing)
        .otherwise(vd.gate_explanation()["risk"])
        .alias("warnings"),
        F.when(by_model, F.col("p")).otherwise(0.0).alias("calibrated_probability"),
    )


def batch_scan(urls: DataFrame, tables: Tables, as_of: str, score=signal_score) -> DataFrame:
    """Scan of raw user input: invalid input is left out, the rest is trimmed and scanned."""
    valid = urls.filter(validate_url(F.col("url"))["ok"]).withColumn("url", strip(F.col("url")))
    return scan(valid, tables, as_of, score)
