"""Allowlist and blocklist gates as joins.

Lists have one row per key when they reach the join, so a left join never multiplies
rows. No broadcast is forced: Spark broadcasts a list whose measured size is under its
threshold and otherwise shuffles, where AQE splits the partition of a hot domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.domains import with_domain
from urlguard.functions.features import unmask
from urlguard.functions.urls import normalize_url, scan_key
from urlguard.operators.lookup import lookup


def trust_gate(
    df: DataFrame, allowlist: DataFrame, psl: DataFrame, url_col: str = "url"
) -> DataFrame:
    """Adds ``is_trusted, registered_domain, matched_domain, trust_reason``.

    A URL is trusted when its registered domain is listed, or else when its public
    suffix is listed (``gov``). ``allowlist`` has a ``domain`` column.
    """
    listed = allowlist.select("domain").distinct()
    by_domain = listed.select(
        F.col("domain").alias("registered_domain"), F.col("domain").alias("_domain_hit")
    )
    by_suffix = listed.select(F.col("domain").alias("suffix"), F.col("domain").alias("_suffix_hit"))
    name, hit, suffix_hit = F.col("registered_domain"), F.col("_domain_hit"), F.col("_suffix_hit")
    reason = (
        F.when(
            hit.isNotNull(), F.concat(F.lit("Domain '"), name, F.lit("' is in trusted allowlist"))
        )
        .when(
            suffix_hit.isNotNull(),
            F.concat(F.lit("TLD '."), suffix_hit, F.lit("' is in trusted allowlist")),
        )
        .otherwise("Domain not in trusted allowlist")
    )
    own = [c for c in df.columns if c != "registered_domain"]
    return (
        lookup(lookup(with_domain(df, psl, url_col), by_domain, "registered_domain"), by_suffix, "suffix")
        .select(
            *own, "registered_domain",
            (hit.isNotNull() | suffix_hit.isNotNull()).alias("is_trusted"),
            F.coalesce(hit, suffix_hit).alias("matched_domain"),
            reason.alias("trust_reason"),
        )
    )


def untrusted(df: DataFrame, allowlist: DataFrame, psl: DataFrame) -> DataFrame:
    """Rows that neither the domain nor the suffix gate trusts."""
    listed = allowlist.select("domain")
    return (
        with_domain(df, psl)
        .join(listed.withColumnRenamed("domain", "registered_domain"), "registered_domain", "left_anti")
        .join(listed.withColumnRenamed("domain", "suffix"), "suffix", "left_anti")
        .select(*[c for c in df.columns if c != "registered_domain"], "registered_domain")
    )


def block_keys(blocklist: DataFrame, psl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a blocklist is met by: distinct URL keys (``_key``) and registered domains (``_reg``)."""
    urls = blocklist.select(normalize_url(F.col("url")).alias("_key")).distinct()
    domains = with_domain(blocklist, psl).select(F.col("registered_domain").alias("_reg")).distinct()
    return urls, domains


def block_gate(df: DataFrame, blocklist: DataFrame, psl: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``is_blocked, block_source, matched_url, blocked_domain, confidence``.

    An exact URL match outranks a match of the registered domain only.
    """
    return block_gate_by_keys(df, *block_keys(blocklist, psl), psl, url_col)


def block_gate_by_keys(
    df: DataFrame, urls: DataFrame, domains: DataFrame, psl: DataFrame, url_col: str = "url"
) -> DataFrame:
    """The same with the keys of ``block_keys``, which many batches can share."""
    own = df.columns
    keyed = with_domain(df, psl, url_col).withColumns(
        {
            "_key": normalize_url(F.col(url_col)),
            "_reg": F.nullif(F.col("registered_domain"), F.lit("")),
        }
    )
    url_hit, domain_hit = F.col("_url_hit").isNotNull(), F.col("_domain_hit").isNotNull()
    return (
        lookup(
            lookup(keyed, urls.withColumn("_url_hit", F.lit(1)), "_key"),
            domains.withColumn("_domain_hit", F.lit(1)), "_reg",
        )
        .select(
            *own,
            (url_hit | domain_hit).alias("is_blocked"),
            F.when(url_hit, "blocklist").when(domain_hit, "blocklist_domain").alias("block_source"),
            F.when(url_hit, F.col("_key")).alias("matched_url"),
            F.when(~url_hit & domain_hit, F.col("_reg")).alias("blocked_domain"),
            F.when(url_hit, fv.URL_MATCH_CONFIDENCE)
            .when(domain_hit, fv.DOMAIN_MATCH_CONFIDENCE)
            .otherwise(0.0)
            .alias("confidence"),
        )
    )


def blocklist_stats(blocklist: DataFrame, psl: DataFrame) -> DataFrame:
    """Rows (metric, n): distinct URLs, distinct domains, distinct URLs per source."""
    keyed = with_domain(blocklist, psl).select(
        "source", normalize_url(F.col("url")).alias("key"), "registered_domain"
    )
    totals = keyed.agg(
        F.count_distinct("key").alias("total_urls"),
        F.count_distinct("registered_domain").alias("total_domains"),
    ).unpivot([], ["total_urls", "total_domains"], "metric", "n")
    per_source = keyed.groupBy(F.concat(F.lit("source:"), "source").alias("metric")).agg(
        F.count_distinct("key").alias("n")
    )
    return totals.unionByName(per_source)


def lookalikes(df: DataFrame, allowlist: DataFrame, psl: DataFrame) -> DataFrame:
    """Untrusted rows whose unmasked label holds a protected brand; one row per brand.

    The brands are a fixed short list, so they are tested inside the row: no join.
    """
    plain = unmask(F.lower("domain_label"))
    brands = F.array(*map(F.lit, fv.PROTECTED_BRANDS))
    hits = F.filter(brands, lambda b: F.contains(F.col("_plain"), b))
    return (
        untrusted(with_domain(df, psl), allowlist, psl)
        .withColumn("_plain", plain)
        .select(*[c for c in df.columns if c != "registered_domain"], "registered_domain", F.explode(hits).alias("brand"))
    )


def apply_allowlist_edits(allowlist: DataFrame, edits: DataFrame) -> DataFrame:
    """Allowlist after edits ``(domain, action add|remove, ts)``; the latest edit wins."""
    name = F.lower(F.trim("domain"))
    latest = (
        edits.select(name.alias("domain"), "action", "ts")
        .filter((F.col("action") == "remove") | (F.length("domain") >= 3))
        .groupBy("domain")
        .agg(F.max_by("action", "ts").alias("action"))
    )
    kept = allowlist.select("domain").distinct().join(
        latest.filter("action = 'remove'"), "domain", "left_anti"
    )
    return kept.unionByName(latest.filter("action = 'add'").select("domain")).distinct()


def missing_features(urls: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """URLs without a cached feature row younger than one hour."""
    fresh = cache.filter(
        F.col("computed_at") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    ).select("scan_key")
    return (
        urls.withColumn("scan_key", scan_key(F.col("url")))
        .join(fresh, "scan_key", "left_anti")
    )
