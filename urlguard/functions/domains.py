"""Registered domain, suffix and subdomain by a public-suffix table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.functions.urls import host as url_host
from urlguard.functions.urls import is_ipv4
from urlguard.operators.lookup import lookup


def labels(name: Column) -> Column:
    """Number of dot-separated labels."""
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def last_labels(name: Column, n: Column) -> Column:
    return F.call_function("substring_index", name, F.lit("."), -n)


def suffix_rules(psl: DataFrame) -> DataFrame:
    """One row for each name in the rules: which kinds of rule it has.

    ``psl`` has one rule in each row of column ``suffix``: a name, ``*.`` and a name (any one
    label before the name belongs to the suffix), or ``!`` and a name (an exception to that).
    """
    rule = F.col("suffix")
    wild, exempt = F.startswith(rule, F.lit("*.")), F.startswith(rule, F.lit("!"))
    kinds = psl.select(
        F.regexp_replace(rule, r"^(\*\.|!)", "").alias("name"), wild.alias("wild"), exempt.alias("exempt")
    )
    plain = ~F.col("wild") & ~F.col("exempt")
    return kinds.groupBy("name").agg(F.max(plain).alias("plain"), F.max("wild").alias("wild"), F.max("exempt").alias("exempt"))


def suffix_lengths(hosts: DataFrame, psl: DataFrame) -> DataFrame:
    """(host, suffix_labels) for the hosts of column ``host`` that have a public suffix.

    The tails of every distinct host meet the rules by name; of the rules met an exception wins, or
    else the longest suffix. The number of rules is not bounded: a small table is broadcast by
    Spark, a large one meets the tails by shuffle. No tail is made that is longer than the longest rule.
    """
    rules = suffix_rules(psl)
    host, n = F.col("host"), F.col("_n")
    longest = rules.agg(F.max(labels(F.col("name")))).scalar()
    named = hosts.select("host").distinct().filter(host.isNotNull() & (host != "") & ~is_ipv4(host))
    counts = F.sequence(F.lit(1), F.least(labels(host), F.coalesce(longest, F.lit(1))))
    tails = named.select("host", F.explode(counts).alias("_n")).withColumn("name", last_labels(host, n))
    met = lookup(tails, rules, "name", "inner")
    length = F.greatest(F.when(F.col("plain"), n), F.when(F.col("wild") & (n < labels(host)), n + 1))
    best = F.max(F.struct(F.col("exempt").alias("exempt"), F.when(F.col("exempt"), n - 1).otherwise(length).alias("n")))
    return met.groupBy("host").agg(best.alias("best")).select("host", F.col("best.n").alias("suffix_labels"))


DOMAIN_COLUMNS = ("suffix", "registered_domain", "domain_label", "subdomain_labels")


def registered_domain(df: DataFrame, host_col: str, psl: DataFrame) -> DataFrame:
    """Adds ``suffix``, ``registered_domain``, ``domain_label`` and ``subdomain_labels``.

    A host without a known suffix keeps its last label (an address: itself) as both
    label and registered domain. A host that is itself a suffix has an empty label. The
    new columns are never null, so joins on them push no filter into this expression.
    The rules are met once for each distinct host (see ``suffix_lengths``), and the rows
    look their host up; a stream does so in its micro-batches.
    """
    host = F.coalesce(F.col(host_col), F.lit(""))
    lengths = suffix_lengths(df.select(host.alias("host")), psl)
    lengths = lengths.select(F.col("host").alias("_of"), F.col("suffix_labels").alias("_suffix_labels"))
    found = lookup(df.withColumn("_of", host), lengths, "_of")
    n = F.coalesce(F.col("_suffix_labels"), F.lit(0))
    address = is_ipv4(host)
    kept = F.when(address, 4).otherwise(n + 1)
    bare_suffix = (n > 0) & (n == labels(host))
    name = F.col("registered_domain")
    parts = found.select(
        *df.columns,
        last_labels(host, n).alias("suffix"),
        F.concat(F.when(bare_suffix, ".").otherwise(""), last_labels(host, kept)).alias(
            "registered_domain"
        ),
    )
    label_count = F.when(F.startswith(name, F.lit(".")), labels(name) - 1).otherwise(labels(name))
    return parts.withColumns(
        {
            "domain_label": F.when(address, host).otherwise(F.substring_index(name, ".", 1)),
            "subdomain_labels": F.when(address, 0).otherwise(labels(host) - label_count),
        }
    )


def with_domain(df: DataFrame, psl: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the domain columns of a URL's host; a frame that has them stays as it is."""
    if set(DOMAIN_COLUMNS) <= set(df.columns):
        return df
    own = [c for c in df.columns if c not in DOMAIN_COLUMNS]
    keyed = df.select(*own, url_host(F.col(url_col)).alias("_host"))
    return registered_domain(keyed, "_host", psl).select(*own, *DOMAIN_COLUMNS)
