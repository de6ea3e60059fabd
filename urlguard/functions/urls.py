"""URL and label scalar functions: native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.udfs import idna_host
from urlguard.operators.lookup import lookup

WHITESPACE = " \t\n\r\x0b\x0c"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def sanitize_url(c: Column) -> Column:
    """Trimmed URL; ``https://`` is put in front when it has no http scheme."""
    url = strip(c)
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def validate_url(c: Column) -> Column:
    """struct(ok, error) for raw user input."""
    url = strip(c)
    error = (
        F.when(c.isNull() | (c == ""), "URL is required")
        .when(F.length(url) < 4, "URL is too short")
        .when(F.length(url) > 2000, "URL is too long (max 2000 characters)")
        .when(F.contains(url, F.lit(" ")), "URL cannot contain spaces")
    )
    return F.struct(error.isNull().alias("ok"), error.alias("error"))


def authority(url: Column) -> Column:
    """The part between the scheme and the path, with user info and port."""
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host_before_port(url: Column) -> Column:
    """Authority up to its first colon."""
    return F.substring_index(authority(url), ":", 1)


def host(c: Column) -> Column:
    """Bare lower-case host of a URL or domain.

    User info is dropped first: ``https://google.com:x@evil.com/`` is ``evil.com``.
    """
    pattern = "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#:]*)"
    return F.rtrim(F.regexp_extract(F.lower(strip(c)), pattern, 1), F.lit("."))


def url_parts(c: Column) -> Column:
    """struct(scheme, authority, path, params, query, fragment)."""
    rest = F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    whole_path = F.regexp_extract(rest, "^([^?#]*)", 1)
    return F.struct(
        F.lower(F.regexp_extract(c, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)).alias("scheme"),
        authority(c).alias("authority"),
        F.regexp_extract(whole_path, "^((?:.*/)?[^/;]*)", 1).alias("path"),
        F.regexp_extract(whole_path, "^(?:.*/)?[^/;]*;([^/]*)$", 1).alias("params"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        F.regexp_extract(rest, "#(.*)$", 1).alias("fragment"),
    )


def bare_host(c: Column) -> Column:
    """Lower-case host and port of a URL, without a default port."""
    return F.regexp_replace(authority(_full(c)), ":(80|443)$", "")


def _full(c: Column) -> Column:
    lowered = F.lower(strip(c))
    return F.when(lowered.rlike("^https?://"), lowered).otherwise(F.concat(F.lit("http://"), lowered))


def canonicalize_url(c: Column, ascii_host: Column | None = None) -> Column:
    """Form used for deduplication: no scheme, default port, fragment or final slash.

    ``ascii_host`` is the host's IDNA form, where it has another one; see with_canonical.
    """
    parts = url_parts(_full(c))
    query = parts["query"]
    canonical = F.concat(
        bare_host(c) if ascii_host is None else F.coalesce(ascii_host, bare_host(c)),
        F.rtrim(parts["path"], F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(c.isNull() | (c == ""), "").otherwise(canonical)


def with_canonical(df: DataFrame, url_col: str = "url", name: str = "canonical_url") -> DataFrame:
    """Adds the canonical URL. Python sees each distinct host that is not ASCII once.

    Rows with an ASCII host get keys that match nothing and are spread evenly.
    """
    url = F.col(url_col)
    host = bare_host(url)
    strange = host.rlike("[^\\x00-\\x7F]")
    keyed = df.withColumn("_bare", F.when(strange, host).otherwise(F.xxhash64(url).cast("string")))
    hosts = df.filter(strange).select(host.alias("_bare")).distinct().withColumn("_ascii", idna_host("_bare"))
    joined = lookup(keyed, hosts, "_bare")
    return joined.withColumn(name, canonicalize_url(url, F.col("_ascii"))).drop("_bare", "_ascii")


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def normalize_url(c: Column) -> Column:
    """Blocklist key: lower case, trimmed, one final slash removed."""
    return F.regexp_replace(strip(F.lower(c)), "/$", "")


def scan_key(c: Column) -> Column:
    return F.md5(strip(F.lower(c)))


def is_ipv4(c: Column) -> Column:
    return c.rlike(IPV4)


def ipv4_number(c: Column) -> Column:
    """IPv4 text as BIGINT, null when it is not an address."""
    octets = F.split(c, r"\.")
    number = reduce(
        lambda acc, i: acc * 256 + F.get(octets, F.lit(i)).try_cast("bigint"),
        range(4),
        F.lit(0).cast("bigint"),
    )
    return F.when(is_ipv4(c), number)


def in_blocked_range(address: Column) -> Column:
    """True when the address lies in one of the six private or local ranges."""
    number = ipv4_number(address)

    def inside(cidr: str) -> Column:
        base, bits = cidr.split("/")
        first = reduce(lambda acc, part: acc * 256 + int(part), base.split("."), 0)
        return number.between(first, first + 2 ** (32 - int(bits)) - 1)

    return F.coalesce(reduce(Column.__or__, map(inside, fv.BLOCKED_RANGES)), F.lit(False))


def address_check(name: Column, first_record: Column) -> Column:
    """ok, no_hostname or blocked, for a host and its first A record.

    An IP literal is its own address. A host without a record passes.
    """
    address = F.when(is_ipv4(name), name).otherwise(first_record)
    return (
        F.when(name == "", "no_hostname").when(in_blocked_range(address), "blocked").otherwise("ok")
    )


def ssrf_status(urls: DataFrame, dns: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``ssrf_status`` of the URL's host, with its A records from ``dns``."""
    records = dns.select(F.col("host").alias("_host"), F.get("a_records", F.lit(0)).alias("_a"))
    joined = urls.withColumn("_host", host_before_port(sanitize_url(F.col(url_col)))).join(
        records, "_host", "left"
    )
    return joined.select(
        *urls.columns, address_check(F.col("_host"), F.col("_a")).alias("ssrf_status")
    )


def normalize_label(c: Column, polarity: str = "default") -> Column:
    """Label text as 1 (phishing), 0 (legitimate) or null.

    ``default`` reads both 1 and -1 as phishing. ``signed`` reads -1 as phishing and 1
    as legitimate, for files that use {-1, 1}.
    """
    text = F.lower(strip(c.cast("string")))
    number = text.try_cast("double")
    signed = F.lit(False)
    if polarity == "signed":
        signed = F.coalesce(number == 1, F.lit(False))
    return (
        F.when(signed, 0)
        .when(text.isin(*fv.PHISHING_LABELS), 1)
        .when(text.isin(*fv.LEGITIMATE_LABELS), 0)
        .when(F.abs(number) == 1, 1)
        .when(number == 0, 0)
    )


def to_signed(binary: Column) -> Column:
    """1 phishing / 0 legitimate to -1 phishing / 1 legitimate."""
    return F.when(binary == 1, -1).when(binary == 0, 1)


def to_binary(signed: Column) -> Column:
    """-1 phishing / 1 legitimate to 1 phishing / 0 legitimate."""
    return F.when(signed == -1, 1).when(signed == 1, 0)


def valid_rows(df: DataFrame) -> DataFrame:
    """Keeps rows with a label and a usable URL."""
    return df.filter(
        F.col("label").isNotNull()
        & (F.length("url") > 3)
        & ~F.col("url").isin("nan", "None", "")
    )


def risk_level(risk: Column) -> Column:
    ladder = F.when(risk.isNull(), None)
    for floor, name in fv.RISK_LEVELS:
        ladder = ladder.when(risk >= floor, name)
    return ladder.otherwise(fv.LOWEST_RISK_LEVEL)


# --- fixed values: words that name a signal type, first match wins; all or any of them ------
ALL, ANY = "all", "any"
SIGNAL_WORDS = (
    ("whois_failed", ALL, ("whois", "failed")),
    ("dns_failed", ALL, ("dns", "failed")),
    ("http_failed", ALL, ("http", "failed")),
    ("domain_age", ALL, ("domain age",)),
    ("https_status", ALL, ("https",)),
    ("ssl_certificate", ANY, ("ssl", "certificate")),
    ("trusted_domain", ANY, ("trusted", "allowlist")),
    ("redirect_detected", ALL, ("redirect",)),
    ("suspicious_pattern", ALL, ("suspicious",)),
    ("ip_address_pattern", ALL, ("ip", "address")),
    ("url_shortener", ALL, ("short",)),
    ("form_detected", ALL, ("form",)),
    ("iframe_detected", ALL, ("iframe",)),
)
OTHER_SIGNAL = "other_signal"


def sanitize_signal(c: Column) -> Column:
    """Type of a free-text signal, without the values it carries."""
    text = F.lower(strip(c))
    ladder = F.when(text.isNull(), None)
    for name, kind, words in SIGNAL_WORDS:
        found = [F.contains(text, F.lit(w)) for w in words]
        ladder = ladder.when(reduce(Column.__and__ if kind == ALL else Column.__or__, found), name)
    return ladder.otherwise(OTHER_SIGNAL)
