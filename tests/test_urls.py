import pytest
from pyspark.sql import functions as F

from urlguard.functions import urls as ux
from urlguard.functions.domains import registered_domain


def values(spark, function, inputs, kind="string"):
    rows = [(k, v) for k, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(function(F.col("v"))).collect()]


def test_sanitize(spark):
    got = values(spark, ux.sanitize_url, [" a.com\n", "http://a.com", "HTTPS://a.com"])
    assert got == ["https://a.com", "http://a.com", "https://HTTPS://a.com"]


def test_validate(spark):
    cases = [None, "", "abc", "a" * 2001, "http://a b", "http://a.com"]
    got = values(spark, lambda c: ux.validate_url(c)["error"], cases)
    assert got == [
        "URL is required", "URL is required", "URL is too short",
        "URL is too long (max 2000 characters)", "URL cannot contain spaces", None,
    ]


def test_host_drops_user_info_and_port(spark):
    got = values(spark, ux.host, [
        "https://google.com:x@evil.com/", "http://A.com:8080/x", "b.org/x", "https://c.com.?q",
        "https://gооgle.com/x",
    ])
    assert got == ["evil.com", "a.com", "b.org", "c.com", "gооgle.com"]


@pytest.mark.parametrize("url,expected", [
    ("http://h.com/a;p=1?q#f", ("http", "h.com", "/a", "p=1", "q", "f")),
    ("https://h.com", ("https", "h.com", "", "", "", "")),
    ("https://h.com/a;x/b?c=//d", ("https", "h.com", "/a;x/b", "", "c=//d", "")),
])
def test_parts(spark, url, expected):
    assert tuple(values(spark, ux.url_parts, [url])[0]) == expected


def test_canonical(spark):
    urls = [
        "http://h.com:80/a//", "HTTPS://H.com:443/A?Q#f", "h.com/a;p=1", None, "https://bücher.de/x/",
        "http://h.com:8080/", "http://h.com/a?",
    ]
    rows = ux.with_canonical(spark.createDataFrame(list(enumerate(urls)), "k int, url string"))
    got = [r.canonical_url for r in rows.orderBy("k").collect()]
    assert got == ["h.com/a", "h.com/a?q", "h.com/a", "", "xn--bcher-kva.de/x", "h.com:8080", "h.com/a"]


def test_labels(spark):
    cases = ["phishing", " BAD", "1", "-1", "1.0", "0", "benign", "0.0", "2", "", None, "x"]
    assert values(spark, ux.normalize_label, cases) == [1, 1, 1, 1, 1, 0, 0, 0, None, None, None, None]
    signed = values(spark, lambda c: ux.normalize_label(c, "signed"), ["1", "-1", "phishing", "1.0"])
    assert signed == [0, 1, 1, 0]


def test_label_conventions_are_inverse(spark):
    assert values(spark, lambda c: ux.to_binary(ux.to_signed(c)), [0, 1, None], "int") == [0, 1, None]


def test_risk_levels(spark):
    got = values(spark, ux.risk_level, [85.0, 84.9, 70.0, 55.0, 30.0, 29.9], "double")
    assert got == ["Critical Risk", "High Risk", "High Risk", "Elevated Risk", "Low Risk", "Minimal Risk"]


def test_blocked_ranges(spark):
    cases = ["127.0.0.1", "10.9.9.9", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1",
             "192.168.1.1", "169.254.0.1", "0.0.0.0", "8.8.8.8", "host", "256.1.1.1"]
    got = values(spark, ux.in_blocked_range, cases)
    assert got == [True, True, False, True, True, False, True, True, True, False, False, False]


def test_ssrf_status(spark):
    urls = spark.createDataFrame(
        [("http://10.0.0.1/x",), ("http://in.test/",), ("http://out.test",), ("https:///x",)], "url string"
    )
    dns = spark.createDataFrame([("in.test", ["192.168.0.9", "8.8.8.8"])], "host string, a_records array<string>")
    got = {r.url: r.ssrf_status for r in ux.ssrf_status(urls, dns).collect()}
    assert got == {"http://10.0.0.1/x": "blocked", "http://in.test/": "blocked",
                   "http://out.test": "ok", "https:///x": "no_hostname"}


def test_signals_first_match_wins(spark):
    cases = ["WHOIS lookup failed", "http failed", "Using HTTPS", "SSL certificate",
             "In trusted allowlist", "IP address used", "Known shortener", "Odd", " Domain age: 2 days"]
    assert values(spark, ux.sanitize_signal, cases) == [
        "whois_failed", "http_failed", "https_status", "ssl_certificate", "trusted_domain",
        "ip_address_pattern", "url_shortener", "other_signal", "domain_age",
    ]


@pytest.mark.parametrize("host,registered,suffix,label,subdomains", [
    ("www.google.com", "google.com", "com", "google", 1),
    ("google.com.evil-site.xyz", "evil-site.xyz", "xyz", "evil-site", 2),
    ("www.gov.uk", "www.gov.uk", "gov.uk", "www", 0),
    ("gov.uk", ".gov.uk", "gov.uk", "", 0),
    ("a.b.c.unknown", "unknown", "", "unknown", 3),
    ("10.1.2.3", "10.1.2.3", "", "10.1.2.3", 0),
    ("x.y.z.ck", "y.z.ck", "z.ck", "y", 1),
    ("www.ck", "www.ck", "ck", "www", 0),
    ("a.www.ck", "www.ck", "ck", "www", 1),
    ("google.co.jp", "google.co.jp", "co.jp", "google", 0),
    ("localhost", "localhost", "", "localhost", 0),
])
def test_registered_domain(spark, psl, host, registered, suffix, label, subdomains):
    df = spark.createDataFrame([(host,)], "host string")
    row = registered_domain(df, "host", psl).first()
    assert (row.registered_domain, row.suffix, row.domain_label, row.subdomain_labels) == (
        registered, suffix, label, subdomains
    )
