import pytest
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions import features as fx
from urlguard.operators import gates
from urlguard.operators import verdict as vd

TRUSTED = [
    "https://google.com", "https://www.google.com", "https://accounts.google.com", "https://docs.google.com",
    "https://raw.githubusercontent.com", "https://login.microsoftonline.com", "https://www.amazon.com",
    "https://aws.amazon.com", "https://paypal.com", "https://usa.gov", "https://whitehouse.gov",
    "https://login.microsoft.com", "https://www.gov.uk/tax",
]
NOT_TRUSTED = [
    "https://google.com.evil-site.xyz", "https://github.com.login.badactor.ru", "https://microsoft-login.com",
    "https://g00gle.com", "https://amaz0n.com", "https://faceb00k.com", "https://paypa1.com",
    "google.com.evil.xyz", "accounts.google.com.malicious.com", "google-login.com", "go0gle.com",
    "micr0soft.com", "https://google.com:x@evil.com/",
]


@pytest.fixture(scope="module")
def allowlist(spark):
    return spark.createDataFrame([(d,) for d in fv.TRUSTED_DOMAINS], "domain string")


def test_trust_gate(spark, psl, allowlist):
    urls = spark.createDataFrame([(u,) for u in TRUSTED + NOT_TRUSTED], "url string")
    got = {r.url: r.is_trusted for r in gates.trust_gate(urls, allowlist, psl).collect()}
    assert got == {**dict.fromkeys(TRUSTED, True), **dict.fromkeys(NOT_TRUSTED, False)}
    rest = {r.url for r in gates.untrusted(urls, allowlist, psl).collect()}
    assert rest == set(NOT_TRUSTED)


def test_lookalikes_name_the_brand(spark, psl, allowlist):
    urls = spark.createDataFrame([(u,) for u in TRUSTED + NOT_TRUSTED], "url string")
    got = {(r.registered_domain, r.brand) for r in gates.lookalikes(urls, allowlist, psl).collect()}
    assert {("g00gle.com", "google"), ("paypa1.com", "paypal"), ("microsoft-login.com", "microsoft")} <= got
    assert not any(d == "google.com" for d, _ in got)


def test_block_gate_prefers_exact_match(spark, psl):
    blocklist = spark.createDataFrame(
        [("HTTP://Bad.com/x/", "a"), ("http://bad.com/x", "b"), ("http://1.2.3.4/", "b")], "url string, source string"
    )
    urls = spark.createDataFrame(
        [("http://bad.com/x",), ("http://w.bad.com/y",), ("http://good.com/",), ("http://1.2.3.4/z",)], "url string"
    )
    got = {r.url: (r.block_source, r.confidence) for r in gates.block_gate(urls, blocklist, psl).collect()}
    assert got == {
        "http://bad.com/x": ("blocklist", 0.99), "http://w.bad.com/y": ("blocklist_domain", 0.85),
        "http://good.com/": (None, 0.0), "http://1.2.3.4/z": ("blocklist_domain", 0.85),
    }
    stats = {r.metric: r.n for r in gates.blocklist_stats(blocklist, psl).collect()}
    assert stats == {"total_urls": 2, "total_domains": 2, "source:a": 1, "source:b": 2}


def test_allowlist_edits_latest_wins(spark):
    allow = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    edits = spark.createDataFrame(
        [(" B.com ", "remove", 1), ("c.com", "add", 1), ("c.com", "remove", 2), ("a.com", "remove", 1),
         ("a.com", "add", 2), ("x", "add", 3)], "domain string, action string, ts int",
    )
    assert {r.domain for r in gates.apply_allowlist_edits(allow, edits).collect()} == {"a.com"}


@pytest.mark.parametrize("p,expected", [
    (0.0, "SAFE"), (0.10, "SAFE"), (0.30, "SAFE"), (0.54, "SAFE"), (0.549, "SAFE"), (0.549999, "SAFE"),
    (0.55, "SUSPICIOUS"), (0.60, "SUSPICIOUS"), (0.70, "SUSPICIOUS"), (0.84, "SUSPICIOUS"),
    (0.849, "SUSPICIOUS"), (0.849999, "SUSPICIOUS"), (0.85, "PHISHING"), (0.90, "PHISHING"), (1.0, "PHISHING"),
])
def test_thresholds(spark, p, expected):
    assert spark.range(1).select(vd.verdict(F.lit(p)).alias("v")).first().v == expected


def test_penalty_only_lowers(spark):
    flags = [(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)]
    rows = [(*f, k / 100) for f in flags for k in range(0, 101)]
    df = spark.createDataFrame(rows, "http_failed boolean, whois_failed boolean, dns_failed boolean, p double")
    order = {"SAFE": 0, "SUSPICIOUS": 1, "PHISHING": 2}
    for r in vd.penalize(df).withColumn("plain", vd.verdict(F.col("p"))).collect():
        assert r.risk_score <= r.p * 100 + 1e-12
        assert order[r.verdict] <= order[r.plain]
        if r.plain != "PHISHING":
            assert r.verdict == r.plain and r.risk_score == r.p * 100
        assert not (r.plain == "PHISHING" and r.verdict == "SAFE")


def gated(spark, **over):
    base = {"is_trusted": False, "is_blocked": False, "confidence": 0.0, "ssrf_status": "ok",
            "verdict": "SAFE", "risk_score": 12.0}
    row = {**base, **over}
    return vd.decide(spark.createDataFrame([tuple(row.values())],
                     "is_trusted boolean, is_blocked boolean, confidence double, ssrf_status string, verdict string, risk_score double")).first()


def test_gate_precedence(spark):
    assert tuple(gated(spark, is_trusted=True, is_blocked=True, ssrf_status="blocked"))[4:6] == ("SAFE", 15.0)
    assert tuple(gated(spark, is_blocked=True, confidence=0.99))[4:6] == ("PHISHING", 95.0)
    assert tuple(gated(spark, is_blocked=True, confidence=0.85, ssrf_status="blocked"))[4:6] == ("PHISHING", 85.0)
    assert tuple(gated(spark, ssrf_status="blocked"))[4:6] == ("SUSPICIOUS", 50.0)
    assert tuple(gated(spark))[4:6] == ("SAFE", 12.0)
    assert gated(spark, verdict=None).verdict == "ERROR"


@pytest.fixture(scope="module")
def scans(spark):
    from urlguard.plans.inputs import Inputs
    from urlguard.plans.url_queries import scanned

    return scanned(Inputs(spark, "/root/testdata/sf0.001")).collect()


def test_scan_invariants(scans):
    assert scans
    assert not [r for r in scans if r.is_trusted and r.verdict != "SAFE"]
    for r in scans:
        assert len(r.explanation.positive) <= 5 and len(r.explanation.risk) <= 5
        if r.is_trusted:
            assert r.risk_score == 15.0 and r.explanation.risk == [] and r.warnings == []
            assert r.explanation.allowlist_override and r.ml_bypassed and r.features is None
        elif not r.is_blocked and r.ssrf_status == "ok":
            assert len(r.features) == 30
            assert r.explanation.analysis_complete == (not any(r.failures))


def test_restrict(spark):
    rows = spark.createDataFrame([("PHISHING",), ("SAFE",)], "verdict string")

    def under(status):
        df = spark.createDataFrame([(status,)], "calibration_status string")
        return {r.verdict: (r.restricted_verdict, r.confidence_penalty) for r in vd.restrict(rows, df).collect()}

    assert under("healthy") == {"PHISHING": ("PHISHING", 0.0), "SAFE": ("SAFE", 0.0)}
    assert under("degraded") == {"PHISHING": ("SUSPICIOUS", 0.2), "SAFE": ("SAFE", 0.2)}
    assert under("unknown") == {"PHISHING": ("SUSPICIOUS", 0.1), "SAFE": ("SAFE", 0.1)}


def test_signal_majority_tie_is_phishing(spark):
    names = fv.FEATURE_NAMES
    rows = [tuple([1] * 10 + [-1] * 10 + [0] * 10), tuple([1] * 11 + [-1] * 10 + [0] * 9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    assert [r[0] for r in df.select(fx.signal_majority()).collect()] == [-1, 1]
