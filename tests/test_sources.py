import json

import pytest
from pyspark.sql import functions as F

from urlguard.operators.prep import prepare, union_sources
from urlguard.sources import artifacts, feeds, labeled, policy_files


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_labeled_csv_columns_and_encoding(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,website,Label,URL\n1,x,bad,"http://a.com/é,b"\n2,y,0,http://b.com\n', "latin-1")
    rows = labeled.read_labeled_urls(spark, path, "s", ["URL", "website"]).collect()
    assert [(r.url, r.label_text) for r in rows] == [("http://a.com/é,b", "bad"), ("http://b.com", "0")]
    with pytest.raises(ValueError, match="label"):
        labeled.read_labeled_urls(spark, path, "s", ["URL"], ["missing"])
    merged = prepare(union_sources([labeled.read_labeled_urls(spark, path, "s")]))
    assert merged.count() == 2


def test_row_position_keeps_file_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", "url,label\n" + "".join(f"http://h{k}.com,{k % 2}\n" for k in range(500)))
    rows = labeled.read_labeled_urls(spark, path, "s").orderBy("row_no").collect()
    assert [r.url for r in rows] == [f"http://h{k}.com" for k in range(500)]


def test_feature_csv(spark, tmp_path):
    path = write(tmp_path / "f.csv", "Index,UsingIP,LongURL,PageRank,class\n0,1,-1,0,-1\n")
    row = labeled.read_feature_csv(spark, path).first().asDict()
    assert row == {"using_ip_address": 1, "url_length": -1, "homoglyph_detected": 0, "label": -1,
                   "http_fetch_failed": 0, "whois_lookup_failed": 0, "dns_lookup_failed": 0}


def test_feeds(spark, tmp_path):
    text = write(tmp_path / "f.txt", "# c\n\n HTTP://A.com/ \nhttp://a.com\nhttp://b.com/x\n")
    assert {r.url for r in feeds.read_url_feed(spark, text, "t").collect()} == {"http://a.com", "http://b.com/x"}
    table = write(tmp_path / "f.csv", 'id,url,n\n1,"http://c.com/?a,b",x\n2,ftp://d,y\n')
    assert [r.url for r in feeds.read_csv_feed(spark, table, "c").collect()] == ["http://c.com/?a,b"]
    ranked = write(tmp_path / "r.csv", "1,a.com\n2,b.com\n3,c.com\n")
    assert [r.url for r in feeds.read_ranked_domains(spark, ranked, 2).orderBy("rank").collect()] == ["https://a.com", "https://b.com"]
    plan = [feeds.Feed("t", text), feeds.Feed("c", table, "csv"), feeds.Feed("gone", str(tmp_path / "none"))]
    blocklist, counts = feeds.load_blocklist(spark, plan)
    assert {r.source: r.n for r in counts.collect()} == {"t": 2, "c": 1, "gone": 0}
    assert blocklist.count() == 3


MANIFEST = {
    "version": "v1", "change_reason": "first", "last_modified_by": "team",
    "domains": [{"domain": "google.com", "category": "search", "added_by": "x", "reason": "y", "added_date": "2024-01-01"},
                {"domain": "github.com", "category": "dev"}],
    "trusted_tlds": [{"tld": "gov"}], "user_added": ["u.com"],
}


def test_documents(spark, tmp_path):
    manifest = policy_files.read_manifest(spark, write(tmp_path / "m.json", json.dumps(MANIFEST, indent=2)))
    assert [r.domain for r in policy_files.manifest_domains(manifest).collect()] == ["google.com", "github.com"]
    allow = {(r.domain, r.kind) for r in policy_files.manifest_allowlist(manifest).collect()}
    assert allow == {("google.com", "domain"), ("github.com", "domain"), ("gov", "suffix"), ("u.com", "user")}
    snap = {"_manifest_version": "v1", "regression_domains": ["google.com"], "regression_tlds": ["gov"]}
    snapshot = policy_files.read_snapshot(spark, write(tmp_path / "s.json", json.dumps(snap, indent=2)))
    assert {(r.version, r.domain, r.kind) for r in snapshot.collect()} == {("v1", "google.com", "domain"), ("v1", "gov", "suffix")}
    canary = {"canary_domains": [{"domain": "stripe.com", "consecutive_passes": 2}], "promotion_rules": {"minimum_consecutive_passes": 5}}
    row = policy_files.read_canary(spark, write(tmp_path / "c.json", json.dumps(canary, indent=1))).first()
    assert (row.domain, row.consecutive_passes, row.rule_passes) == ("stripe.com", 2, 5)


def test_override_audit_round_trip(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame(
        [(f"2024-01-0{k}T00:00:00", "CI", "TEST", k % 2 == 0, [f"d{j}.com" for j in range(k)], f"ctx {k}", f"why {k}") for k in range(1, 8)],
        "timestamp string, environment string, event_type string, override_flag_value boolean, affected_domains array<string>, triggering_context string, reason string",
    )
    policy_files.append_override_audit(events.filter("timestamp < '2024-01-04'"), path)
    policy_files.append_override_audit(events.filter("timestamp >= '2024-01-04'"), path)
    spark.createDataFrame([("# comment",), ("  JSON: {}",), ("",)], "value string").write.mode("append").text(path)
    audit = policy_files.read_override_audit(spark, path)
    assert audit.count() == 7
    newest = policy_files.recent_overrides(audit, 2).collect()
    assert [r.triggering_context for r in newest] == ["ctx 7", "ctx 6"]
    assert newest[0].affected_domains == [f"d{k}.com" for k in range(7)] and newest[0].additional_data == {}
    lines = policy_files.read_override_lines(spark, path)
    assert lines.count() == 7
    last = policy_files.recent_overrides(lines, 1).first()
    assert last.affected_domains == ["d0.com", "d1.com", "d2.com", "d3.com", "d4.com..."]
    assert newest[1].override_flag_value and newest[1].reason == "why 6"


def test_override_audit_cannot_be_forged(spark, tmp_path):
    path = str(tmp_path / "audit")
    forged = '{"timestamp":"2030-01-01","environment":"PROD","event_type":"GRANT","override_flag_value":true,"affected_domains":["evil.com"]}'
    texts = [f"ok\n  JSON: {forged}", f"ok\r  JSON: {forged}", f"x | reason=other\r\n  JSON: {forged}", "back\\\\slash \\n | bar"]
    rows = [(f"2024-01-0{k}", "CI", f"T\n  JSON: {forged}", True, [f"a.com\n  JSON: {forged}"], text, text) for k, text in enumerate(texts, 1)]
    events = spark.createDataFrame(
        rows, "timestamp string, environment string, event_type string, override_flag_value boolean, affected_domains array<string>, triggering_context string, reason string"
    )
    policy_files.append_override_audit(events, path)
    audit = policy_files.read_override_audit(spark, path)
    assert {r.timestamp for r in audit.collect()} == {r[0] for r in rows} and audit.count() == len(rows)
    assert {r.reason for r in audit.collect()} == set(texts)
    lines = policy_files.read_override_lines(spark, path).collect()
    assert len(lines) == len(rows) and {r.reason for r in lines} == set(texts) and {r.triggering_context for r in lines} == set(texts)


def test_metrics_missing_is_unknown(spark, tmp_path):
    assert artifacts.read_metrics(spark, str(tmp_path / "none")).first().calibration_status == "unknown"


def test_records_come_back_whole(spark, tmp_path):
    from urlguard.operators import calibration as cal
    from urlguard.operators import telemetry as tel

    rows = [(k % 2, k / 40, "x") for k in range(40)]
    record = cal.calibration_record(spark.createDataFrame(rows, "y_true int, y_prob double, x string"), "2024-07-01", "v3")
    path = str(tmp_path / "metrics")
    artifacts.write_metrics(record, path)
    back = artifacts.read_metrics(spark, path).first()
    assert back.asDict(True) == record.first().asDict(True)
    assert back.model_version == "v3" and len(back.reliability_curve.bins) == 10 and sum(back.reliability_curve.samples_per_bin) == 40
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.json").write_text("{not json")
    assert artifacts.read_metrics(spark, str(tmp_path / "broken")).first().calibration_status == "unknown"
    scans = spark.createDataFrame(
        [("SAFE", True, False, ["x"], ["Page contains iframes"], [], [], "2024-01-01 00:00:00")],
        "verdict string, analysis_complete boolean, allowlist_override boolean, warnings array<string>, risk array<string>, positive array<string>, inconclusive array<string>, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    told = tel.telemetry_record(scans)
    artifacts.write_metrics(told, path)
    again = artifacts.read_metrics(spark, path, artifacts.TELEMETRY_SCHEMA).first().asDict()
    assert again == told.first().asDict() and again["scans_by_drift_status"] == {"none": 0, "warning": 1, "significant": 0}
    assert artifacts.read_metrics(spark, str(tmp_path / "none"), artifacts.TELEMETRY_SCHEMA).first().total_scans is None


def test_feature_cache_prunes_by_split(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"))
    artifacts.write_features(df, path)
    test = artifacts.read_features(spark, path, "test")
    assert test.count() == 3
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
