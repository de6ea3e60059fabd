"""Registered queries: sources and sinks.

The given tables are written as feeds, CSV files, documents and logs in the shared work
folder and read back through the sources, so every read grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.operators import calibration as cal
from urlguard.operators import prep
from urlguard.operators import telemetry as tel
from urlguard.plans.data_queries import TABLES as DATA_TABLES
from urlguard.plans.data_queries import STATUS, WARNING, balanced, deduped, labelled_features, prepared, rounded
from urlguard.plans.inputs import AS_OF, Inputs
from urlguard.plans.registry import Registry
from urlguard.plans.url_queries import flag, scanned
from urlguard.session import new_folder
from urlguard.sources import artifacts, feeds, labeled, policy_files

TABLES = {
    **DATA_TABLES,
    "ck_audit": """
SELECT CAST(o_orderdate AS VARCHAR) AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'PROD' WHEN 'O' THEN 'CI' ELSE 'LOCAL' END AS environment,
  o_orderpriority AS event_type, o_orderkey % 2 = 0 AS override_flag_value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'order' || chr(10) || '  JSON: {"timestamp":"2030-01-01","reason":"forged"} | reason=' ELSE 'order ' END
    || CAST(o_orderkey AS STRING) AS reason, 'ctx' || CAST(o_custkey AS STRING) AS triggering_context, o_orderkey
FROM orders""",
}
R = Registry(TABLES)


def written_text(i: Inputs, name: str, lines: DataFrame) -> str:
    path = new_folder(i.spark, name)
    lines.write.text(path)
    return path


LINES = """SELECT CASE page_id % 4 WHEN 0 THEN '# comment ' || url WHEN 1 THEN '  ' || upper(url) || '/ ' ELSE url END AS value FROM pages
  UNION ALL SELECT '' FROM pages UNION ALL SELECT url FROM pages"""


@R.query("s01_labeled_csv", "SELECT url, label_text, source FROM labeled_fx WHERE source = 'A'")
def _labeled(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "labeled")
    rows = i["labeled_fx"].filter("source = 'A'")
    rows.select(F.col("row_no").alias("id"), F.col("url").alias("URL"), F.col("label_text").alias("result")).write.option(
        "header", True
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return labeled.read_labeled_urls(i.spark, path, "A").select("url", "label_text", "source")


OLD = {new: old for old, new in fv.CSV_COLUMNS.items()}


@R.query(
    "s03_feature_csv",
    f"SELECT {', '.join(fv.FEATURE_NAMES)}, label, 0 AS http_fetch_failed, 0 AS whois_lookup_failed, 0 AS dns_lookup_failed FROM ck_labelled",
)
def _feature_csv(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "features-csv")
    labelled_features(i).select(
        F.col("page_id").alias("Index"), *[F.col(n).alias(OLD[n]) for n in (*fv.FEATURE_NAMES, "label")]
    ).write.option("header", True).csv(path)
    return labeled.read_feature_csv(i.spark, path)


@R.query(
    "s04_url_feed",
    "SELECT DISTINCT regexp_replace(lower(url), '/$', '') AS url, 'a' AS source FROM pages "
    "UNION SELECT lower(url), 'a' FROM pages WHERE page_id % 4 = 1",
)
def _url_feed(i: Inputs) -> DataFrame:
    return feeds.read_url_feed(i.spark, written_text(i, "feed", i.sql(LINES)), "a")


@R.query("s05_csv_feed", "SELECT DISTINCT regexp_replace(lower(url), '/$', '') AS url, 'csv' AS source FROM pages")
def _csv_feed(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "csv-feed")
    i.sql(
        "SELECT page_id, url, 'a,\"b\"' AS note FROM pages UNION ALL SELECT page_id, 'ftp://x', 'bad' FROM pages"
    ).write.option("header", True).csv(path)
    return feeds.read_csv_feed(i.spark, path, "csv")


@R.query(
    "s06_ranked_domains",
    "SELECT CAST(c_custkey AS INT) AS rank, 'https://' || lower(replace(c_name, '#', '-')) || '.test' AS url FROM customer WHERE c_custkey <= 100",
)
def _ranked(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "ranked")
    i.sql("SELECT c_custkey, lower(replace(c_name, '#', '-')) || '.test' FROM customer").write.csv(path)
    return feeds.read_ranked_domains(i.spark, path, 100)


@R.query(
    "s07_blocklist_feeds",
    """SELECT source, count(DISTINCT regexp_replace(lower(url), '/$', '')) AS n FROM block_fx GROUP BY source
       UNION ALL SELECT 'gone', 0""",
)
def _blocklist(i: Inputs) -> DataFrame:
    plan = []
    for name in ("a", "b"):
        rows = i["block_fx"].filter(F.col("source") == name)
        plan.append(feeds.Feed(name, written_text(i, f"block-{name}", rows.select(F.col("url").alias("value")))))
    plan.append(feeds.Feed("gone", f"{plan[0].path}-missing"))
    return feeds.load_blocklist(i.spark, plan)[1]


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def written_documents(i: Inputs, name: str, rows: DataFrame) -> str:
    """An archive of documents, one JSON line each."""
    path = new_folder(i.spark, name)
    rows.write.json(path)
    return path


@R.query(
    "s08_manifest",
    f"""SELECT 'v' || page_id AS version, {HOST} AS domain, 'domain' AS kind FROM pages
        UNION ALL SELECT 'v' || page_id, 'gov', 'suffix' FROM pages
        UNION ALL SELECT 'v' || page_id, 'user' || page_id || '.test', 'user' FROM pages WHERE page_id % 2 = 0""",
)
def _manifest(i: Inputs) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    number = F.col("page_id").cast("string")
    path = written_documents(
        i, "manifest",
        i["pages"].select(
            F.concat(F.lit("v"), number).alias("version"),
            F.lit("seen").alias("change_reason"),
            F.array(F.struct(host.alias("domain"), F.lit("page").alias("category"))).alias("domains"),
            F.array(F.struct(F.lit("gov").alias("tld"))).alias("trusted_tlds"),
            F.when(F.col("page_id") % 2 == 0, F.array(F.concat(F.lit("user"), number, F.lit(".test")))).alias("user_added"),
        ),
    )
    manifest = policy_files.read_manifest(i.spark, path, lines=True)
    return policy_files.manifest_allowlist(manifest)


@R.query(
    "s09_snapshot",
    f"""SELECT 'v' || page_id AS version, {HOST} AS domain, 'domain' AS kind FROM pages
        UNION ALL SELECT 'v' || page_id, 'gov.uk', 'suffix' FROM pages""",
)
def _snapshot(i: Inputs) -> DataFrame:
    path = written_documents(
        i, "snapshot",
        i["pages"].select(
            F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("_manifest_version"),
            F.array(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("regression_domains"),
            F.array(F.lit("gov.uk")).alias("regression_tlds"),
        ),
    )
    return policy_files.read_snapshot(i.spark, path, lines=True)


@R.query(
    "s09_canary",
    "SELECT domain, reviewed_by AS proposed_by, CAST(review_id % 9 AS INT) AS consecutive_passes, 5 AS rule_passes FROM review_fx",
)
def _canary(i: Inputs) -> DataFrame:
    entry = F.struct(
        "domain", F.col("reviewed_by").alias("proposed_by"), (F.col("review_id") % 9).alias("consecutive_passes")
    )
    path = written_documents(
        i, "canary",
        i["review_fx"].select(
            F.array(entry).alias("canary_domains"),
            F.struct(F.lit(5).alias("minimum_consecutive_passes")).alias("promotion_rules"),
        ),
    )
    return policy_files.read_canary(i.spark, path, lines=True).select(
        "domain", "proposed_by", "consecutive_passes", "rule_passes"
    )


@R.query("s14_feature_cache", "SELECT s.split, count(*) AS n, CAST(sum(length(canonical_url)) AS BIGINT) AS chars FROM ck_split s GROUP BY s.split")
def _cache(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "cache")
    artifacts.write_features(prep.split(deduped(i)), path)
    return artifacts.read_features(i.spark, path).groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.length("canonical_url")).alias("chars")
    )


@R.query("s15_merged_csv", "SELECT url, CAST(label AS VARCHAR) AS label, source FROM ck_dedup")
def _merged(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "merged")
    artifacts.write_merged(deduped(i), path)
    return i.spark.read.option("header", True).csv(path)


R.add(
    "s18_dataset_stats",
    lambda i: dataset_stats(i),
    """SELECT 'source:' || source AS metric, count(*) AS n FROM ck_prep GROUP BY source
       UNION ALL SELECT 'total_before_dedup', count(*) FROM ck_prep
       UNION ALL SELECT 'duplicates_removed', count(*) - count(DISTINCT canonical_url) FROM ck_prep
       UNION ALL SELECT 'conflicts_resolved', count(*) FROM (SELECT 1 FROM ck_prep GROUP BY canonical_url HAVING min(label) < max(label)) c
       UNION ALL SELECT 'before:' || label, n FROM ck_quota UNION ALL SELECT 'after:' || label, quota FROM ck_quota
       UNION ALL SELECT 'split:' || split, count(*) FROM ck_split GROUP BY split""",
)


def listed(name: str, scale: float = 1.0):
    """An array of the curve as text, in whole parts of 1 / scale."""
    values = F.transform(f"reliability_curve.{name}", lambda v: F.round(v * scale).cast("long").cast("string"))
    return F.array_join(values, ",").alias(name)


@R.query(
    "s19_metrics_json",
    f"""SELECT {STATUS} AS calibration_status, round(brier, 4) AS brier_score, round(err, 4) AS calibration_error, n AS sample_count,
       '{AS_OF}' AS timestamp, 'v7' AS model_version, {WARNING} AS warnings, 0.25 AS brier_score_healthy_max,
       0.35 AS brier_score_degraded_max, 0.1 AS calibration_error_healthy_max, 0.2 AS calibration_error_degraded_max,
       0.01 AS collapse_variance_threshold, c.* FROM ck_cal CROSS JOIN (
         SELECT string_agg(CAST(CAST(round(upper * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS bins, string_agg(CAST(CAST(round(observed * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS observed_frequency,
           string_agg(CAST(CAST(round(expected * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS expected_confidence, string_agg(CAST(samples AS VARCHAR), ',' ORDER BY bin) AS samples_per_bin
         FROM ck_bins) c""",
)
def _metrics(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "metrics")
    artifacts.write_metrics(cal.calibration_record(i["pred_fx"], AS_OF, "v7"), path)
    named = F.when(F.get("warnings", F.lit(0)).startswith("Probability"), "collapse").when(
        F.get("warnings", F.lit(0)).startswith("Extreme"), "extreme"
    )
    return artifacts.read_metrics(i.spark, path).select(
        "calibration_status", "brier_score", "calibration_error", "sample_count", "timestamp", "model_version",
        F.coalesce(named, F.array_join("warnings", "|")).alias("warnings"), "thresholds.*",
        *[listed(name, 1e9) for name in ("bins", "observed_frequency", "expected_confidence")], listed("samples_per_bin"),
    )


@R.query(
    "s19_telemetry_json",
    """SELECT count(*) AS total_scans, count(*) FILTER (verdict = 'PHISHING') AS phishing, count(*) FILTER (verdict = 'SAFE') AS safe,
       count(*) FILTER (analysis_complete) AS scans_with_complete_analysis, count(*) FILTER (NOT analysis_complete) AS scans_with_incomplete_analysis,
       count(*) FILTER (allowlist_override) AS scans_with_allowlist_override, count(*) FILTER (NOT allowlist_override) AS scans_without_allowlist_override,
       count(*) FILTER (len(warnings) > 0) AS drifting, CAST(0 AS BIGINT) AS significant,
       CAST(sum(len(risk)) AS BIGINT) AS total_risk_signals, CAST(sum(len(positive)) AS BIGINT) AS total_positive_signals,
       CAST(sum(len(inconclusive)) AS BIGINT) AS total_inconclusive_signals,
       strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS collection_start, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_updated,
       (SELECT count(*) FROM (SELECT unnest(risk) AS s FROM scan_fx) x WHERE contains(lower(s), 'iframe')) AS iframes FROM scan_fx""",
)
def _telemetry(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "telemetry")
    artifacts.write_metrics(tel.telemetry_record(i["scan_fx"]), path)
    plain = [f.split()[0] for f in artifacts.TELEMETRY_SCHEMA.replace("\n", " ").split(", ") if "BIGINT" in f and "MAP" not in f and ">" not in f]
    return artifacts.read_metrics(i.spark, path, artifacts.TELEMETRY_SCHEMA).select(
        *plain, F.col("scans_by_verdict")["PHISHING"].alias("phishing"), F.col("scans_by_verdict")["SAFE"].alias("safe"),
        F.col("scans_by_drift_status")["warning"].alias("drifting"), F.col("scans_by_drift_status")["significant"].alias("significant"),
        F.col("top_risk_signals")["iframe_detected"].alias("iframes"), "collection_start", "last_updated",
    )


@R.query(
    "s20_verdict_audit",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","verdict":"' || verdict || '","drift":"'
         || CASE WHEN len(warnings) > 0 THEN 'warning' ELSE 'none' END || '","top_3":[' ||
         CASE WHEN len(risk) > 0 THEN array_to_string(list_transform(risk[1:3], lambda x: '{"feature":"' || x || '","impact":"High"}'), ',')
           ELSE array_to_string(list_transform(positive[1:3], lambda x: '{"feature":"' || x || '","impact":"Positive"}'), ',') END || ']}' AS value FROM scan_fx""",
)
def _verdict_audit(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "audit")
    artifacts.append_verdict_audit(i["scan_fx"], path)
    return i.spark.read.text(path).select(F.col("day").cast("string").alias("day"), "value")


def dataset_stats(i: Inputs) -> DataFrame:
    before, after = balanced(i)
    return artifacts.dataset_stats(prepared(i), before, after, prep.split(before))


def audit_events(i: Inputs) -> DataFrame:
    return i.sql(
        """SELECT CAST(o_orderdate AS STRING) AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'PROD' WHEN 'O' THEN 'CI' ELSE 'LOCAL' END AS environment,
           o_orderpriority AS event_type, o_orderkey % 2 = 0 AS override_flag_value,
           split(repeat('d.test,', CAST(o_orderkey % 8 AS INT)) || 'z.test', ',') AS affected_domains,
           'ctx' || CAST(o_custkey AS STRING) AS triggering_context,
           CASE WHEN o_orderkey % 3 = 0 THEN 'order' || char(10) || '  JSON: {{"timestamp":"2030-01-01","reason":"forged"}} | reason=' ELSE 'order ' END
             || CAST(o_orderkey AS STRING) AS reason,
           map('customer', CAST(o_custkey AS STRING)) AS additional_data FROM orders"""
    )


def audit_log(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "override-audit")
    policy_files.append_override_audit(audit_events(i), path)
    return policy_files.read_override_audit(i.spark, path)


R.add(
    "s21_override_audit",
    lambda i: audit_log(i).select(
        "reason", "environment", "event_type", "triggering_context",
        flag(F.col("override_flag_value")).alias("flag"), F.size("affected_domains").alias("n_domains"),
        F.element_at("affected_domains", -1).alias("last_domain"), F.col("additional_data")["customer"].alias("customer"),
    ),
    """SELECT reason, environment, event_type, triggering_context, CAST(override_flag_value AS INT) AS flag,
       CAST(o_orderkey % 8 + 1 AS INT) AS n_domains, 'z.test' AS last_domain, substr(triggering_context, 4) AS customer FROM ck_audit""",
)
R.add(
    "s22_recent_overrides",
    lambda i: policy_files.recent_overrides(audit_log(i), 10).select("event_type", "reason"),
    "SELECT event_type, reason FROM ck_audit ORDER BY timestamp DESC, event_type, reason LIMIT 10",
)


@R.query(
    "s23_scan_log",
    """SELECT verdict, count(*) AS n, CAST(sum(CAST(is_trusted AS INT)) AS BIGINT) AS trusted FROM ck_scan GROUP BY verdict""",
)
def _scan_log(i: Inputs) -> DataFrame:
    path = new_folder(i.spark, "scan-log")
    artifacts.write_scan_log(scanned(i).withColumn("scan_day", F.lit(AS_OF).cast("date")), path)
    return artifacts.read_scan_log(i.spark, path).groupBy("verdict").agg(
        F.count("*").alias("n"), F.sum(F.col("is_trusted").cast("int")).alias("trusted")
    )
