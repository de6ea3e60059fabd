"""Registered queries: telemetry, scan analytics, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlguard.operators import policy, telemetry as tel
from urlguard.plans.inputs import Inputs
from urlguard.plans.registry import Registry
from urlguard.plans.url_queries import CHECK_TABLES, flag, scanned

REVIEW_AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

TABLES = {
    **CHECK_TABLES,
    "ck_canary": """
SELECT c.domain, count(*) AS test_runs, count(*) FILTER (verdict <> 'PHISHING') AS passes,
  count(*) FILTER (verdict = 'PHISHING') AS failures, CAST(sum(sample_size) AS BIGINT) AS samples,
  arg_max(verdict, (ts, run_id)) AS last_verdict,
  count(*) FILTER (f.last IS NULL OR (ts, run_id) > f.last) AS consecutive_passes
FROM canary_fx c LEFT JOIN (SELECT domain, max((ts, run_id)) AS last FROM canary_fx WHERE verdict = 'PHISHING' GROUP BY domain) f
  ON c.domain = f.domain GROUP BY c.domain""",
    "ck_override": """
SELECT *, CASE
    WHEN override_type = 'PERMANENT' AND authority <> 'SECURITY_TEAM' THEN 'PERMANENT overrides require SECURITY_TEAM authority, got ' || authority
    WHEN override_type = 'PERMANENT' AND review_ticket IS NULL THEN 'PERMANENT overrides require a review_ticket reference'
    WHEN override_type = 'EMERGENCY' AND authority = 'CI_SYSTEM' THEN 'EMERGENCY overrides require SECURITY_TEAM or ON_CALL, got CI_SYSTEM'
    WHEN override_type = 'TESTING' AND authority <> 'CI_SYSTEM' THEN 'TESTING overrides are for CI_SYSTEM only, got ' || authority END AS refusal,
  CASE override_type WHEN 'EMERGENCY' THEN created_at + to_hours(least(coalesce(requested_hours, 24), 24))
    WHEN 'TESTING' THEN created_at + to_hours(least(coalesce(requested_hours, 1), 1)) END AS expires_at
FROM override_fx""",
    "ck_switch": """
SELECT event_id, ts, kind FROM policy_fx WHERE kind = 'FREEZE'
  OR (kind = 'RESUME' AND incident_id IS NOT NULL AND length(justification) >= 20)""",
    "ck_trust": """
SELECT domain, min(reviewed_at) AS added_at, max(reviewed_at) AS last_reviewed_at,
  arg_max(reviewed_by, (reviewed_at, review_id)) AS reviewed_by, max(reviewed_at) + INTERVAL 365 DAY AS due_at
FROM review_fx GROUP BY domain""",
    "ck_budget": """
SELECT kind, CASE kind WHEN 'override' THEN 3 WHEN 'canary_failure' THEN 5 WHEN 'suspicious_on_trusted' THEN 0 END AS budget, ts, event_id,
  row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS used
FROM (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'canary_failure' WHEN 'signup' THEN 'override'
        WHEN 'purchase' THEN 'suspicious_on_trusted' ELSE 'other' END AS kind FROM events) e""",
}
R = Registry(TABLES)


def text(c: str):
    return F.col(c).cast("string").alias(c)


# ------------------------------------------------------------------ 2.10 telemetry

R.add(
    "t01_telemetry",
    lambda i: tel.telemetry(i["scan_fx"]),
    """SELECT * FROM (UNPIVOT (SELECT count(*) AS total_scans, count(*) FILTER (verdict = 'SAFE') AS "verdict_SAFE",
       count(*) FILTER (verdict = 'SUSPICIOUS') AS "verdict_SUSPICIOUS", count(*) FILTER (verdict = 'PHISHING') AS "verdict_PHISHING",
       count(*) FILTER (analysis_complete) AS complete_analysis, count(*) FILTER (NOT analysis_complete) AS incomplete_analysis,
       count(*) FILTER (allowlist_override) AS allowlist_override, count(*) FILTER (NOT allowlist_override) AS no_allowlist_override,
       count(*) FILTER (len(warnings) = 0) AS drift_none, count(*) FILTER (len(warnings) > 0) AS drift_warning, CAST(0 AS BIGINT) AS drift_significant
       FROM scan_fx) ON COLUMNS(*) INTO NAME counter VALUE n) u""",
)
R.add(
    "t02_signal_totals",
    lambda i: tel.signal_totals(i["scan_fx"]),
    """SELECT CAST(sum(len(risk)) AS BIGINT) AS risk_signals, CAST(sum(len(positive)) AS BIGINT) AS positive_signals,
       CAST(sum(len(inconclusive)) AS BIGINT) AS inconclusive_signals FROM scan_fx""",
)
R.add(
    "t03_top_signals",
    lambda i: tel.top_signals(i["scan_fx"]),
    """SELECT * FROM (SELECT part, signal_type, n, row_number() OVER (PARTITION BY part ORDER BY n DESC, signal_type) AS place
       FROM (SELECT part, signal_type, count(*) AS n FROM ck_signals GROUP BY ALL) c) r WHERE place <= 10""",
)
R.add(
    "t04_summary",
    lambda i: tel.telemetry_summary(i["scan_fx"]),
    """SELECT count(*) AS total_scans, printf('%.1f%%', count(*) FILTER (verdict = 'SAFE') / count(*) * 100) AS "share_SAFE",
       printf('%.1f%%', count(*) FILTER (verdict = 'SUSPICIOUS') / count(*) * 100) AS "share_SUSPICIOUS",
       printf('%.1f%%', count(*) FILTER (verdict = 'PHISHING') / count(*) * 100) AS "share_PHISHING",
       printf('%.1f%%', count(*) FILTER (NOT analysis_complete) / count(*) * 100) AS incomplete_analysis_rate,
       printf('%.1f%%', count(*) FILTER (allowlist_override) / count(*) * 100) AS allowlist_override_rate,
       round(sum(len(risk)) / count(*), 2) AS avg_risk_signals_per_scan,
       (SELECT string_agg(signal_type, ',' ORDER BY n DESC, signal_type) FROM (SELECT signal_type, count(*) AS n FROM ck_signals
         WHERE part = 'risk' GROUP BY 1 ORDER BY n DESC, signal_type LIMIT 5) t) AS top_risk_signals FROM scan_fx""",
)
R.add(
    "t05_top3",
    lambda i: i["scan_fx"].select("scan_id", F.array_join(F.transform(tel.top3(), lambda s: F.concat_ws("=", s["impact"], s["feature"])), "|").alias("top_3")),
    """SELECT scan_id, CASE WHEN len(risk) > 0 THEN array_to_string(list_transform(risk[1:3], lambda x: 'High=' || x), '|')
       ELSE array_to_string(list_transform(positive[1:3], lambda x: 'Positive=' || x), '|') END AS top_3 FROM scan_fx""",
)
R.add(
    "t06_drift_status",
    lambda i: i["scan_fx"].select("scan_id", tel.drift_status().alias("drift")),
    "SELECT scan_id, CASE WHEN len(warnings) > 0 THEN 'warning' ELSE 'none' END AS drift FROM scan_fx",
)
R.add(
    "t07_history",
    lambda i: tel.history(i["scan_fx"], "PHISHING", "H1", page=3).select("scan_id", "ts", "url", "risk_score"),
    """SELECT scan_id, ts, url, risk_score FROM scan_fx WHERE verdict = 'PHISHING' AND contains(lower(url), 'h1')
       ORDER BY ts DESC, scan_id LIMIT 10 OFFSET 20""",
)
R.add(
    "t07_history_pages",
    lambda i: tel.history_pages(i["scan_fx"], "PHISHING", "H1"),
    """SELECT count(*) AS n, CAST(ceil(count(*) / 10) AS BIGINT) AS pages FROM scan_fx
       WHERE verdict = 'PHISHING' AND contains(lower(url), 'h1')""",
)
R.add(
    "t08_threat_regions",
    lambda i: tel.threat_regions(i["threat_fx"]),
    "SELECT region, count(*) AS n FROM threat_fx GROUP BY region ORDER BY n DESC, region LIMIT 5",
)
R.add(
    "t09_threat_filter",
    lambda i: tel.threat_filter(i["threat_fx"], ["phishing", "malware"], ["email", "sms"]).select("threat_id", "type", "attack_vector"),
    "SELECT threat_id, type, attack_vector FROM threat_fx WHERE type IN ('phishing', 'malware') AND attack_vector IN ('email', 'sms')",
)
R.add(
    "t10_live_threats",
    lambda i: tel.live_threats(i["threat_fx"]).select("threat_id", "ts", "country"),
    "SELECT threat_id, ts, country FROM threat_fx ORDER BY ts DESC, threat_id LIMIT 5",
)
R.add(
    "t11_requests_total",
    lambda i: tel.requests_total(i["scan_fx"]),
    """SELECT coalesce(verdict, 'ALL') AS verdict, coalesce(source, 'ALL') AS source, count(*) AS n
       FROM scan_fx GROUP BY GROUPING SETS ((verdict, source), (verdict), ())""",
)
R.add(
    "t12_latency_histogram",
    lambda i: tel.latency_hist(i["scan_fx"]),
    """SELECT name AS le, count(*) FILTER (latency <= bound) AS n FROM scan_fx CROSS JOIN (VALUES ('0.1', 0.1::DOUBLE), ('0.25', 0.25), ('0.5', 0.5),
       ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 'inf'::DOUBLE)) b(name, bound) GROUP BY name""",
)
R.add(
    "t13_cache_hit_rate",
    lambda i: tel.cache_hits(i["scan_fx"]).withColumn("hit_rate", F.round("hit_rate", 9)),
    """SELECT lookups, lookups - made AS hits, round((lookups - made) / lookups, 9) AS hit_rate
       FROM (SELECT count(*) AS lookups FROM scan_fx) s CROSS JOIN (
         WITH RECURSIVE k AS (SELECT DISTINCT lower(url) AS key, ts FROM scan_fx),
           a AS (SELECT key, min(ts) AS ts FROM k GROUP BY key
             UNION ALL SELECT k.key, min(k.ts) FROM a JOIN k ON k.key = a.key AND k.ts >= a.ts + INTERVAL 1 HOUR GROUP BY k.key)
         SELECT count(*) AS made FROM a) m""",
)
R.add(
    "t13_ops_counters",
    lambda i: tel.ops_counters(scanned(i)),
    """SELECT counter, count(*) AS n FROM (
         SELECT 'trusted_bypass' AS counter FROM ck_scan WHERE is_trusted
         UNION ALL SELECT CASE WHEN url_hit THEN 'match:blocklist' ELSE 'match:blocklist_domain' END FROM ck_scan WHERE url_hit OR domain_hit
         UNION ALL SELECT 'failure:http' FROM ck_scan WHERE NOT bypassed AND ssrf_status = 'ok' AND http_fetch_failed = 1
         UNION ALL SELECT 'failure:whois' FROM ck_scan WHERE NOT bypassed AND ssrf_status = 'ok' AND whois_lookup_failed = 1
         UNION ALL SELECT 'failure:dns' FROM ck_scan WHERE NOT bypassed AND ssrf_status = 'ok' AND dns_lookup_failed = 1) c GROUP BY counter""",
)
R.add(
    "t14_over_minute_limit",
    lambda i: tel.over_limit(i["scan_fx"], 1, "1 minute"),
    "SELECT caller, date_trunc('minute', ts) AS window_start, count(*) AS n FROM scan_fx GROUP BY ALL HAVING count(*) > 1",
)
R.add(
    "t14_over_hour_limit",
    lambda i: tel.over_limit(i["scan_fx"], 2, "1 hour"),
    "SELECT caller, date_trunc('hour', ts) AS window_start, count(*) AS n FROM scan_fx GROUP BY ALL HAVING count(*) > 2",
)

# ------------------------------------------------------------------ 2.11 policy

R.add(
    "g01_validate_manifests",
    lambda i: policy.validate_manifests(i["manifest_version_fx"]),
    """SELECT manifest_id, 'Manifest missing ''version'' field' AS error FROM manifest_version_fx WHERE coalesce(version, '') = ''
       UNION ALL SELECT manifest_id, 'Manifest missing or empty ''change_reason'' field' FROM manifest_version_fx WHERE trim(coalesce(change_reason, '')) = ''
       UNION ALL SELECT manifest_id, 'Manifest missing ''last_modified_by'' field' FROM manifest_version_fx WHERE coalesce(last_modified_by, '') = ''
       UNION ALL SELECT manifest_id, 'Manifest missing ''domains'' list' FROM manifest_version_fx WHERE domains IS NULL""",
)
R.add(
    "g02_manifest_gaps",
    lambda i: policy.manifest_gaps(i["manifest_fx"]),
    """SELECT domain, 'added_by' AS field FROM manifest_fx WHERE trim(coalesce(added_by, '')) = ''
       UNION ALL SELECT domain, 'reason' FROM manifest_fx WHERE trim(coalesce(reason, '')) = ''
       UNION ALL SELECT domain, 'added_date' FROM manifest_fx WHERE trim(coalesce(added_date, '')) = ''""",
)
R.add(
    "g03_manifest_diff",
    lambda i: policy.manifest_diff(i["manifest_fx"], i["snapshot_fx"]),
    """SELECT coalesce(m.domain, s.domain) AS domain, CASE WHEN s.domain IS NULL THEN 'added' WHEN m.domain IS NULL THEN 'removed' ELSE 'matched' END AS status
       FROM manifest_fx m FULL JOIN snapshot_fx s ON m.domain = s.domain""",
)
R.add(
    "g03_manifest_review",
    lambda i: policy.manifest_review(policy.manifest_diff(i["manifest_fx"], i["snapshot_fx"]), "v2", "v1").select(
        "added", "removed", "matched", flag(F.col("requires_review")).alias("requires_review"), flag(F.col("versions_match")).alias("versions_match")
    ),
    """SELECT count(*) FILTER (s.domain IS NULL) AS added, count(*) FILTER (m.domain IS NULL) AS removed,
       count(*) FILTER (m.domain = s.domain) AS matched, CAST(count(*) FILTER (s.domain IS NULL OR m.domain IS NULL) > 0 AS INT) AS requires_review,
       0 AS versions_match FROM manifest_fx m FULL JOIN snapshot_fx s ON m.domain = s.domain""",
)
R.add(
    "g04_manifest_runtime_gap",
    lambda i: policy.manifest_runtime_gap(i["manifest_fx"], i["allow_fx"]),
    """SELECT domain, 'not_in_runtime' AS gap FROM manifest_fx WHERE domain NOT IN (SELECT domain FROM allow_fx)
       UNION ALL SELECT domain, 'not_in_manifest' FROM allow_fx WHERE domain NOT IN (SELECT domain FROM manifest_fx)""",
)
R.add(
    "g05_check_overrides",
    lambda i: policy.check_overrides(i["override_fx"]).select("override_id", flag(F.col("allowed")).alias("allowed"), "refusal"),
    "SELECT override_id, CAST(refusal IS NULL AS INT) AS allowed, refusal FROM ck_override",
)
R.add(
    "g06_override_expiry",
    lambda i: policy.override_expiry(i["override_fx"]).select("override_id", "expires_at"),
    "SELECT override_id, expires_at FROM ck_override",
)
R.add(
    "g07_active_overrides",
    lambda i: policy.active_overrides(i["override_fx"], i["override_fx"].filter("revoked"), REVIEW_AS_OF).select("override_id", "expires_at"),
    f"""SELECT override_id, expires_at FROM ck_override WHERE refusal IS NULL AND NOT revoked AND created_at <= TIMESTAMP '{REVIEW_AS_OF}'
        AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{REVIEW_AS_OF}')""",
)
R.add(
    "g08_budget_breaches",
    lambda i: policy.budget_breaches(i["override_fx"]).select("override_id", "tenant", "used"),
    """SELECT override_id, tenant, used FROM (SELECT override_id, tenant, count(*) OVER (PARTITION BY tenant ORDER BY created_at
         RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS used FROM override_fx) o WHERE used > 3""",
)
R.add(
    "g08_first_breach",
    lambda i: policy.first_breach(policy.budget_breaches(i["scan_fx"], 5, 3600, "source", "ts"), "source", "ts"),
    """SELECT source, min(ts) AS frozen_at FROM (SELECT source, ts, count(*) OVER (PARTITION BY source ORDER BY ts
         RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM scan_fx) o WHERE used > 5 GROUP BY source""",
)
R.add(
    "g09_canary_signal",
    lambda i: policy.canary_signal(i["canary_fx"]).withColumn("pass_rate", F.round("pass_rate", 9)),
    """SELECT domain, test_runs, passes, failures, samples, round(passes / test_runs, 9) AS pass_rate, last_verdict FROM ck_canary""",
)
R.add(
    "g10_canary_streak",
    lambda i: policy.canary_streak(i["canary_fx"]),
    "SELECT domain, consecutive_passes FROM ck_canary",
)
R.add(
    "g11_promotable",
    lambda i: policy.promotable(i["canary_fx"]).select("domain", flag(F.col("eligible")).alias("eligible"), "reason"),
    """SELECT domain, CAST(test_runs >= 5 AND samples >= 100 AND consecutive_passes >= 5 AND failures = 0 AS INT) AS eligible,
       CASE WHEN test_runs < 5 OR samples < 100 THEN 'Insufficient signal: ' || test_runs || '/5 runs, ' || samples || '/100 samples'
         WHEN consecutive_passes < 5 THEN 'Insufficient consecutive passes: ' || consecutive_passes || '/5'
         WHEN failures > 0 THEN printf('Pass rate %.1f%% < 100%% required', passes / test_runs * 100) ELSE 'All promotion criteria met' END AS reason FROM ck_canary""",
)


def approvals(i: Inputs) -> DataFrame:
    """Reviews serve as approvals; some lack a ticket."""
    return i["review_fx"].groupBy("domain").agg(
        F.max_by("reviewed_by", "review_id").alias("approved_by"),
        F.max_by(F.when(F.col("review_id") % 3 != 0, F.concat(F.lit("SEC-"), F.col("review_id").cast("string"))), "review_id").alias("review_ticket"),
    )


R.add(
    "g12_promotions",
    lambda i: policy.promotions(i["canary_fx"], approvals(i)).select("domain", "approved_by", "review_ticket", "test_runs"),
    """SELECT c.domain, a.reviewed_by AS approved_by, 'SEC-' || a.review_id AS review_ticket, test_runs FROM ck_canary c
       JOIN review_fx a ON c.domain = a.domain AND a.review_id = (SELECT max(review_id) FROM review_fx r WHERE r.domain = c.domain)
       WHERE test_runs >= 5 AND samples >= 100 AND consecutive_passes >= 5 AND failures = 0 AND a.review_id % 3 <> 0""",
)


def safety_events(i: Inputs) -> DataFrame:
    return i.sql(
        """SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'canary_failure' WHEN 'signup' THEN 'override'
           WHEN 'purchase' THEN 'suspicious_on_trusted' ELSE 'other' END AS kind FROM events"""
    )


R.add(
    "g13_safety_budget",
    lambda i: policy.safety_budget(safety_events(i)).select("kind", "budget", "used", "exceeded_at", flag(F.col("exceeded")).alias("exceeded")),
    """SELECT kind, budget, max(used) AS used, min(ts) FILTER (used > budget) AS exceeded_at,
       CAST(coalesce(max(used) > budget, false) AS INT) AS exceeded FROM ck_budget GROUP BY kind, budget""",
)
R.add(
    "g14_freeze_state",
    lambda i: policy.freeze_state(i["policy_fx"], EVENTS_AS_OF).select(flag(F.col("is_frozen")).alias("is_frozen"), "since", "event_id"),
    f"""SELECT CAST(kind = 'FREEZE' AS INT) AS is_frozen, ts AS since, event_id FROM ck_switch WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}'
        ORDER BY ts DESC, event_id DESC LIMIT 1""",
)
R.add(
    "g15_frozen_actions",
    lambda i: policy.frozen_actions(i["policy_fx"]),
    """SELECT a.event_id, a.ts FROM (SELECT * FROM policy_fx WHERE kind = 'ACTION') a ASOF JOIN ck_switch s ON a.ts >= s.ts
       WHERE s.kind = 'FREEZE'""",
)
R.add(
    "g16_action_allowed",
    lambda i: policy.action_allowed(
        i.sql("""SELECT event_id, CASE event_type WHEN 'view' THEN 'HEALTHY' WHEN 'click' THEN 'UNKNOWN' ELSE 'DEGRADED' END AS calibration_status,
                 CASE event_id % 4 WHEN 0 THEN 'canary_promotion' WHEN 1 THEN 'allowlist_expansion' WHEN 2 THEN 'permanent_override' ELSE 'emergency_override' END AS action
                 FROM events""")
    ).select("event_id", flag(F.col("allowed")).alias("allowed"), "reason"),
    """SELECT event_id, CAST(s = 'HEALTHY' OR (s = 'DEGRADED' AND a = 'emergency_override') AS INT) AS allowed,
       CASE WHEN s = 'HEALTHY' THEN 'Calibration healthy, action allowed'
         WHEN a <> 'emergency_override' THEN 'Action ''' || a || ''' forbidden: Calibration status is ' || s
         WHEN s = 'UNKNOWN' THEN 'Action ''' || a || ''' requires human review: Calibration status UNKNOWN'
         ELSE 'Warning: Calibration is ' || s END AS reason
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'HEALTHY' WHEN 'click' THEN 'UNKNOWN' ELSE 'DEGRADED' END AS s,
         ['canary_promotion', 'allowlist_expansion', 'permanent_override', 'emergency_override'][event_id % 4 + 1] AS a FROM events) e""",
)
R.add(
    "g17_trust_records",
    lambda i: policy.trust_records(i["review_fx"]),
    "SELECT domain, added_at, last_reviewed_at, reviewed_by, 'full' AS trust_level, due_at FROM ck_trust",
)
R.add(
    "g18_revalidation_due",
    lambda i: policy.revalidation_due(policy.trust_records(i["review_fx"]), REVIEW_AS_OF).select(
        "domain", "days_left", flag(F.col("overdue")).alias("overdue")
    ),
    f"""SELECT domain, greatest(date_diff('day', TIMESTAMP '{REVIEW_AS_OF}', due_at), 0) AS days_left,
        CAST(TIMESTAMP '{REVIEW_AS_OF}' > due_at AS INT) AS overdue FROM ck_trust
        WHERE date_diff('day', TIMESTAMP '{REVIEW_AS_OF}', due_at) <= 30""",
)
R.add(
    "g19_demote",
    lambda i: policy.demote(
        policy.trust_records(i["review_fx"]),
        policy.revalidation_due(policy.trust_records(i["review_fx"]), REVIEW_AS_OF).filter("overdue"),
    ).select("domain", "trust_level"),
    f"SELECT domain, CASE WHEN due_at < TIMESTAMP '{REVIEW_AS_OF}' THEN 'probation' ELSE 'full' END AS trust_level FROM ck_trust",
)
R.add(
    "g20_open_reviews",
    lambda i: policy.open_reviews(
        i["override_fx"].select(F.col("override_id").alias("review_id"), "override_type"),
        i["override_fx"].filter("revoked").select(F.col("override_id").alias("review_id")),
    ),
    "SELECT override_id AS review_id, override_type FROM override_fx WHERE NOT revoked",
)
R.add(
    "g21_safety_status",
    lambda i: policy.safety_status(safety_events(i)).select("kind", "usage", flag(F.col("exceeded")).alias("exceeded")),
    """SELECT kind, max(used) || '/' || coalesce(CAST(budget AS VARCHAR), 'none') AS usage, CAST(coalesce(max(used) > budget, false) AS INT) AS exceeded FROM ck_budget GROUP BY kind, budget""",
)
