import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from urlguard.operators import policy

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_rolling_count_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if rng.random() < 0.6 else f"t{rng.randrange(5)}", at(rng.randrange(0, 6000))) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, tenant string, ts timestamp")
    got = {r.id: r.used for r in policy.rolling_count(df, "tenant", "ts", 86_400).collect()}
    for k, tenant, ts in rows:
        used = sum(1 for _, t, s in rows if t == tenant and ts - timedelta(hours=24) <= s <= ts)
        assert got[k] == used


def test_frozen_actions_against_replay(spark):
    rng = random.Random(4)
    rows = []
    for k in range(800):
        kind = rng.choices(["ACTION", "FREEZE", "RESUME"], [8, 1, 1])[0]
        rows.append((k, at(rng.randrange(0, 3000)), kind, rng.choice([None, "", "INC-1"]),
                     rng.choice(["short", "long enough to be a justification"])))
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, kind string, incident_id string, justification string")
    frozen, want = False, set()
    for k, ts, kind, incident, why in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "FREEZE":
            frozen = True
        elif kind == "RESUME" and incident and len(why) >= 20:
            frozen = False
        elif kind == "ACTION" and frozen:
            want.add(k)
    assert {r.event_id for r in policy.frozen_actions(df).collect()} == want
    state = policy.freeze_state(df, "2024-02-01").first()
    assert state.is_frozen == frozen


def test_streak_and_promotion(spark):
    rows = [("a", k, "SAFE", 20) for k in range(6)] + [("b", k, "PHISHING" if k == 3 else "SAFE", 50) for k in range(9)]
    rows += [("c", k, "SAFE", 1) for k in range(9)] + [("d", k, "PHISHING" if k == 8 else "SAFE", 50) for k in range(9)]
    df = spark.createDataFrame(
        [(d, at(k), k, v, s) for d, k, v, s in rows], "domain string, ts timestamp, run_id int, verdict string, sample_size int"
    )
    streak = {r.domain: r.consecutive_passes for r in policy.canary_streak(df).collect()}
    assert streak == {"a": 6, "b": 5, "c": 9, "d": 0}
    got = {r.domain: (r.eligible, r.reason) for r in policy.promotable(df).collect()}
    assert got["a"] == (True, "All promotion criteria met")
    assert got["b"] == (False, "Pass rate 88.9% < 100% required")
    assert got["c"] == (False, "Insufficient signal: 9/5 runs, 9/100 samples")
    assert got["d"] == (False, "Insufficient consecutive passes: 0/5")
    approvals = spark.createDataFrame([("a", "x", " ")], "domain string, approved_by string, review_ticket string")
    assert policy.promotions(df, approvals).count() == 0
    assert policy.promotions(df, approvals.withColumn("review_ticket", F.lit("T-1"))).count() == 1


@pytest.mark.parametrize("kind,authority,ticket,allowed", [
    ("PERMANENT", "SECURITY_TEAM", "T", True), ("PERMANENT", "SECURITY_TEAM", None, False),
    ("PERMANENT", "ON_CALL", "T", False), ("EMERGENCY", "ON_CALL", None, True),
    ("EMERGENCY", "SECURITY_TEAM", None, True), ("EMERGENCY", "CI_SYSTEM", "T", False),
    ("TESTING", "CI_SYSTEM", None, True), ("TESTING", "ON_CALL", "T", False),
])
def test_override_authority(spark, kind, authority, ticket, allowed):
    df = spark.createDataFrame([(kind, authority, ticket)], "override_type string, authority string, review_ticket string")
    row = policy.check_overrides(df).first()
    assert row.allowed == allowed and (row.refusal is None) == allowed


def test_override_expiry_caps(spark):
    rows = [("PERMANENT", 5, None), ("EMERGENCY", 99, 24), ("EMERGENCY", 3, 3), ("EMERGENCY", None, 24), ("TESTING", 5, 1)]
    df = spark.createDataFrame([(k, h, START) for k, h, _ in rows], "override_type string, requested_hours int, created_at timestamp")
    got = [r.expires_at for r in policy.override_expiry(df).collect()]
    assert got == [None if h is None else START + timedelta(hours=h) for _, _, h in rows]


def test_budget_refuses_the_fourth(spark):
    df = spark.createDataFrame([(k, "t", at(k * 60)) for k in range(5)], "override_id int, tenant string, created_at timestamp")
    assert {r.override_id for r in policy.budget_breaches(df).collect()} == {3, 4}
    assert policy.first_breach(policy.budget_breaches(df)).first().frozen_at == at(180)


def test_safety_budget(spark):
    rows = [(k, at(k), "canary_failure") for k in range(6)] + [(9, at(9), "suspicious_on_trusted"), (10, at(1), "override")]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, kind string")
    got = {r.kind: (r.used, r.exceeded_at) for r in policy.safety_budget(df).collect()}
    assert got == {"canary_failure": (6, at(5)), "suspicious_on_trusted": (1, at(9)), "override": (1, None)}
    usage = {r.kind: r.usage for r in policy.safety_status(df).collect()}
    assert usage["canary_failure"] == "6/5"


def test_revalidation(spark):
    reviews = spark.createDataFrame(
        [("old", datetime(2022, 1, 1), 1, "x"), ("soon", datetime(2023, 1, 20), 2, "x"), ("fine", datetime(2023, 12, 1), 3, "x")],
        "domain string, reviewed_at timestamp, review_id int, reviewed_by string",
    )
    records = policy.trust_records(reviews)
    got = {r.domain: (r.days_left, r.overdue) for r in policy.revalidation_due(records, "2024-01-01").collect()}
    assert got == {"old": (0, True), "soon": (19, False)}
    levels = {r.domain: r.trust_level for r in policy.demote(records, spark.createDataFrame([("old",)], "domain string")).collect()}
    assert levels == {"old": "probation", "soon": "full", "fine": "full"}


def test_manifest_diff(spark):
    m = spark.createDataFrame([("a",), ("b",), ("b",)], "domain string")
    s = spark.createDataFrame([("b",), ("c",)], "domain string")
    diff = policy.manifest_diff(m, s)
    assert {tuple(r) for r in diff.collect()} == {("a", "added"), ("b", "matched"), ("c", "removed")}
    review = policy.manifest_review(diff, "v1", "v1").first()
    assert review.requires_review and review.versions_match and review.matched == 1


def test_action_coupling(spark):
    cases = [("HEALTHY", "canary_promotion", True), ("DEGRADED", "canary_promotion", False),
             ("DEGRADED", "other", True), ("UNKNOWN", "other", False), ("UNKNOWN", "permanent_override", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "calibration_status string, action string")
    assert [r.allowed for r in policy.action_allowed(df).collect()] == [c[2] for c in cases]
