"""Policy rules as queries over event tables. State is derived, never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.text import percent
from urlguard.functions.times import micros
from urlguard.operators.lookup import lookup
from urlguard.operators.timelines import carried_forward, in_slices


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# ------------------------------------------------------------------ manifests

# --- fixed values: messages of the manifest rules -------------------------------------
MANIFEST_ERRORS = {
    "version": "Manifest missing 'version' field",
    "change_reason": "Manifest missing or empty 'change_reason' field",
    "last_modified_by": "Manifest missing 'last_modified_by' field",
    "domains": "Manifest missing 'domains' list",
}


def validate_manifests(df: DataFrame, key: str = "manifest_id") -> DataFrame:
    """One row per manifest and broken rule."""
    broken = {
        "version": F.coalesce(F.col("version"), F.lit("")) == "",
        "change_reason": blank(F.col("change_reason")),
        "last_modified_by": F.coalesce(F.col("last_modified_by"), F.lit("")) == "",
        "domains": F.col("domains").isNull(),
    }
    errors = F.array_compact(F.array(*[F.when(broken[k], t) for k, t in MANIFEST_ERRORS.items()]))
    return df.select(key, F.explode(errors).alias("error"))


def manifest_gaps(df: DataFrame) -> DataFrame:
    """One row per domain entry and missing governance field."""
    fields = ("added_by", "reason", "added_date")
    missing = F.array_compact(F.array(*[F.when(blank(F.col(f)), f) for f in fields]))
    return df.select("domain", F.explode(missing).alias("field"))


def manifest_diff(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each domain with added, removed or matched, from one shuffle of both lists."""
    sides = manifest.select("domain", F.lit(1).alias("m"), F.lit(0).alias("s")).unionByName(
        snapshot.select("domain", F.lit(0).alias("m"), F.lit(1).alias("s"))
    )
    return sides.groupBy("domain").agg(F.max("m").alias("m"), F.max("s").alias("s")).select(
        "domain",
        F.when(F.col("s") == 0, "added").when(F.col("m") == 0, "removed").otherwise("matched").alias("status"),
    )


def manifest_review(
    diff: DataFrame, manifest_version: str | None, snapshot_version: str | None
) -> DataFrame:
    """One row: counts, whether the versions match and whether a review is due."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return diff.agg(
        count("added").alias("added"), count("removed").alias("removed"),
        count("matched").alias("matched"),
        (count("added") + count("removed") > 0).alias("requires_review"),
    ).withColumn("versions_match", F.lit(manifest_version == snapshot_version))


def manifest_runtime_gap(manifest: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Domains on one side only."""
    diff = manifest_diff(manifest, allowlist)
    return diff.filter("status <> 'matched'").select(
        "domain",
        F.when(F.col("status") == "added", "not_in_runtime").otherwise("not_in_manifest").alias("gap"),
    )


# ------------------------------------------------------------------ overrides


# --- fixed values: why an override is refused ---------------------------------------------
NOT_PERMITTED = {
    "PERMANENT": "PERMANENT overrides require SECURITY_TEAM authority, got ",
    "EMERGENCY": "EMERGENCY overrides require SECURITY_TEAM or ON_CALL, got ",
    "TESTING": "TESTING overrides are for CI_SYSTEM only, got ",
}
NO_TICKET = "PERMANENT overrides require a review_ticket reference"


def check_overrides(requests: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``refusal`` by type, authority and review ticket.

    The rules are four fixed rows, so they are a CASE over the request.
    """
    kind, by = F.col("override_type"), F.col("authority")
    permitted = F.lit(False)
    ticket_needed = F.lit(False)
    for rule_kind, rule_by, ticket in fv.OVERRIDE_RULES:
        match = (kind == rule_kind) & (by == rule_by)
        permitted = permitted | match
        if ticket:
            ticket_needed = ticket_needed | match
    no_ticket = F.coalesce(F.col("review_ticket"), F.lit("")) == ""
    text = F.lit(NOT_PERMITTED["TESTING"])
    for rule_kind in ("EMERGENCY", "PERMANENT"):
        text = F.when(kind == rule_kind, NOT_PERMITTED[rule_kind]).otherwise(text)
    refusal = F.when(~permitted, F.concat(text, by)).when(ticket_needed & no_ticket, NO_TICKET)
    return requests.withColumns({"allowed": refusal.isNull(), "refusal": refusal})


def override_expiry(df: DataFrame) -> DataFrame:
    """Adds ``expires_at``: the requested hours capped by type; null never expires."""
    longest = F.lit(None).cast("int")
    for kind, hours in fv.OVERRIDE_MAX_HOURS.items():
        longest = F.when(F.col("override_type") == kind, F.lit(hours).cast("int")).otherwise(longest)
    hours = F.least(F.coalesce(F.col("requested_hours"), longest), longest)
    return df.withColumn(
        "expires_at",
        F.when(longest.isNotNull(), F.col("created_at") + F.make_dt_interval(hours=hours)),
    )


def active_overrides(requests: DataFrame, revocations: DataFrame, as_of: str) -> DataFrame:
    """Granted overrides not revoked and not expired at ``as_of``."""
    at = F.lit(as_of).cast("timestamp")
    granted = override_expiry(check_overrides(requests).filter("allowed"))
    return granted.join(revocations.select("override_id"), "override_id", "left_anti").filter(
        (F.col("created_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") >= at))
    )


SLICE_SECONDS = 60


def slice_totals(rows: DataFrame, key: str, t: str, n: str, width: int) -> DataFrame:
    """Adds ``total``: the sum of ``n`` over the key's rows up to each instant ``t``.

    The timeline of a key is cut into slices of ``width`` microseconds. Sums per slice
    are added up in slice order on a table with one row per key and slice; rows are
    sorted only inside their slice. A key with a third of all rows is spread over as
    many tasks as it has slices.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(t) / width))
    sums = sliced.groupBy(key, "_slice").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        key, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(key, "_slice").orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, [key, "_slice"])
        .withColumn("total", F.col("_before") + F.sum(n).over(inside))
        .drop("_slice", "_before")
    )


def rolling_count(
    df: DataFrame, key: str, ts: str, span: int, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Adds ``used``: events of the key in the ``span`` seconds up to each event, itself included.

    That is the running total at the event less the running total just before the span
    began. Events are first counted per (key, instant); each instant adds one probe row
    at the start of its span, and one pass over the slices answers both.
    """
    at = micros(ts)
    counts = df.groupBy(key, at.alias("_at")).agg(F.count("*").alias("_n"))
    both = counts.select(
        key, "_at",
        F.explode(
            F.array(
                F.struct(F.col("_at").alias("t"), F.col("_n").alias("n"), F.lit(False).alias("probe")),
                F.struct(
                    (F.col("_at") - (span * 1_000_000 + 1)).alias("t"),
                    F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("probe"),
                ),
            )
        ).alias("r"),
    ).select(key, "_at", "r.*")
    used = (
        slice_totals(both, key, "t", "n", slice_seconds * 1_000_000)
        .groupBy(key, "_at")
        .agg(F.sum(F.when(F.col("probe"), -F.col("total")).otherwise(F.col("total"))).alias("used"))
    )
    # A tenant's instant may hold many rows: the look-up lets AQE split it.
    place = F.struct(key, "_at").alias("_place")
    rows = df.withColumn("_at", at).select(*df.columns, place)
    return lookup(rows, used.select(place, "used"), "_place", "inner").drop("_place")


def budget_breaches(
    df: DataFrame, limit: int = fv.OVERRIDES_PER_DAY, span: int = 86_400,
    key: str = "tenant", ts: str = "created_at",
) -> DataFrame:
    """Events that find the budget of the rolling window already used up."""
    return rolling_count(df, key, ts, span).filter(F.col("used") > limit)


def first_breach(breaches: DataFrame, key: str = "tenant", ts: str = "created_at") -> DataFrame:
    """The event that freezes each key: its first breach."""
    return breaches.groupBy(key).agg(F.min(ts).alias("frozen_at"))


# ------------------------------------------------------------------ canaries


def canary_signal(runs: DataFrame) -> DataFrame:
    """Runs, passes, failures, samples, pass rate and last verdict per domain."""
    failed = F.col("verdict") == "PHISHING"
    return runs.groupBy("domain").agg(
        F.count("*").alias("test_runs"),
        F.count_if(~failed).alias("passes"),
        F.count_if(failed).alias("failures"),
        F.sum("sample_size").alias("samples"),
        (F.count_if(~failed) / F.count("*")).alias("pass_rate"),
        F.max_by("verdict", F.struct("ts", "run_id")).alias("last_verdict"),
    )


def canary_streak(runs: DataFrame) -> DataFrame:
    """Passes since the last failure per domain, by two map-side combined aggregations.

    No window: a domain with a third of all runs is never sorted in one task.
    """
    position = F.struct("ts", "run_id")
    last = runs.groupBy("domain").agg(
        F.max(F.when(F.col("verdict") == "PHISHING", position)).alias("_last")
    )
    after = F.col("_last").isNull() | (position > F.col("_last"))
    return lookup(runs, last, "domain", "inner").groupBy("domain").agg(
        F.count_if(after).alias("consecutive_passes")
    )


# --- fixed values: why a canary domain is or is not promoted (numbers: passes, samples) -------
PROMOTION_REASONS = {
    "thin": "Insufficient signal: %d/{passes} runs, %d/{samples} samples",
    "streak": "Insufficient consecutive passes: %d/{passes}",
    "rate": ("Pass rate ", " < 100% required"),
    "met": "All promotion criteria met",
}


def promotable(runs: DataFrame) -> DataFrame:
    """Eligibility of each canary domain with the reason."""
    r, s, c = F.col("test_runs"), F.col("samples"), F.col("consecutive_passes")
    thin = (r < fv.CANARY_MIN_PASSES) | (s < fv.CANARY_MIN_SAMPLES)
    needed = {"passes": fv.CANARY_MIN_PASSES, "samples": fv.CANARY_MIN_SAMPLES}
    before, after = PROMOTION_REASONS["rate"]
    reason = (
        F.when(thin, F.format_string(PROMOTION_REASONS["thin"].format(**needed), r, s))
        .when(c < fv.CANARY_MIN_PASSES, F.format_string(PROMOTION_REASONS["streak"].format(**needed), c))
        .when(F.col("pass_rate") < 1, F.concat(F.lit(before), percent(F.col("pass_rate")), F.lit(after)))
        .otherwise(PROMOTION_REASONS["met"])
    )
    joined = canary_signal(runs).join(canary_streak(runs), "domain")
    return joined.withColumns(
        {"eligible": ~thin & (c >= fv.CANARY_MIN_PASSES) & (F.col("pass_rate") >= 1), "reason": reason}
    )


def promotions(runs: DataFrame, approvals: DataFrame) -> DataFrame:
    """Eligible domains with an approval that names a review ticket."""
    signed = approvals.filter(~blank(F.col("approved_by")) & ~blank(F.col("review_ticket")))
    return promotable(runs).filter("eligible").join(signed, "domain")


# ------------------------------------------------------------------ budgets and freezes


def safety_budget(events: DataFrame) -> DataFrame:
    """Per event kind: used, limit, exceeded and when the limit was first passed.

    ``events(kind, ts, event_id)``; a kind without a fixed limit is counted and never exceeded.
    Only the first events of a kind, one more than the largest limit, are sorted.
    """
    limit = F.lit(None).cast("int")
    for kind, n in fv.BUDGET_LIMITS.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    counts = events.groupBy("kind").agg(F.count("*").alias("used")).withColumn("budget", limit)
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("ts", "event_id"))
    first = events.select("kind", "ts", nth.alias("_nth")).filter(F.col("_nth") <= max(fv.BUDGET_LIMITS.values()) + 1)
    passed = first.filter(F.col("_nth") == limit + 1).select("kind", F.col("ts").alias("exceeded_at"))
    return counts.join(passed, "kind", "left").select(
        "kind", "budget", "used", "exceeded_at", F.col("exceeded_at").isNotNull().alias("exceeded")
    )


def safety_status(events: DataFrame) -> DataFrame:
    """Budget use as ``used/limit`` text."""
    return safety_budget(events).select(
        "kind", F.concat_ws("/", "used", F.coalesce(F.col("budget").cast("string"), F.lit("none"))).alias("usage"), "exceeded"
    )


def valid_switches(events: DataFrame) -> DataFrame:
    """Freeze events and resume events that carry an incident and a real justification."""
    accepted = (F.col("kind") == "FREEZE") | (
        (F.col("kind") == "RESUME")
        & ~blank(F.col("incident_id"))
        & (F.length("justification") >= fv.MIN_JUSTIFICATION)
    )
    return events.filter(accepted)


def freeze_state(events: DataFrame, as_of: str) -> DataFrame:
    """One row: whether the system is frozen at ``as_of`` and since which event."""
    switches = valid_switches(events).filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    last = F.max_by(F.struct("kind", "ts", "event_id"), F.struct("ts", "event_id"))
    return switches.agg(last.alias("s")).select(
        F.coalesce(F.col("s.kind") == "FREEZE", F.lit(False)).alias("is_frozen"),
        F.col("s.ts").alias("since"), F.col("s.event_id").alias("event_id"),
    )


def frozen_actions(events: DataFrame) -> DataFrame:
    """Actions attempted while frozen.

    State at an action is the latest valid switch before it, by time and then event. The events are cut
    into slices of about equal size in that order, also inside one crowded instant; the last switch of
    each slice is carried forward over groups of slices, and inside a slice a window finds the
    latest switch. No task sees the whole timeline.
    """
    switches = valid_switches(events).select("ts", "event_id", "kind")
    actions = events.filter("kind = 'ACTION'").select("ts", "event_id", "kind")
    both = in_slices(switches.unionByName(actions), "ts", "event_id")
    state = F.when(F.col("kind") != "ACTION", F.col("kind"))
    position = F.when(F.col("kind") != "ACTION", F.struct("ts", "event_id"))
    last = both.groupBy("_slice").agg(F.max_by("kind", position).alias("_kind"))
    inside = Window.partitionBy("_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.join(carried_forward(last, "_kind"), "_slice")
        .withColumn("_state", F.coalesce(F.last(state, ignorenulls=True).over(inside), "carried"))
        .filter("kind = 'ACTION' AND _state = 'FREEZE'")
        .select("event_id", "ts")
    )


# --- fixed values: what is said of an action under a calibration status ----------------------
ACTION_REASONS = {
    "healthy": "Calibration healthy, action allowed",
    "forbidden": ("Action '", "' forbidden: Calibration status is "),
    "unknown": ("Action '", "' requires human review: Calibration status UNKNOWN"),
    "warning": "Warning: Calibration is ",
}


def action_allowed(df: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``reason`` for (calibration_status, action)."""
    status, action = F.col("calibration_status"), F.col("action")
    forbidden = action.isin(*fv.FORBIDDEN_WHEN_UNHEALTHY)
    before, after = ACTION_REASONS["forbidden"]
    ahead, review = ACTION_REASONS["unknown"]
    reason = (
        F.when(status == "HEALTHY", ACTION_REASONS["healthy"])
        .when(forbidden, F.concat(F.lit(before), action, F.lit(after), status))
        .when(status == "UNKNOWN", F.concat(F.lit(ahead), action, F.lit(review)))
        .otherwise(F.concat(F.lit(ACTION_REASONS["warning"]), status))
    )
    allowed = (status == "HEALTHY") | (~forbidden & (status == "DEGRADED"))
    return df.withColumns({"allowed": allowed, "reason": reason})


# ------------------------------------------------------------------ trust reviews


def trust_records(reviews: DataFrame) -> DataFrame:
    """Per domain: first and latest review, reviewer, and the date the next one is due."""
    latest = F.max_by(F.struct("reviewed_at", "reviewed_by"), F.struct("reviewed_at", "review_id"))
    return reviews.groupBy("domain").agg(
        F.min("reviewed_at").alias("added_at"), latest.alias("_latest")
    ).select(
        "domain", "added_at", F.col("_latest.reviewed_at").alias("last_reviewed_at"),
        F.col("_latest.reviewed_by").alias("reviewed_by"), F.lit("full").alias("trust_level"),
        (F.col("_latest.reviewed_at") + F.make_dt_interval(days=F.lit(fv.REVALIDATION_DAYS))).alias("due_at"),
    )


def revalidation_due(records: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Records overdue or due within ``days``; an overdue record has 0 days left."""
    at = F.lit(as_of).cast("timestamp")
    left = F.floor((micros("due_at") - micros(at)) / 86_400_000_000)
    return (
        records.withColumn("days_left", F.greatest(left, F.lit(0)))
        .withColumn("overdue", at > F.col("due_at"))
        .filter(F.col("days_left") <= days)
    )


def demote(records: DataFrame, domains: DataFrame) -> DataFrame:
    """Records with the named domains on probation."""
    named = domains.select("domain").distinct().withColumn("_named", F.lit(True))
    return records.join(named, "domain", "left").withColumn(
        "trust_level", F.when(F.col("_named"), "probation").otherwise(F.col("trust_level"))
    ).drop("_named")


def open_reviews(required: DataFrame, completed: DataFrame) -> DataFrame:
    """Required human reviews without a completion."""
    return required.join(completed.select("review_id"), "review_id", "left_anti")
