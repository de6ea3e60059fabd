"""Manifest, snapshot and canary documents; the override-audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: document schemas -----------------------------------------------------
MANIFEST_SCHEMA = """
version STRING, schema_version STRING, description STRING, last_modified_by STRING,
last_modified_timestamp STRING, change_reason STRING, review_required BOOLEAN,
governance STRUCT<approval_required_for_additions: BOOLEAN, approval_required_for_removals: BOOLEAN,
  minimum_canary_runs_before_promotion: INT, audit_log_path: STRING>,
domains ARRAY<STRUCT<domain: STRING, category: STRING, added_date: STRING, added_by: STRING, reason: STRING>>,
trusted_tlds ARRAY<STRUCT<tld: STRING, added_date: STRING, added_by: STRING, reason: STRING>>,
checksum STRING, user_added ARRAY<STRING>"""
SNAPSHOT_SCHEMA = "_manifest_version STRING, regression_domains ARRAY<STRING>, regression_tlds ARRAY<STRING>"
CANARY_SCHEMA = """
canary_domains ARRAY<STRUCT<domain: STRING, proposed_by: STRING, proposed_date: STRING, reason: STRING,
  consecutive_passes: INT, minimum_passes_required: INT, notes: STRING>>,
promotion_rules STRUCT<minimum_consecutive_passes: INT, requires_manual_approval: BOOLEAN,
  approval_documented_in_manifest: BOOLEAN>"""


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.option("multiLine", not lines).schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per manifest: a document per file, or one per line (an archive of versions)."""
    return _documents(spark, path, MANIFEST_SCHEMA, lines)


def manifest_domains(manifest: DataFrame) -> DataFrame:
    """One row per listed domain, with its manifest's version."""
    return manifest.select("version", F.inline("domains"))


def manifest_allowlist(manifest: DataFrame) -> DataFrame:
    """Domains, suffixes and user-added domains as one allowlist (version, domain, kind)."""
    def rows(column: Column, kind: str) -> DataFrame:
        return manifest.select("version", F.explode(column).alias("domain"), F.lit(kind).alias("kind"))

    return (
        rows(F.col("domains.domain"), "domain")
        .unionByName(rows(F.col("trusted_tlds.tld"), "suffix"))
        .unionByName(rows(F.col("user_added"), "user"))
    )


def read_snapshot(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(version, domain, kind) of regression snapshots."""
    document = _documents(spark, path, SNAPSHOT_SCHEMA, lines)
    version = F.col("_manifest_version").alias("version")
    return document.select(
        version, F.explode("regression_domains").alias("domain"), F.lit("domain").alias("kind")
    ).unionByName(
        document.select(version, F.explode("regression_tlds").alias("domain"), F.lit("suffix").alias("kind"))
    )


def read_canary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per canary domain, with the promotion rule."""
    return _documents(spark, path, CANARY_SCHEMA, lines).select(
        F.inline("canary_domains"), F.col("promotion_rules.minimum_consecutive_passes").alias("rule_passes")
    ).select("domain", "proposed_by", "proposed_date", "reason", "consecutive_passes",
             "minimum_passes_required", "notes", "rule_passes")


# ------------------------------------------------------------------ override audit


# --- fixed values: what a text line writes for characters that would end a line or a field ----
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("|", "\\|"))
LINE_FIELDS = ("timestamp", "environment", "event_type", "triggering_context", "reason")


def escaped(text: Column) -> Column:
    """Text that stays in its line and field, whatever it holds."""
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    held = "\x00"  # stands for a written backslash while the others are undone
    text = F.replace(text, F.lit(ESCAPES[0][1]), F.lit(held))
    for plain, written in ESCAPES[1:]:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.replace(text, F.lit(held), F.lit(ESCAPES[0][0]))


def audit_line() -> Column:
    """Text form of an audit event; at most five domains are spelled out.

    Line breaks and bars inside a text are escaped, so no text can begin a line or a field.
    """
    timestamp, environment, event_type, context, reason = (escaped(F.col(name)) for name in LINE_FIELDS)
    domains = F.concat(
        escaped(F.array_join(F.slice("affected_domains", 1, 5), ",")),
        F.when(F.size("affected_domains") > 5, "...").otherwise(""),
    )
    flag = F.when(F.col("override_flag_value"), "True").otherwise("False")
    return F.concat_ws(
        " | ", timestamp, environment, event_type,
        F.concat(F.lit("override="), flag),
        F.concat(F.lit("domains="), domains),
        F.concat(F.lit("context="), context),
        F.concat(F.lit("reason="), reason),
    )


AUDIT_RECORD = (
    "timestamp string, environment string, event_type string, override_flag_value boolean,"
    " affected_domains array<string>, triggering_context string, reason string, additional_data map<string,string>"
)
# --- fixed value: what the full record of an event stands after ------------------------------
JSON_MARK = "  JSON: "


def append_override_audit(events: DataFrame, path: str) -> None:
    """Appends audit events: a text line each, and below it the full record as JSON.

    ``additional_data`` (a map) may be missing. Nothing is overwritten.
    """
    if "additional_data" not in events.columns:
        events = events.withColumn("additional_data", F.create_map().cast("map<string,string>"))
    names = [field.split()[0] for field in AUDIT_RECORD.split(", ")]
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    events.select(F.concat(audit_line(), F.lit("\n" + JSON_MARK), record).alias("value")).write.mode("append").text(path)


def read_override_audit(spark: SparkSession, path: str) -> DataFrame:
    """The full records; text lines, comments and blank lines are skipped."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit(JSON_MARK)))
    record = F.from_json(F.substring("value", len(JSON_MARK) + 1, 2**31 - 1), AUDIT_RECORD)
    return lines.select(F.inline(F.array(record))).filter(F.col("timestamp").isNotNull())


def read_override_lines(spark: SparkSession, path: str) -> DataFrame:
    """What the text lines tell, for logs without full records; at most five domains each."""
    parts = F.split("value", r"\s\|\s")

    def field(name: str) -> Column:
        return F.regexp_extract("value", rf"\s\|\s{name}=(.*?)(?:\s\|\s[a-z]+=|$)", 1)

    line = F.trim("value")
    return (
        spark.read.text(path)
        .filter((line != "") & ~F.startswith("value", F.lit("#")) & ~F.startswith(line, F.lit("JSON:")))
        .select(
            *[unescaped(F.get(parts, F.lit(k))).alias(name) for k, name in enumerate(LINE_FIELDS[:3])],
            (field("override") == "True").alias("override_flag_value"),
            F.split(unescaped(field("domains")), ",").alias("affected_domains"),
            unescaped(field("context")).alias("triggering_context"),
            unescaped(field("reason")).alias("reason"),
        )
    )


def recent_overrides(audit: DataFrame, n: int = 10) -> DataFrame:
    """The newest n entries; a top-k, not a full sort."""
    return audit.orderBy(F.desc("timestamp"), "event_type", "reason").limit(n)
