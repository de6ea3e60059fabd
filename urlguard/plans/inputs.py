"""Input tables of the reference's jobs, derived from the given tables.

The given tables hold pages, events, orders and so on; the jobs need crawls, WHOIS and
DNS tables, feeds, scan logs and policy events. Each is one SELECT over whole given
tables, written in SQL that Spark and DuckDB both read, so a query and its SQL check
start from the same rows. CASE ... % n only varies the content of rows. No row is
left out to make a table smaller; the few WHERE clauses make a record *absent* (a
failed fetch, a host without WHOIS), which is itself the case under test.

``@LIST(`` stands for the list constructor, the one spelling that differs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from urlguard import fixed_values as fv
from urlguard.session import configure, new_folder

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2024-07-01"
NET = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"

# --- fixed values: public suffixes of the test data --------------------------------
SUFFIXES = (
    "com", "net", "org", "gov", "gov.uk", "gov.in", "uk", "co.uk", "in", "ru", "xyz", "us",
    "io", "test", "example.com", "example.net", "example.org", "*.city.test", "!www.city.test",
)


def _values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


INPUTS: dict[str, str] = {
    # Raw user input: padded, without scheme, empty, short, long, with spaces, upper case.
    "raw_fx": """
SELECT page_id, CASE page_id % 10
  WHEN 0 THEN '  ' || url || ' '
  WHEN 1 THEN split_part(url, '://', 2)
  WHEN 2 THEN ''
  WHEN 3 THEN substr(url, 9, 3)
  WHEN 4 THEN url || repeat('x', 2000)
  WHEN 5 THEN url || ' y'
  WHEN 6 THEN upper(url)
  WHEN 7 THEN NULL
  WHEN 8 THEN url || '/'
  ELSE url END AS url
FROM pages""",
    # URLs rewritten so that every URL feature takes each of its values.
    "page_fx": f"""
SELECT page_id, html, host AS page_host, CASE page_id % 10
  WHEN 0 THEN replace(url, host, CASE WHEN page_id % 60 = 30 THEN 'shop.n' || CAST(page_id % 7 AS STRING) || '.city.test'
       WHEN page_id % 60 = 50 THEN CASE WHEN page_id % 120 = 50 THEN 'a.www.city.test' ELSE 'n3.city.test' END
       WHEN page_id % 20 = 10 THEN 'tax' || CAST(page_id AS STRING) || '.gov.uk'
       ELSE '192.0.2.' || CAST(page_id % 250 AS STRING) END) || '&p=' || CAST(page_id AS STRING)
  WHEN 1 THEN url || '//next'
  WHEN 2 THEN url || '?u=a@b'
  WHEN 3 THEN replace(url, host, host || ':8080')
  WHEN 4 THEN url || repeat('x', 40)
  WHEN 5 THEN replace(url, host, 'https-' || host)
  WHEN 6 THEN url || CASE WHEN page_id % 20 = 6 THEN '/bit.ly/z' ELSE '/x.pe.hu/z' END
  WHEN 7 THEN replace(url, host, CASE WHEN page_id % 20 = 17
       THEN 'www.аmazon.com' ELSE 'www.paypa1.com' END) || '&p=' || CAST(page_id AS STRING)
  WHEN 8 THEN replace(url, host, CASE WHEN page_id % 20 = 18
       THEN 'm1lk-' || host ELSE 'a.b.' || host END)
  ELSE url END AS url
FROM (SELECT page_id, url, html, {NET} AS host FROM pages) p""",
    "url_fx": "SELECT page_id, url FROM page_fx",
    # A batch request: some URLs padded, some not valid because of a space.
    "batch_fx": """
SELECT page_id, CASE WHEN url LIKE '%@%' THEN url || ' x' WHEN url LIKE '%//next' THEN '  ' || url || ' '
  ELSE url END AS url
FROM url_fx""",
    "host_fx": f"""
SELECT host, min(page_id) AS hid
FROM (SELECT page_id, split_part({NET}, ':', 1) AS host FROM url_fx) u
GROUP BY host""",
    # Crawl results. URLs with a tracking tag could not be fetched: they have no row.
    "crawl_fx": """
SELECT url, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS http_status,
  CAST(page_id % 7 AS INT) AS redirect_count,
  html
  || CASE page_id % 4 WHEN 0 THEN '<form action="">' WHEN 1 THEN '<form id=f action="https://evil.test/x">'
       WHEN 2 THEN '<form method=get action=/s>' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<img src="http://cdn.test/a.png"/><embed src=/b.swf>'
       WHEN 1 THEN '<video src="/v.mp4"></video><IMG alt=x SRC=/a.png>' ELSE '' END
  || CASE page_id % 5 WHEN 0 THEN '<link rel="shortcut icon" href="http://cdn.test/i.ico">'
       WHEN 1 THEN '<link href=/i.ico rel=icon>' ELSE '' END
  || CASE page_id % 7 WHEN 0 THEN '<iframe src="/f"></iframe>'
       WHEN 1 THEN '<!-- <iframe src="/f"> -->' ELSE '' END
  || CASE WHEN page_id % 6 = 0 THEN '<a class=m href="mailto:a@b.test">m</a>' ELSE '' END
  || CASE WHEN page_id % 8 = 0 THEN '<p onMouseOver="go()">' ELSE '' END
  || CASE WHEN page_id % 9 = 0 THEN '<script>window.open("/w")</script>' ELSE '' END
  || CASE WHEN page_id % 10 = 0 THEN '<script>if (event.button == 2) stop()</script>' ELSE '' END
  AS html
FROM page_fx WHERE url NOT LIKE '%utm_source%'""",
    # Look-up tables by host; hosts of one kind have no record in each.
    "whois_fx": f"""
SELECT host, CASE WHEN hid % 9 = 0 THEN NULL ELSE host END AS domain_name,
  DATE '{AS_OF}' - CAST((hid % 400) * 7 AS INT) AS creation_date,
  DATE '{AS_OF}' - CAST((hid % 400) * 7 AS INT) + CAST(90 + (hid * 37) % 700 AS INT) AS expiration_date
FROM host_fx WHERE host NOT LIKE '%.example.org'""",
    "dns_fx": """
SELECT host, CASE WHEN hid % 8 = 1 THEN @LIST()
  WHEN hid % 17 = 2 THEN @LIST('192.0.2.7', '78.46.211.158')
  WHEN hid % 19 = 4 THEN @LIST('10.0.0.1')
  ELSE @LIST('192.0.2.' || CAST(hid % 250 AS STRING)) END AS a_records
FROM host_fx WHERE host NOT LIKE 'https-%'""",
    "cert_fx": f"""
SELECT host, DATE '{AS_OF}' - CAST(hid % 200 AS INT) AS not_before
FROM host_fx WHERE host NOT LIKE 'blog.%'""",
    "psl_fx": f"SELECT suffix FROM (VALUES {_values(SUFFIXES)}) AS s(suffix)",
    # The fixed allowlist plus all registered domains under example.org seen over https.
    "allow_fx": f"""
SELECT DISTINCT domain FROM (
  SELECT regexp_extract({NET}, '([a-z0-9-]+[.]example[.]org)$', 1) AS domain
  FROM pages WHERE url LIKE 'https:%'
  UNION ALL SELECT domain FROM (VALUES {_values(fv.TRUSTED_DOMAINS)}) AS t(domain)) a
WHERE domain <> ''""",
    # Two blocklist feeds: every scanned URL on port 8080, as listed by its feed.
    "block_fx": """
SELECT CASE WHEN url LIKE 'https%' THEN 'a' ELSE 'b' END AS source,
  CASE WHEN page_id % 4 = 1 THEN upper(url) || '/' ELSE url END AS url
FROM url_fx WHERE url LIKE '%:8080%'""",
    # Three labelled sources over the same pages, with conflicts and unusable labels.
    "labeled_fx": """
SELECT 0 AS source_rank, 'A' AS source, page_id AS row_no, url,
  CASE WHEN page_id % 5 = 0 THEN 'phishing' ELSE 'Legitimate ' END AS label_text FROM pages
UNION ALL
SELECT 1, 'B', page_id, upper(url) || '/',
  CASE WHEN (page_id % 5 = 0) <> (page_id % 14 = 0) THEN '1' ELSE '0' END FROM pages
UNION ALL
SELECT 2, 'C', page_id, CASE WHEN url LIKE 'https:%' THEN 'http:' || substr(url, 7)
    ELSE 'https:' || substr(url, 6) END,
  CASE WHEN page_id % 21 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'bad' ELSE 'good' END FROM pages""",
    # Scan log: one row per event.
    "scan_fx": """
SELECT event_id AS scan_id, ts, user_id AS caller,
  CASE event_type WHEN 'error' THEN 'PHISHING' WHEN 'purchase' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  least(value, 100.0) AS risk_score, value / 50 AS latency,
  'https://h' || CAST(user_id AS STRING) || '.test/' || CAST(event_id % 5 AS STRING) AS url,
  CASE WHEN event_id % 4 = 0 THEN 'batch' ELSE 'single' END AS source,
  event_id % 6 <> 0 AS analysis_complete, event_id % 10 = 0 AS allowlist_override,
  CASE WHEN event_id % 6 = 0 THEN @LIST('Some security checks could not complete') ELSE @LIST() END AS warnings,
  CASE event_id % 13
    WHEN 0 THEN @LIST() WHEN 1 THEN @LIST('URL uses IP address instead of domain name')
    WHEN 2 THEN @LIST('URL uses a known URL shortening service', 'Page contains iframes (can hide content)')
    WHEN 3 THEN @LIST('Domain age: 2 days', 'Site uses HTTPS encryption', 'SSL certificate age (newly issued = suspicious)', 'Form submits data to external server')
    WHEN 4 THEN @LIST('Multiple redirects before final page') WHEN 5 THEN @LIST('Domain is on an allowlist')
    WHEN 6 THEN @LIST('Domain has suspicious randomness') WHEN 7 THEN @LIST('URL contains @ symbol')
    WHEN 8 THEN @LIST('Form submits data to external server') WHEN 9 THEN @LIST('Domain is newly registered')
    ELSE @LIST('Page opens popup windows') END AS risk,
  CASE WHEN event_id % 3 = 0 THEN @LIST('Site uses HTTPS encryption', 'Domain has valid DNS records') ELSE @LIST() END AS positive,
  CASE WHEN event_id % 6 = 0 THEN @LIST('WHOIS lookup failed', 'domain_age: Network failure during extraction')
    WHEN event_id % 6 = 1 THEN @LIST('DNS lookup failed') WHEN event_id % 6 = 2 THEN @LIST('HTTP fetch failed') ELSE @LIST() END AS inconclusive
FROM events""",
    "threat_fx": """
SELECT c.c_custkey AS threat_id,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'phishing' WHEN 'MACHINERY' THEN 'malware'
    WHEN 'HOUSEHOLD' THEN 'ransomware' ELSE 'botnet' END AS type,
  CASE c.c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'web' WHEN 2 THEN 'sms' ELSE 'social' END AS attack_vector,
  r.r_name AS region, n.n_name AS country,
  TIMESTAMP '2024-01-01 00:00:00' + make_interval_days(c.c_custkey % 30) AS ts
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    # Predictions: 1 = phishing; eleven probabilities that hit the bin edges.
    "pred_fx": """
SELECT l_linenumber AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  l_discount * 10 AS y_prob, l_shipdate AS ts,
  CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM lineitem""",
    "override_fx": """
SELECT o_orderkey AS override_id, o_orderdate AS created_at,
  CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'PERMANENT' WHEN '3' THEN 'TESTING' ELSE 'EMERGENCY' END AS override_type,
  CASE o_orderstatus WHEN 'F' THEN 'SECURITY_TEAM' WHEN 'O' THEN 'ON_CALL' ELSE 'CI_SYSTEM' END AS authority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'SEC-' || CAST(o_orderkey AS STRING) END AS review_ticket,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 48 AS INT) END AS requested_hours,
  o_orderkey % 10 = 0 AS revoked, o_orderstatus AS tenant
FROM orders""",
    "canary_fx": """
SELECT event_id AS run_id, ts, 'd' || CAST(user_id AS STRING) || '.test' AS domain,
  CASE WHEN event_type = 'error' AND value > 100 AND user_id % 3 <> 0 THEN 'PHISHING'
    WHEN event_type = 'purchase' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  CAST(1 + event_id % 10 AS INT) AS sample_size
FROM events""",
    "policy_fx": """
SELECT event_id, ts, user_id AS actor,
  CASE WHEN event_type = 'signup' AND value > 150 THEN 'FREEZE'
    WHEN event_type = 'purchase' AND value > 150 THEN 'RESUME' ELSE 'ACTION' END AS kind,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'INC-' || CAST(event_id AS STRING) END AS incident_id,
  CASE WHEN event_id % 2 = 0 THEN 'too short' ELSE 'root cause found and fixed' END AS justification
FROM events""",
    "review_fx": """
SELECT 'd' || CAST(o_custkey AS STRING) || '.test' AS domain, o_orderdate AS reviewed_at,
  o_orderkey AS review_id, 'r' || CAST(o_orderkey % 5 AS STRING) AS reviewed_by
FROM orders""",
    "manifest_fx": """
SELECT host AS domain, CASE WHEN hid % 8 = 0 THEN NULL ELSE 'security-team' END AS added_by,
  CASE WHEN hid % 5 = 1 THEN ' ' ELSE 'top list' END AS reason, '2024-01-01' AS added_date
FROM host_fx WHERE host LIKE '%.example.%'""",
    "snapshot_fx": "SELECT host AS domain FROM host_fx WHERE host NOT LIKE 'https-%'",
    "manifest_version_fx": """
SELECT doc_id AS manifest_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'v' || CAST(doc_id AS STRING) END AS version,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '  ' ELSE source END AS change_reason,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS last_modified_by,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE @LIST(lang, source) END AS domains
FROM documents""",
}


def render(sql: str, engine: str) -> str:
    """The SQL in one engine's spelling."""
    if engine == "spark":
        return sql.replace("@LIST(", "array(").replace("make_interval_days(", "make_dt_interval(")
    return sql.replace("@LIST(", "list_value(").replace("make_interval_days(", "to_days(")


def mentioned(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


class Inputs:
    """Given and derived tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in GIVEN:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                frame = self.sql(INPUTS[name])
            self._frames[name] = frame
        return self._frames[name]

    def streaming(self, name: str) -> "Inputs":
        """The same inputs with one given table read as a stream.

        A table is one file or a folder of part files. A stream takes no path of a single file, but
        a pattern that matches it.
        """
        other = Inputs(self.spark, self.folder)
        other._frames[name] = self.spark.readStream.schema(self[name].schema).parquet(f"{self.folder}/{name}.parque[t]")
        return other

    def dealt(self, name: str, batches: int, batch: str) -> Iterator["Inputs"]:
        """The same inputs, time after time, with one given table as a stream that has grown by a batch.

        ``batch`` is an SQL expression that gives a row's batch, 0 to batches - 1. A batch is written to
        the work folder in as many files as tasks wrote it; a stream that goes on from its checkpoint takes
        the new files as one micro-batch.
        """
        rows, path = self[name], new_folder(self.spark, f"dealt-{name}")
        for k in range(batches):
            rows.filter(f"({batch}) = {k}").write.mode("append").parquet(path)
            other = Inputs(self.spark, self.folder)
            other._frames[name] = self.spark.readStream.schema(rows.schema).parquet(path)
            yield other

    def sql(self, text: str) -> DataFrame:
        names = mentioned(text, (*GIVEN, *INPUTS))
        for name in names:
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", text)
        return self.spark.sql(render(text, "spark"), **{n: self[n] for n in names if f"{{{n}}}" in text})


def check_sql(text: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB statement: the text with every derived table it mentions in front."""
    tables = {**INPUTS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in mentioned(sql, tables):
            if name not in order and tables[name] is not sql:
                visit(tables[name])
                if name not in order:
                    order.append(name)

    visit(text)
    parts = ",\n".join(f"{n} AS ({render(tables[n], 'duckdb').strip()})" for n in order)
    body = render(text, "duckdb").strip()
    if not parts:
        return body
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body}) AS q"
    return f"WITH {parts}\n{body}"
