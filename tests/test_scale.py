"""Plan properties that matter on large data."""

import pytest
from pyspark.sql import functions as F

from urlguard.functions import features as fx
from urlguard.operators import policy
from urlguard.operators.gates import block_gate
from urlguard.plans.inputs import AS_OF, Inputs
from urlguard.plans.scan import scan
from urlguard.plans.url_queries import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    query = df._jdf.queryExecution()
    if mode == "final":
        df.collect()
        return query.executedPlan().toString()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(query, mode)


@pytest.fixture
def conf(spark):
    changed = {}

    def put(key, value):
        changed[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)

    yield put
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_page_text_is_never_shuffled(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    i = Inputs(spark, FOLDER)
    text = plan(scan(i["url_fx"], tables(i), AS_OF), "formatted")
    blocks = [b for b in text.split("\n\n") if "Exchange" in b.split("\n")[0]]
    assert blocks
    for block in blocks:
        assert "html#" not in block and "_clean#" not in block and "_tags#" not in block


def test_url_features_read_the_url_column_only(spark):
    i = Inputs(spark, FOLDER)
    df = fx.plain_url_features(i["pages"]).select("page_id", "url_length")
    text = plan(df, "formatted")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "Exchange" not in text


def test_hot_host_is_split(spark, conf):
    """Two thirds of the rows share one host; AQE splits that partition, rows stay whole."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "2KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2KB")
    n = 20_000
    urls = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 != 0, F.lit("https://hot.test/x"))
        .otherwise(F.concat(F.lit("https://h"), (F.col("id") % 400).cast("string"), F.lit(".test/x")))
        .alias("url"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    hosts = spark.range(0, 400, 1, 8).select(
        F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".test")).alias("host")
    ).unionByName(spark.createDataFrame([("hot.test",)], "host string"))
    whois = hosts.select("host", F.col("host").alias("domain_name"),
                         F.lit("2020-01-01").cast("date").alias("creation_date"),
                         F.lit("2022-01-01").cast("date").alias("expiration_date"))
    dns = hosts.select("host", F.array(F.lit("1.2.3.4")).alias("a_records"))
    certs = hosts.select("host", F.lit("2024-01-01").cast("date").alias("not_before"))
    joined = fx.with_host_facts(urls, whois, dns, certs)
    text = plan(joined, "final")
    assert "skew=true" in text
    assert joined.filter("whois_failed OR dns_failed").count() == 0 and joined.count() == n


def test_large_blocklist_is_not_broadcast(spark, conf, psl):
    conf("spark.sql.autoBroadcastJoinThreshold", "1KB")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "1KB")
    blocklist = spark.range(0, 20_000, 1, 8).select(
        F.concat(F.lit("http://b"), F.col("id").cast("string"), F.lit(".com/")).alias("url"), F.lit("a").alias("source")
    )
    urls = spark.range(0, 2_000, 1, 8).select(F.concat(F.lit("http://b"), (F.col("id") * 7).cast("string"), F.lit(".com/y")).alias("url"))
    gated = block_gate(urls, blocklist, psl)
    assert "BroadcastHashJoin" not in plan(gated, "final")
    assert gated.filter("block_source = 'blocklist_domain'").count() == 2_000


def test_hot_tenant_timeline_is_cut(spark):
    """The windows of a rolling count run per (tenant, slice), never per tenant alone."""
    df = spark.range(100).select(
        F.col("id").alias("override_id"), F.lit("hot").alias("tenant"), F.timestamp_seconds(F.col("id") * 60).alias("created_at")
    )
    windows = [line for line in plan(policy.budget_breaches(df)).split("\n") if "Window [" in line]
    over_rows = [w for w in windows if "_sum" not in w]
    assert over_rows and all("_slice" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in over_rows)
