import random

import pytest
from pyspark.sql import functions as F

from urlguard.operators import calibration as cal
from urlguard.operators import evaluation as ev
from urlguard.operators import profile
from urlguard.operators import telemetry as tel


def preds(spark, rows):
    return spark.createDataFrame([(int(y), float(p)) for y, p in rows], "y_true int, y_prob double")


def test_bins_use_edges(spark):
    edges = [k / 10 for k in range(11)]
    curve = cal.reliability(preds(spark, [(1, e) for e in edges])).orderBy("bin").collect()
    assert sum(r.samples for r in curve) == 11
    assert curve[9].samples == 2
    empty = cal.reliability(preds(spark, [(1, 0.95)])).orderBy("bin").collect()
    assert empty[0].observed == 0 and empty[0].expected == pytest.approx(0.05)


@pytest.mark.parametrize("rows,status", [
    ([], "unknown"),
    ([(k % 2, 0.5) for k in range(100)], "degraded"),                       # collapse
    ([(k % 2, 0.01 if k % 2 else 0.99) for k in range(100)], "degraded"),   # extremes
    ([(k % 2, 0.2 + 0.6 * (k % 2)) for k in range(100)], "healthy"),
    ([(1 - k % 2, 0.2 + 0.6 * (k % 2)) for k in range(100)], "degraded"),   # Brier 0.64
])
def test_status(spark, rows, status):
    assert cal.calibration_status(preds(spark, rows)).first().calibration_status == status


def test_status_agrees_with_single_metrics(spark):
    rng = random.Random(5)
    df = preds(spark, [(rng.random() < 0.4, rng.random()) for _ in range(500)])
    row = cal.calibration_status(df).first()
    assert row.brier_score == pytest.approx(cal.brier(df).first()[0])
    assert row.calibration_error == pytest.approx(cal.ece(cal.reliability(df)).first()[0])
    assert row.variance == pytest.approx(df.select(F.var_pop("y_prob")).first()[0])


def test_report_of_all_one_class(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y_true int, prediction int")
    row = ev.prf(df).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    check = ev.sanity(df).first()
    assert check.degenerate and check.low_recall
    cells = {(r.actual, r.predicted): r.n for r in ev.confusion(df).collect()}
    assert cells == {(1, 0): 2, (0, 0): 1, (1, 1): 0, (0, 1): 0}


def test_cache_hits_against_brute_force(spark):
    rng = random.Random(3)
    # One key holds most rows; many share an instant.
    log = [("https://hot.test/" if rng.random() < 0.7 else f"https://k{rng.randrange(20)}.test/",
            rng.randrange(0, 40_000) if rng.random() < 0.8 else 7200) for _ in range(2000)]
    df = spark.createDataFrame(log, "url string, s int").select("url", F.timestamp_seconds("s").alias("ts"))
    last, hits = {}, 0
    for url, s in sorted(log, key=lambda r: r[1]):
        if url in last and s - last[url] < 3600:
            hits += 1
        else:
            last[url] = s
    row = tel.cache_hits(df).first()
    assert (row.lookups, row.hits) == (2000, hits)


def test_a_hit_does_not_renew_its_entry(spark):
    looks = [("https://a.test/", 60 * m, False) for m in (0, 50, 100, 150)]
    looks += [("https://t.test/", m, True) for m in (0, 1)] + [("a b", m, False) for m in (0, 1)]
    df = spark.createDataFrame(looks, "url string, s int, is_trusted boolean").withColumn("ts", F.timestamp_seconds("s"))
    row = tel.cache_hits(df).first()
    assert (row.lookups, row.hits, row.hit_rate) == (8, 2, 0.25)
    assert tuple(tel.cache_hits(df.limit(0)).first()) == (0, 0, 0.0)


def test_history_pages_are_whole(spark):
    df = spark.range(95).select(
        F.col("id").alias("scan_id"), F.timestamp_seconds(F.col("id") % 7).alias("ts"),
        F.lit("SAFE").alias("verdict"), F.lit("https://A.test").alias("url"),
    )
    seen = [r.scan_id for page in range(1, 11) for r in tel.history(df, "SAFE", "a.TEST", page).collect()]
    assert sorted(seen) == list(range(95)) and tel.history_pages(df).first().pages == 10


def test_describe_matches_columns(spark):
    df = spark.createDataFrame([(k % 3 - 1, k % 2) for k in range(100)], "a int, b int")
    rows = {r.column: r for r in profile.describe_t(df, ["a", "b"]).collect()}
    want = df.select(F.mean("a"), F.stddev_samp("a"), F.percentile("a", 0.25)).first()
    assert (rows["a"].mean, rows["a"]["q25"]) == pytest.approx((want[0], want[2]))
    assert rows["a"].std == pytest.approx(want[1])


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(k, 2 * k, 1) for k in range(10)], "a int, b int, c int")
    got = {(r.a, r.b): r["corr"] for r in profile.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] is None


def test_one_decimal_rounds_like_exact_binary(spark):
    from urlguard.functions.text import percent

    rows = [(k, n) for n in (1, 3, 7, 8, 40, 80, 160, 400, 2000) for k in range(n + 1)]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", percent(F.col("k") / F.col("n")).alias("t"))
    assert all(r.t == f"{r.k / r.n * 100:.1f}%" for r in df.collect())
