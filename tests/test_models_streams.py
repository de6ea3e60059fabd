import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.operators import training as tr
from urlguard.plans.inputs import Inputs
from urlguard.session import new_folder
from urlguard.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, size=(400, 33))
    label = np.where((x[:, :5] == 1).sum(axis=1) > (x[:, :5] == -1).sum(axis=1), 1, -1)
    data = [(int(k), *map(int, v), int(y)) for k, (v, y) in enumerate(zip(x, label))]
    schema = "id int, " + ", ".join(f"{n} int" for n in fv.VECTOR_NAMES) + ", label int"
    return spark.createDataFrame(data, schema).cache()


def test_calibrated_model_round_trip(spark, rows, tmp_path):
    train = tr.training_rows(rows, "id").cache()
    model = tr.calibrate(train, [tr.reference_gbt(3)], "id", 2)
    scored = {r.id: r.p for r in model.transform(train).collect()}
    assert len(scored) == 400 and all(0 <= p <= 1 for p in scored.values())
    path = str(tmp_path / "model")
    tr.save_model(model, path, spark)
    loaded = {r.id: r.p for r in tr.load_model(path, spark).transform(train).collect()}
    assert loaded == pytest.approx(scored)
    model.metadata["is_calibrated"] = False
    tr.save_model(model, path, spark)
    with pytest.raises(ValueError, match="not calibrated"):
        tr.load_model(path, spark)


def test_isotonic_is_monotone(spark):
    rng = random.Random(1)
    data = [(float(int(rng.random() < k / 50)), k / 50) for k in range(50) for _ in range(20)]
    df = spark.createDataFrame(data, "label double, score double")
    fitted = tr.fit_isotonic(df).transform(df.select("score").distinct()).orderBy("score").collect()
    values = [r.calibrated for r in fitted]
    assert values == sorted(values)


@pytest.mark.parametrize("scores", ["noisy", "rising", "falling", "one"])
def test_isotonic_blocks_have_the_fit_of_all_scores(spark, scores):
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(5)
    x = np.round(rng.random(3000), 3 if scores == "noisy" else 6)
    y = {"noisy": rng.random(3000) < x, "rising": x > 0.5, "falling": x < 0.5, "one": np.ones(3000)}[scores].astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "score double, label double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = tr.isotonic_blocks(df, fanout=3).orderBy("low").collect()
        model = tr.fit_isotonic(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    means = [b.total / b.weight for b in blocks]
    assert sum(b.weight for b in blocks) == 3000 and len(blocks) < 300
    merged = df.groupBy("score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    whole = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight", predictionCol="whole").fit(merged)
    probes = spark.range(0, 1001).select((F.col("id") / 1000).alias("score"))
    for row in whole.transform(model.transform(probes)).collect():
        assert row.calibrated == pytest.approx(row.whole, abs=1e-12)


def test_far_blocks_of_neighbours_are_passed_over(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(-40, 40, (12, 5)) * 10
    point = lambda k: tuple(map(int, centres[k % 12] + rng.integers(-2, 3, 5)))
    names = [f"c{k}" for k in range(5)]
    schema = "id int, " + ", ".join(f"{n} int" for n in names) + ", label int"
    train = spark.createDataFrame([(k, *point(k), k % 2) for k in range(1200)], schema)
    test = spark.createDataFrame([(k, *point(k), 0) for k in range(240)], schema)
    vector = F.array(*names).alias("v")
    points = tr.written(spark, tr.in_blocks(tr.collapse_vectors(train, names).select(vector, "n", "phishing"), 15))
    asked = tr.written(spark, tr.in_blocks(test.select(vector).distinct(), 8))
    pairs = tr.block_pairs(asked, points, 5)
    assert tr.certain_pairs(pairs, asked, points, 5).count() < 0.5 * pairs.count()
    got = {(r.id, r.k): r.prediction for r in tr.knn_vote(train, test, names, "id", [5], 40, 20).collect()}
    assert got == {(r.id, r.k): r.prediction for r in tr.knn_vote(train, test, names, "id", [5]).collect()}


@pytest.mark.parametrize("block", [50_000, 40])
def test_knn_against_brute_force(spark, rows, block):
    names = list(fv.VECTOR_NAMES[:4])
    data = rows.select("id", *names, (F.col("label") == -1).cast("int").alias("label"))
    train, test = data.filter("id < 300"), data.filter("id >= 300")
    got = {(r.id, r.k): r.prediction for r in tr.knn_vote(train, test, names, "id", [1, 5, 9], block).collect()}
    t = [(np.array(r[1:5]), r.label) for r in train.collect()]
    for r in test.collect():
        d = [(int(((p - np.array(r[1:5])) ** 2).sum()), y) for p, y in t]
        for k in (1, 5, 9):
            votes, left = 0.0, k
            for dist in sorted({x for x, _ in d}):
                ys = [y for x, y in d if x == dist]
                take = min(left, len(ys))
                votes += take * sum(ys) / len(ys)
                left -= take
                if not left:
                    break
            assert got[r.id, k] == int(votes * 2 > k + 1e-12)


def test_confidence_interval(spark):
    df = spark.range(101).select("id", (F.col("id") / 100).alias("p"))
    a = tr.confidence_interval(df, "id").collect()
    b = tr.confidence_interval(df.repartition(5), "id").orderBy("id").collect()
    assert [(r.lower, r.upper) for r in a] == [(r.lower, r.upper) for r in b]
    middle = [r for r in a if 0.2 < r.p < 0.8]
    assert all(0 <= r.lower <= r.upper <= 1 for r in a)
    width = np.mean([r.upper - r.lower for r in middle])
    assert 0.06 < width < 0.09  # about 2 * 1.96 * 0.02


def test_importances_rank_the_signal(spark, rows):
    model = tr.reference_gbt(5).fit(tr.training_rows(rows, "id"))
    top = [r.feature for r in tr.importances(model, spark).limit(5).collect()]
    assert set(top) & set(fv.VECTOR_NAMES[:5])


# ------------------------------------------------------------------ streams


def replay_budget(events, limit):
    out = {}
    for key in {e[0] for e in events}:
        used, start, frozen = 0, None, False
        for _, event_id, at in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            if frozen:
                out[event_id] = "frozen"
                continue
            if start is None or at - start > timedelta(hours=1):
                used, start = 0, at
            if used >= limit:
                frozen, out[event_id] = True, "exhausted"
            else:
                used, out[event_id] = used + 1, "granted"
    return out


def test_stream_budget_over_several_batches(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    path = new_folder(spark, "events")
    events, minute = [], 0
    for batch in range(3):
        part = []
        for _ in range(60):
            minute += rng.randrange(0, 12)
            part.append((rng.choice("abc"), len(events) + len(part), start + timedelta(minutes=minute)))
        events += part
        spark.createDataFrame(part, "user string, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("user string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.event_id: r.outcome for r in jobs.append_table(jobs.stream_budget(stream, "user", 4), "budget").collect()}
    assert got == replay_budget(events, 4)


def test_stream_dedup_against_replay(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    schema = "scan_id long, ts timestamp, url string, is_trusted boolean"
    path, events, minute = new_folder(spark, "scans"), [], 0
    for batch in range(3):
        part = []
        for _ in range(80):
            minute += rng.randrange(0, 6)
            url = rng.choice(["https://hot.test/", "HTTPS://hot.test/ ", "https://b.test", "https://c.test", "bad url x"])
            part.append((len(events) + len(part), start + timedelta(minutes=minute), url, url == "https://c.test"))
        events += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.scan_id for r in jobs.append_table(jobs.stream_dedup(stream), "dedup").collect()}
    last, want = {}, set()
    for scan_id, ts, url, trusted in sorted(events, key=lambda e: (e[1], e[0])):
        key = url.lower().strip()
        if trusted or " " in key:
            want.add(scan_id)
        elif key not in last or ts - last[key] >= timedelta(hours=1):
            last[key] = ts
            want.add(scan_id)
    assert got == want


def test_stream_telemetry_equals_batch(spark):
    inputs = Inputs(spark, FOLDER)
    stream = jobs.update_table(jobs.stream_telemetry(inputs.streaming("events")["scan_fx"]), "tel", ["window_start", "verdict"])
    batch = inputs["scan_fx"].groupBy(F.date_trunc("hour", "ts"), "verdict").count()
    assert {tuple(r) for r in stream.collect()} == {tuple(r) for r in batch.collect()}


def test_work_folder_comes_from_the_session(spark):
    from urlguard.session import work_folder

    assert new_folder(spark, "x").startswith(work_folder(spark))
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, work_folder(spark))


def test_scan_with_a_reloaded_model(spark):
    """Gates are as in any scan; other rows have the model's probability and its verdict."""
    from urlguard.plans.inputs import Inputs
    from urlguard.plans.model_queries import model_scan
    from urlguard.plans.url_queries import scanned

    i = Inputs(spark, "/root/testdata/sf0.001")
    by_model = {r.page_id: r for r in model_scan(i).collect()}
    plain = {r.page_id: r for r in scanned(i).collect()}
    assert by_model.keys() == plain.keys()
    scored = 0
    for page, row in by_model.items():
        other = plain[page]
        assert (row.is_trusted, row.is_blocked, row.ssrf_status) == (other.is_trusted, other.is_blocked, other.ssrf_status)
        if row.is_trusted or row.is_blocked or row.ssrf_status != "ok":
            assert (row.verdict, row.risk_score) == (other.verdict, other.risk_score)
            continue
        scored += 1
        assert 0 <= row.calibrated_probability <= 1
        if not (row.failures.http_failed or row.failures.whois_failed or row.failures.dns_failed):
            p = row.calibrated_probability
            assert row.verdict == ("PHISHING" if p >= 0.85 else "SUSPICIOUS" if p >= 0.55 else "SAFE")
    assert scored


def test_registered_budget_has_the_rule_of_the_library(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["x06_stream_budget"](spark, FOLDER).collect()
    assert rows and max(r.used for r in rows) > 2


def test_registered_training_has_the_full_settings(spark):
    import __spark_entry__ as entry
    from urlguard.plans import model_queries as mq

    assert (mq.TREES, mq.SCALE, mq.FOLDS) == (tr.reference_gbt().getMaxIter(), 1.0, tr.FOLDS)
    values = {name: (parameter, v) for name, _, parameter, v in mq.SWEEPS}
    assert values == {
        "m06_depth_sweep": ("maxDepth", list(range(1, 30))), "m06_trees_sweep": ("numTrees", list(range(1, 20))),
        "m06_rate_sweep": ("stepSize", pytest.approx([k / 10 for k in range(1, 10)])),
        "m06_boosted_depth_sweep": ("maxDepth", list(range(1, 10))),
    }
    assert {*values, "m06_svm_grid"} <= set(entry.queries())


def test_sweep_over_folds_fits_each_fold_once(rows, monkeypatch):
    fits, fit = [], tr.LinearSVC.fit

    def counted(self, df, params=None):
        fits.append(params)
        return fit(self, df, params)

    monkeypatch.setattr(tr.LinearSVC, "fit", counted)
    found = tr.sweep(tr.training_rows(rows, "id").withColumnRenamed("id", "page_id"), tr.LinearSVC(maxIter=5), {"regParam": [0.1]}, folds=3)
    (row,) = found.collect()
    assert 0.5 < row.accuracy <= 1 and row.params == '{"regParam": 0.1}'
    assert len(fits) == 3  # no fit on all rows that nobody asks for


def test_sweep_of_rows_that_are_alike_is_that_of_single_rows(spark, rows):
    train = tr.training_rows(rows, "id").withColumnRenamed("id", "page_id")
    train = train.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("page_id") % 4))).drop("copy")
    folds = tr.in_folds(train, "page_id", 5, True)
    assert folds.count() == 400 and folds.agg(F.sum("n")).first()[0] == train.count() == 1000
    found = [
        {r.params: r.accuracy for r in tr.sweep(train, tr.boosted(3, 2), {"stepSize": [0.1, 0.7]}, alike=alike).collect()}
        for alike in (True, False)
    ]
    assert len(found[0]) == 2 and found[0] == pytest.approx(found[1])
