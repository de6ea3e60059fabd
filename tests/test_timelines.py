"""Timelines in slices: hot keys, crowded instants, order statistics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlguard.operators import policy, profile, timelines
from urlguard.operators import telemetry as tel

SECOND = 1_000_000


def replay(times, ttl):
    made, ends = 0, None
    for t in sorted(set(times)):
        if ends is None or t >= ends:
            made, ends = made + 1, t + ttl
    return made


@pytest.mark.parametrize("seed", range(3))
def test_chained_functions_equal_a_replay(seed):
    rng = np.random.default_rng(seed)
    ttl, width = 10, rng.choice([10, 13, 40])
    times = np.unique(rng.choice(600, rng.choice([5, 60, 400])))
    slices = [times[times // width == k] for k in range(600 // width + 1)]
    parts = [timelines.looks_as_function(s, ttl, k * width + ttl) for k, s in enumerate(slices) if len(s)]
    for size in (1, 2, 3, 50):
        functions = [timelines.chained(g[0], g[1:]) for g in (parts[k : k + size] for k in range(0, len(parts), size))]
        for begin in (-100, int(times[0]) + 3, int(times[0]) + ttl - 1):
            if begin >= times[0] // width * width + ttl:
                continue
            made, ends = 0, begin
            for b, m, e in functions:
                assert (np.diff(b) > 0).all()
                at = int(np.searchsorted(b, ends))
                if at < len(b):
                    made, ends = made + int(m[at]), int(e[at])
            assert made == replay(times[times >= begin].tolist(), ttl)


@pytest.mark.parametrize("levels, fanout", [(0, 2), (1, 2), (3, 2), (2, 32)])
def test_entries_of_hot_and_cold_keys(spark, levels, fanout):
    rng = random.Random(levels)
    looks = [("hot", rng.randrange(-50_000, 90_000)) for _ in range(4000)]
    looks += [(f"k{rng.randrange(30)}", rng.randrange(0, 90_000)) for _ in range(500)]
    instants = spark.createDataFrame(list(set(looks)), "k string, t long")
    made = timelines.entries_made(instants, 700, 1000, fanout, levels).first().made
    assert made == sum(replay([t for k, t in looks if k == key], 700) for key in {k for k, _ in looks})


def test_no_task_reads_a_hot_keys_timeline(spark):
    """Two thirds of all looks are at one key; what is gathered by key alone are few functions."""
    df = spark.range(0, 20_000).select(
        F.when(F.col("id") % 3 < 2, "https://hot.test/").otherwise(F.concat(F.lit("https://k"), F.col("id") % 50, F.lit(".test/"))).alias("url"),
        F.timestamp_seconds(F.col("id") * 97).alias("ts"),
    )
    looks = [(("hot" if k % 3 < 2 else k % 50), k * 97) for k in range(20_000)]
    want = sum(replay([t for key, t in looks if key == k], 3600) for k in {key for key, _ in looks})
    row = tel.cache_hits(df).first()
    assert (row.lookups, row.hits) == (20_000, 20_000 - want)
    instants = df.select(F.col("url").alias("k"), (F.col("ts").cast("long") * SECOND).alias("t"))
    sliced = instants.select("k", F.floor(F.col("t") / (86_400 * SECOND)).alias("slice")).groupBy("k", "slice").count()
    assert sliced.agg(F.max("count")).first()[0] < 20_000 / 15


def test_frozen_actions_in_one_crowded_instant(spark):
    """Day-grained time: thousands of events at one instant are cut by event_id."""
    rng = random.Random(8)
    rows = []
    for k in range(6000):
        kind = rng.choices(["ACTION", "FREEZE", "RESUME"], [30, 1, 1])[0]
        rows.append((k, rng.choice([0, 86_400, 86_400, 86_400]), kind, "INC-1", "long enough to be a justification"))
    df = spark.createDataFrame(rows, "event_id int, s long, kind string, incident_id string, justification string")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    frozen, want = False, set()
    for k, _, kind, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        frozen = {"FREEZE": True, "RESUME": False}.get(kind, frozen)
        if kind == "ACTION" and frozen:
            want.add(k)
    assert {r.event_id for r in policy.frozen_actions(df).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slices = timelines.in_slices(df.select("ts", "event_id"), "ts", "event_id")
        assert slices.groupBy("_slice").count().agg(F.max("count")).first()[0] < 6000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_values_are_carried_over_groups(spark, monkeypatch):
    monkeypatch.setattr(timelines, "FANOUT", 3)
    rng = random.Random(2)
    values = {k: rng.choice([None, None, None, "a", "b"]) for k in rng.sample(range(80), 50)}
    df = spark.createDataFrame(list(values.items()), "_slice long, v string")
    last, want = None, {}
    for k in sorted(values):
        want[k] = last
        last = values[k] or last
    carried = timelines.carried_forward(df, "v")
    assert {r._slice: r.carried for r in carried.collect()} == want
    text = carried._jdf.queryExecution().toString()
    assert "windowspecdefinition(_node" in text and "windowspecdefinition(_slice" not in text  # every window has its group


@pytest.mark.parametrize("offset", [0.0, 1e12])
def test_describe_orders_ranges_only(spark, offset):
    rng = np.random.default_rng(3)
    values = {"wide": rng.normal(0, 5, 3001) + offset, "tied": rng.integers(0, 4, 3001).astype(float), "one": np.full(3001, 7.5)}
    rows = [(*map(float, r), None) for r in zip(*values.values())] + [(None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "wide double, tied double, one double, single double")
    got = {r.column: r for r in profile.describe_t(df, ["wide", "tied", "one", "single"]).collect()}
    for name, v in values.items():
        row = got[name]
        assert row["count"] == 3001 and row.min == v.min() and row.max == v.max()
        assert row.mean == pytest.approx(v.mean(), rel=1e-14) and row.std == pytest.approx(v.std(ddof=1), rel=1e-4 if offset else 1e-12, abs=1e-12)
        assert [row.q25, row.q50, row.q75] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist(), rel=1e-15)
    assert got["single"].asDict() == {"column": "single", "count": 1, "mean": 1.0, "std": None, "min": 1.0, "q25": 1.0, "q50": 1.0, "q75": 1.0, "max": 1.0}
    assert "percentile" not in profile.describe_t(df, ["wide"])._jdf.queryExecution().toString()


def test_slices_with_one_look_are_handed_on_together():
    from urlguard.operators import timelines as tl

    one = tuple(np.array([v], np.int64) for v in (5, 1, 15))
    batches = list(tl._gathered((f"k{k}", k, one) for k in range(3 * tl.GATHERED)))
    assert len(batches) == 3 and batches[1].to_pylist()[0] == {"k": f"k{tl.GATHERED}", "slice": tl.GATHERED, "begin": 5, "made": 1, "end": 15}
    assert [c.tolist() for c in tl.looks_as_function(np.array([5]), 10, 10)] == [[5], [1], [15]]
