import hashlib

import pytest
from pyspark.sql import functions as F

from urlguard.operators import prep
from urlguard.operators.ranking import hash_rank


def labelled(spark, n=400, share=5):
    return spark.range(n).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical_url"),
        F.when(F.col("id") % share == 0, 1).otherwise(0).alias("label"),
    )


def expected_rank(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_rank_is_exact(spark, digits):
    ranked = hash_rank(labelled(spark), "canonical_url", 42, ["label"], digits).collect()
    for label in (0, 1):
        mine = [r.canonical_url for r in sorted((r for r in ranked if r.label == label), key=lambda r: r["rank"])]
        assert mine == expected_rank(mine)
        assert {r["rank"] for r in ranked if r.label == label} == set(range(1, len(mine) + 1))


def test_dedup_first_row_and_conflicts(spark):
    rows = [("a", "1", "S1", 0, 2), ("a", "2", "S0", 1, 0), ("b", "3", "S0", 0, 1), ("a", "4", "S1", 0, 0)]
    df = spark.createDataFrame(
        [(c, u, s, l, (int(s[1]), k)) for c, u, s, l, k in rows],
        "canonical_url string, url string, source string, label int, ord struct<source_rank:int,row_no:int>",
    )
    want = {("a", "2", "S0", 1), ("b", "3", "S0", 0)}
    assert {tuple(r) for r in prep.dedup(df).collect()} == want
    assert {tuple(r) for r in prep.dedup(df.repartition(7, "url")).collect()} == want
    again = prep.dedup(prep.dedup(df).withColumn("ord", F.struct(F.lit(0).alias("source_rank"), F.lit(0).alias("row_no"))))
    assert {tuple(r) for r in again.collect()} == want
    stats = prep.dedup_stats(df).first()
    assert (stats.total_before_dedup, stats.duplicates_removed, stats.conflicts_resolved) == (4, 2, 1)


def test_balance(spark):
    df = labelled(spark, 400, 5)  # 80 phishing, 320 legitimate
    counts = {r.label: r["count"] for r in prep.balance(df).groupBy("label").count().collect()}
    assert counts == {1: 80, 0: int(80 * (0.65 / (1 - 0.65)))}
    even = labelled(spark, 100, 2)
    assert prep.balance(even).count() == 100
    with pytest.raises(ValueError):
        prep.balance(df.filter("label = 0"))


def test_sample_is_exact_and_stratified(spark):
    df = labelled(spark, 401, 3)
    counts = {r.label: r["count"] for r in prep.stratified_sample(df, 50).groupBy("label").count().collect()}
    assert sum(counts.values()) == 50 and abs(counts[1] - 50 * 134 / 401) < 1
    assert prep.stratified_sample(df, 1000).count() == 401


def test_split_is_disjoint_exact_and_stable(spark):
    df = labelled(spark, 1000, 4)
    parts = prep.split(df)
    counts = {(r.label, r.split): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 525, (0, "val"): 112, (0, "test"): 113,
                      (1, "train"): 175, (1, "val"): 37, (1, "test"): 38}
    again = prep.split(df.repartition(13))
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in again.collect()}
    assert {r.overlap for r in prep.leakage(parts).collect()} == {0}
    prep.require_no_leakage(parts)
    with pytest.raises(ValueError):
        prep.require_no_leakage(parts.unionByName(parts.withColumn("split", F.lit("test"))))


def test_keep_last(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "url string, v int, n int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2)], "url string, v int, n int")
    assert {(r.url, r.v) for r in prep.merge_keep_last(old, new, "n").collect()} == {("a", 3), ("b", 1)}
    assert prep.merge_keep_last(old.drop("url"), new, "n").count() == 4


def test_shuffle_is_a_fixed_permutation(spark):
    keys = [r.canonical_url for r in prep.shuffle(labelled(spark, 200)).collect()]
    assert keys == expected_rank(keys) and len(set(keys)) == 200


def test_fill_schema(spark):
    df = spark.createDataFrame([(None, 5)], "url_length int, other int")
    row = prep.fill_schema(df).first()
    assert row.url_length == 0 and row.dns_lookup_failed == 0 and row.other == 5
