from collections import Counter

import pytest
from llm_help import ODD_TEXTS, documents, lower

from urlguard.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(texts, threshold, least_chars=1):
    key = lambda line: lower(line).strip(BLANK)
    held, by_document = Counter(), {}
    for doc_id, text in texts:  # rows without a doc_id are documents of their own
        name = doc_id if doc_id is not None else ("none", text)
        by_document.setdefault(name, set()).update(key(line) for line in (text or "").split("\n"))
    for keys in by_document.values():
        held.update(keys)
    drop = {k for k, n in held.items() if n >= threshold and len(k) >= least_chars}
    result = []
    for doc_id, text in texts:
        lines = (text or "").split("\n")
        stay = [line for line in lines if key(line) not in drop]
        result.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(result, key=str)


LINES = [(100 + k, f"Shared LINE\r\nown line {k}\n\n shared line \n{'twice' if k < 4 else 'É'}\n{'twice' if k < 4 else ''}") for k in range(12)]
TEXTS = ODD_TEXTS + LINES + [(200, "own"), (200, "own"), (200, "own")]


@pytest.mark.parametrize("threshold, least_chars, batches", [(10, 1, 4), (3, 1, 1), (2, 5, 3), (1, 2, 7)])
def test_equals_brute_force(spark, threshold, least_chars, batches):
    found = line_dedup.dedup(documents(spark, TEXTS), threshold, least_chars, batches)
    rows = sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    assert rows == brute(TEXTS, threshold, least_chars)


def batch_of(spark, *keys):
    return spark.createDataFrame([(k, k) for k in keys], "hi long, lo long")


def test_runs_are_levelled_and_settled_keys_stay_out(spark):
    runs = line_dedup.LineRuns(spark, threshold=2, buckets=4)
    for n in range(5):
        runs.add(batch_of(spark, 1, 1, 2))
        held = sum(len(level) for level in runs.levels)
        assert held == bin(n + 1).count("1")
    counts = {r.hi: r.n for r in runs.merged().collect()}
    assert counts == {1: 2, 2: 2}  # settled after one and two batches, not added again
    assert sorted(r.hi for r in runs.settled().collect()) == [1, 2]


def test_a_batch_of_another_day(spark):
    """The manifest brings the levels back; counts go on where they were."""
    runs = line_dedup.LineRuns(spark, threshold=5, buckets=3)
    for keys in ([1, 2, 3], [1, 2], [1, 4]):
        runs.add(batch_of(spark, *keys))
    runs.close()
    assert not {t.name for t in spark.catalog.listTables(pattern="run_*")} & {f"run_{p.rsplit('-', 1)[1]}" for level in runs.levels for p in level}
    again = line_dedup.LineRuns(spark, threshold=5, folder=runs.folder)
    assert (again.levels, again.buckets, again.version) == (runs.levels, 3, 3)
    again.add(batch_of(spark, 1, 1, 2, 5))
    assert {r.hi: r.n for r in again.merged().collect()} == {1: 5, 2: 3, 3: 1, 4: 1, 5: 1}
    assert [r.hi for r in again.settled().collect()] == [1]
    third = line_dedup.LineRuns(spark, threshold=5, folder=runs.folder)
    third.add(batch_of(spark, 1, 2))
    assert {r.hi: r.n for r in third.merged().collect()} == {1: 5, 2: 4, 3: 1, 4: 1, 5: 1}


def test_runs_are_merged_without_being_moved_or_sorted(spark):
    runs = line_dedup.LineRuns(spark, threshold=3)
    for _ in range(3):
        runs.add(batch_of(spark, *range(50)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with line_dedup.settings(spark, line_dedup.MERGING):
            merged = runs.merged()._jdf.queryExecution().executedPlan().toString()
            batch = runs.unsettled(batch_of(spark, 1, 2).groupBy("hi", "lo").agg({"*": "count"}).withColumnRenamed("count(1)", "n"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in merged and "Exchange" not in merged and "Sort [" not in merged
    # Only the batch is moved and sorted, once for all runs.
    assert batch.count("SortMergeJoin") == 2 and batch.count("Exchange") == 1 and batch.count("Sort [") == 1


def test_empty_table(spark):
    assert line_dedup.dedup(documents(spark, [])).count() == 0
