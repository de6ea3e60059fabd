import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlguard.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, 0, 0.0) for k, v in rows], SCHEMA).repartition(3)


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k):
    ints = {}
    for key, v in rows:
        if key is not None and usable(v):
            e = [math.floor(256 * float(np.float32(x))) for x in v]
            ints[key] = min(ints.get(key, e), e)
    found = []
    for q in sorted(ints):
        if q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q])]
        found += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return found


def search(spark, rows, every, k, **more):
    found = vector_search.nearest(frame(spark, rows), F.col("vec_id") % every == 0, k, **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("bits, k", [(8, 5), (2, 3), (4, 1)])
def test_equals_brute_force(spark, bits, k, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 60)
    monkeypatch.setattr(vector_search, "QUERIES", 8)
    draw = random.Random(bits)
    rows = [(n, [draw.gauss(0, 0.3) for _ in range(8)]) for n in range(150)]
    rows += [(n, rows[n % 7][1]) for n in range(150, 260)]  # groups of copies, ties
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    rows += [(5, rows[5][1]), (310, [0.1, 0.2]), (320, [0.3, -0.2]), (330, [0.0] * 8)]
    draw.shuffle(rows)
    assert search(spark, rows, 10, k, bits=bits) == brute(rows, 10, k)


def test_few_rows(spark):
    assert search(spark, [], 10, 5) == []
    assert search(spark, [(10, [1.0])], 10, 5) == []
    assert search(spark, [(10, [1.0]), (11, [2.0])], 10, 5) == [(10, 1, 11, 256 * 512)]
    assert search(spark, [(11, [2.0])], 10, 5) == []


def test_only_vectors_that_may_enter_are_read(spark):
    """Later pairs are read only while their bound reaches the k-th score; the vectors of others need not exist."""
    as_bytes = lambda v: np.array(v, "<i8").tobytes()
    queries = spark.createDataFrame([(0, as_bytes([1, 0])), (1, as_bytes([0, 1]))], "q long, qv binary")
    scores = [50 - c for c in range(40)]
    alive = [(q, c, float(scores[c] + (3 if q == 0 else 1000))) for q in (0, 1) for c in range(40)]
    exact = [(c, as_bytes([scores[c], c])) for c in range(40)]
    found = vector_search.read_in_order(
        spark.createDataFrame(alive, "q long, c long, high double"), queries, spark.createDataFrame(exact, "c long, cv binary"), 2, 3
    )
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 50), (0, 1, 49), (1, 38, 38), (1, 39, 39)]
    near = [(c, v) for c, v in exact if c < 12]  # what query 0 has no need of is missing
    found = vector_search.read_in_order(
        spark.createDataFrame([a for a in alive if a[0] == 0], "q long, c long, high double"), queries,
        spark.createDataFrame(near, "c long, cv binary"), 2, 3,
    )
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 50), (0, 1, 49)]


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        search(spark, [(10, [1e8, 1.0]), (11, [-1e8, 1.0])], 10, 1, scale=1 << 10)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    vectors, queries = rng.integers(-300, 300, (200, 16)), rng.integers(-300, 300, (20, 16))
    for bits in (1, 3, 8):
        grid = vector_search.Grid(vectors.min(0).tolist(), vectors.max(0).tolist(), bits)
        low, high = grid.bounds(queries, grid.cells(vectors))
        exact = queries @ vectors.T
        assert (low <= exact).all() and (exact <= high).all()
