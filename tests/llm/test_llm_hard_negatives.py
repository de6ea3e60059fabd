import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlguard.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, tag string, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, label, 0, "x", "y") for k, v, label in rows], SCHEMA).repartition(3)


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    held = {}
    for key, v, label in rows:
        if key is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[key] = min(held.get(key, row), row)
    found = []
    for a, (own, av) in held.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(av, v)), k, label) for k, (label, v) in held.items() if k != a and len(v) == len(av)]
        scores.sort()
        for p, pid, _ in [s for s in scores if s[2] == own][:positives]:
            fits = [s for s in scores if s[2] != own and low * -p <= 100 * -s[0] <= high * -p]
            found += [(a, pid, n, k, -p, -s) for n, (s, k, _) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, every, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("seed, spread", [(1, 0.3), (2, 0.05)])
def test_equals_brute_force(spark, seed, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "SLICE", 70)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.4) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(300):
        label = 1 if k % 3 == 0 else draw.randint(0, 4)  # a third of all rows has one label
        rows.append((k, [c + draw.gauss(0, spread) for c in centres[draw.randint(0, 4)]], label))
    rows += [(k, rows[k % 5][1], draw.randint(0, 4)) for k in range(300, 360)]  # equal vectors, ties
    rows += [(400, None, 1), (405, [], 1), (410, [None] * 6, 1), (415, [float("nan")] * 6, 1), (420, [float("inf")] + [0.0] * 5, 1), (None, [0.5] * 6, 1)]
    rows += [(425, [0.1] * 6, None), (430, [0.0] * 6, 2), (5, rows[6][1], 0), (435, [0.3, 0.2], 1), (440, [0.3, 0.4], 1), (441, [0.2, 0.2], 0)]
    draw.shuffle(rows)
    assert mined(spark, rows, 5) == brute(rows, 5)
    assert mined(spark, rows, 10, positives=2, negatives=1, low=20, high=100) == brute(rows, 10, 2, 1, 20, 100)


def test_few_rows(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(5, [1.0], 1)], 5) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.9], 2)], 5) == [(5, 6, 1, 7, 65536, 256 * 230)]
    assert mined(spark, [(6, [1.0], 1), (7, [0.9], 2)], 5) == []


def test_bounds_spare_scores():
    """Where anchors are close, most candidates are never scored; what is found stays exact."""
    rng = np.random.default_rng(3)
    centre = rng.integers(-200, 200, 32)
    anchors = centre + rng.integers(-1, 2, (40, 32))
    candidates = np.concatenate([rng.integers(-60, 60, (3000, 32)), centre + rng.integers(-3, 4, (20, 32))])
    wanted = [[hard_negatives.Wanted(0, -np.inf, np.inf, 5)] for _ in anchors]
    block = hard_negatives.Block(list(range(40)), [0] * 40, anchors, wanted, same_label=True)
    ids = np.arange(1000, 1000 + len(candidates))
    for at in range(0, len(ids), 500):
        block.meet(ids[at : at + 500], np.zeros(len(ids[at : at + 500]), np.int64), candidates[at : at + 500])
    assert block.scored < 0.3 * len(anchors) * len(candidates)
    found = {(r["anchor"], r["id"], r["score"]) for r in block.found().to_pylist()}
    exact = anchors @ candidates.T
    assert found == {(a, int(ids[c]), int(exact[a, c])) for a in range(40) for c in np.lexsort((ids, -exact[a]))[:5]}


def test_spanning_tree():
    vectors = np.array([[0.0, 0], [10, 0], [1, 0], [9, 0], [5, 0]])
    order, parents = hard_negatives.spanning_tree(vectors)
    assert sorted(order) == [0, 1, 2, 3, 4] and parents[order[0]] == -1
    assert all(order.index(parents[k]) < order.index(k) for k in order[1:])
    assert sum(abs(vectors[k] - vectors[parents[k]]).sum() for k in order[1:]) == 10


def test_large_scores():
    block = hard_negatives.Block([1], [0], np.array([[1 << 30, 1]]), [[hard_negatives.Wanted(0, -np.inf, np.inf, 2)]], True)
    block.meet(np.array([2, 3]), np.zeros(2, np.int64), np.array([[1 << 30, 1], [1 << 30, 2]]))
    assert block.found().column("score").to_pylist() == [(1 << 60) + 2, (1 << 60) + 1]
    with pytest.raises(ValueError):
        block.meet(np.array([2]), np.zeros(1, np.int64), np.array([[1 << 34, 1]]))
