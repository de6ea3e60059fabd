import math
import random
from fractions import Fraction

import numpy as np
import pytest

from urlguard.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, data string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", "y") for k, v in rows], SCHEMA).repartition(3)


def whole(v):
    return [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v]


def brute(rows, components):
    """By numpy's eigen-decomposition of the exactly centred fit list."""
    fit = sorted({tuple(whole(v)) for _, v in rows})
    n, totals = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * x - s for x, s in zip(v, totals)] for v in fit], object)
    centred = away.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = sum(Fraction(int(x) ** 2, n**3) for row in away for x in row)
    return n, totals, values, vectors, trace


def check(found, rows, components, near=1e-7):
    n, totals, values, vectors, trace = brute(rows, components)
    count = len(values)
    assert len(found) == len(rows) * count
    by_id = {(r.vec_id, r.component): r for r in found}
    for c in range(count):
        signs = set()
        for key, v in rows:
            row = by_id[key, c + 1]
            away = [n * x - s for x, s in zip(whole(v), totals)]
            assert row.n == n and row.deviation == sum(x * x for x in away)
            assert row.explained == pytest.approx(float(Fraction(values[c]) / trace), rel=1e-9)
            assert row.identity_error < 1e-9
            want = float(np.array(away, float) / n @ vectors[:, c]) / math.sqrt(values[c])
            if abs(want) > 1e-3:
                signs.add(np.sign(want * row.whitened))
            assert abs(abs(row.whitened) - abs(want)) < near
        assert len(signs) <= 1


def test_equals_eigendecomposition(spark):
    draw = random.Random(1)
    rows = [(k, [draw.gauss(0, 0.1 + 0.2 * c) for c in range(24)]) for k in range(200)]
    rows += [(k, rows[k % 9][1]) for k in range(200, 260)] + [(None, rows[3][1])]
    strange = [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("-inf")] * 24)]
    check(whitening.whiten(frame(spark, rows + strange), components=5).collect(), rows, 5)


def test_fewer_entries_than_components_and_two_lengths(spark):
    draw = random.Random(2)
    short = [(k, [draw.gauss(0, 1), draw.gauss(0, 3)]) for k in range(40)]
    long = [(100 + k, [draw.gauss(0, 1 + c) for c in range(3)]) for k in range(40)]
    found = whitening.whiten(frame(spark, short + long)).collect()
    check([r for r in found if r.vec_id < 100], short, 2)
    check([r for r in found if r.vec_id >= 100], long, 3)


def test_no_variance(spark):
    found = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(frame(spark, [(k, [k / 8, 0.5]) for k in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2}
    assert {round(r.explained, 12) for r in flat if r.component == 1} == {1.0}
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("kind", ["decay", "close", "clusters", "rank", "flat"])
def test_jacobi_davidson(kind):
    rng = np.random.default_rng(4)
    size = 400
    spectrum = {
        "decay": 1000 * 0.97 ** np.arange(size), "close": 40 + rng.random(size), "clusters": np.repeat([9.0, 5.0, 1.0], [6, 20, size - 26]),
        "rank": np.append([3.0, 2.0], np.zeros(size - 2)), "flat": np.zeros(size),
    }[kind]
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = turn * spectrum @ turn.T
    matrix = (matrix + matrix.T) / 2
    multiplied = []

    def product(columns):
        multiplied.append(columns.shape[1])
        return matrix @ columns

    found = whitening.jacobi_davidson(product, size, 8)
    values = np.linalg.eigvalsh(matrix)[::-1][:8]
    largest = max(values[0], 1e-300)
    assert np.abs(found.values - values).max() <= 1e-12 * max(1, largest)
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() <= 1e-13 * max(1, largest)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-12
    assert max(multiplied) <= 8 + whitening.GUARD


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix = turn * np.linspace(-2, 3, 30) @ turn.T
    rhs = rng.standard_normal((30, 3))
    x = whitening.minres(lambda v: matrix @ v, rhs, 60, 1e-12)
    assert np.abs(matrix @ x - rhs).max() < 1e-9


def test_sums_do_not_depend_on_order(spark):
    draw = random.Random(6)
    rows = [(k, [draw.gauss(0, 1 + c) for c in range(8)]) for k in range(300)]
    once = whitening.whiten(frame(spark, rows)).collect()
    again = whitening.whiten(frame(spark, rows[::-1]).repartition(7)).collect()
    assert {(r.vec_id, r.component): round(r.whitened, 9) for r in once} == {(r.vec_id, r.component): round(r.whitened, 9) for r in again}
