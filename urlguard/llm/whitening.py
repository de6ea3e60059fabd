"""Whitening of embeddings along their leading principal components, by block Jacobi-Davidson.

The covariance is never formed. All that the driver sees of the vectors are products of the
covariance with a few columns: every task centres its vectors and multiplies them twice, Spark adds the
parts. The driver holds a search space of at most ``SPACE`` times as many columns as components asked
for:

1. Rayleigh-Ritz on the search space gives Ritz pairs and residuals.
2. Leading pairs whose residual has reached double precision are locked. They stay in the space but
   get no further correction.
3. For the others the projected correction equation (I - QQ')(V - theta)(I - QQ') t = -r is solved by
   MINRES, all pairs side by side, so an inner step is one distributed product.
4. The corrections, made orthogonal, widen the space; a full space restarts from its Ritz vectors.

Every component c becomes the integer floor(scale * c) + shift. The fit list has each distinct vector of
integers once. Sums over it are exact (decimals), so results do not depend on the order in which parts
are added, and centring cancels nothing: the integer next to the mean is taken off first.

Vectors that are null, empty, or hold null or non-finite components take no part. Rows with a null or
repeated id are rows like others. Vectors of different lengths are separate tables with a fit each (as
many passes as there are lengths). There are as many components as entries, at most ``components``.
Components without variance (below 1e-12 of the largest) have no whitened value: it is null, as
``explained`` is without any variance. ``deviation`` is null beyond 64 bits. Integers of 2^40 and more
are refused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.llm.common import local_rows, stored
from urlguard.llm.vector_search import integers, usable

GUARD = 4  # Ritz pairs kept beside those asked for
SPACE = 4  # columns of the search space for each Ritz pair
INNER = 10  # MINRES steps at most
OUTER = 60
PRECISION = 64 * np.finfo(float).eps
FLAT = 1e-12  # eigenvalues below this share of the largest count as zero
LARGEST = 1 << 40
PLACES = 12  # decimal places of sums
WIDE = Context(prec=60)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, rhs: np.ndarray, steps: int, target: float) -> np.ndarray:
    """Solves one symmetric system for each column, until all residuals have fallen to ``target`` times the first."""
    size = np.linalg.norm(rhs, axis=0)
    first, left = size.copy(), size.copy()
    v, v_old = rhs / np.where(size > 0, size, 1), np.zeros_like(rhs)
    x, w, w_old = (np.zeros_like(rhs) for _ in range(3))
    beta, cos, cos_old = np.zeros_like(size), np.ones_like(size), np.ones_like(size)
    sin, sin_old = np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_next = np.linalg.norm(p, axis=0)
        diagonal = cos * alpha - cos_old * sin * beta
        one = np.hypot(diagonal, beta_next)
        two, three = sin * alpha + cos_old * cos * beta, sin_old * beta
        going = one > 0
        safe = np.where(going, one, 1)
        cos_old, cos, sin_old, sin = cos, np.where(going, diagonal / safe, 1), sin, np.where(going, beta_next / safe, 0)
        w_old, w = w, np.where(going, (v - three * w_old - two * w) / safe, 0)
        x = x + cos * left * w
        left = -sin * left
        v_old, v, beta = v, np.where(beta_next > 0, p / np.where(beta_next > 0, beta_next, 1), 0), beta_next
        if (np.abs(left) <= target * first).all():
            break
    return x


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to another basis."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
        columns = columns / np.maximum(np.linalg.norm(columns, axis=0), np.finfo(float).tiny)
    left, sizes, _ = np.linalg.svd(columns, full_matrices=False)
    left = left[:, sizes > 1e-10 * max(1.0, sizes.max(initial=0))]
    left = left - against @ (against.T @ left)
    return np.linalg.qr(left)[0]


@dataclass
class Found:
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # the largest, as a share of the largest eigenvalue
    products: int


def jacobi_davidson(product: Product, size: int, wanted: int, seed: int = 12) -> Found:
    """The ``wanted`` largest eigenpairs of a symmetric matrix that is known by its products only."""
    calls = 0

    def times(columns: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(columns)

    width = min(size, wanted + GUARD)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    image = times(basis)
    locked = 0
    for _ in range(OUTER):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :width], image @ turn[:, :width]
        residual = moved - ritz * values[:width]
        largest = max(abs(values[0]), np.finfo(float).tiny)
        off = np.linalg.norm(residual, axis=0) / largest
        locked = 0
        while locked < wanted and off[locked] <= PRECISION:
            locked += 1
        if locked == wanted:
            break
        if basis.shape[1] == size:  # nothing to add: the images are renewed at the Ritz vectors
            basis = np.linalg.qr(basis @ turn)[0]
            image = times(basis)
            continue
        open_ = np.arange(locked, width)
        open_ = open_[off[open_] > PRECISION]

        def projected(columns: np.ndarray) -> np.ndarray:
            columns = columns - ritz @ (ritz.T @ columns)
            columns = times(columns) - columns * values[open_]
            return columns - ritz @ (ritz.T @ columns)

        # Far from the goal a rough correction will do.
        target = float(np.clip(off[open_].max(), 1e-3, 0.1))
        step = minres(projected, -residual[:, open_], min(INNER, size - width), target)
        if basis.shape[1] + len(open_) > min(size, SPACE * width):
            keep = min(size, 2 * width)
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
        new = _orthonormal(step, basis)[:, : size - basis.shape[1]]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(calls).standard_normal((size, 1)), basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    else:
        raise RuntimeError(f"{wanted - locked} of {wanted} components have not converged, residuals {off[:wanted].max():.1e}")
    vectors = ritz[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(wanted)])
    return Found(values[:wanted], vectors * signs, float(off[:wanted].max()), calls)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of integers, from a column of their bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros((0, dim), np.int64)
    return np.frombuffer(column.buffers()[2], "<i8", int(offsets[-1] - offsets[0]) // 8, int(offsets[0])).reshape(-1, dim)


def _packed(vectors: Column) -> Column:
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        vectors = vectors.cast(pa.list_(pa.int64()))
        flat, edges = vectors.flatten().to_numpy(), np.cumsum([0, *vectors.value_lengths().to_pylist()])
        if len(flat) and np.abs(flat).max() >= LARGEST:
            raise ValueError("a component is too large to be whitened")
        data, edges = flat.astype("<i8").tobytes(), (edges * 8).tolist()
        return pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())

    return pack(vectors)


def _summed(frame: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, width: int) -> list[Decimal]:
    """Sums of ``width`` numbers over all vectors; ``part`` gives those of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), dim))
                total = own if total is None else total + own
        if total is not None:
            whole = [(Decimal(int(v)) if total.dtype == object else _decimal(v)).quantize(Decimal(1).scaleb(-PLACES), context=WIDE) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(whole, pa.decimal128(38, PLACES))], ["at", "part"])

    parts = frame.select("data").mapInArrow(run, f"at int, part decimal(38,{PLACES})")
    sums = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    return [sums.get(k, Decimal(0)) for k in range(width)]


def _decimal(value: np.longdouble) -> Decimal:
    high = float(value)
    return Decimal(high) + Decimal(float(value - np.longdouble(high)))


@dataclass
class Centre:
    """Mean of the fit list: the integer next to it, and n times what is left."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    trace: Fraction

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.whole).astype(float) - self.rest / self.n

    def deviations(self, vectors: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each vector."""
        small = np.square(self.n * self.centred(vectors)).sum(1) < 2.0**62
        result = np.full(len(vectors), None, object)
        for rows, exact in ((small, np.int64), (~small, object)):
            away = (vectors[rows] - self.whole).astype(exact) * self.n - self.rest.astype(exact)
            result[rows] = (away * away).sum(1)
        return [int(v) if v < 1 << 63 else None for v in result.tolist()]


def _centre(fit: DataFrame, dim: int, shift: int) -> Centre:
    def part(vectors: np.ndarray) -> np.ndarray:
        near = vectors - shift
        near = near.astype(object) if np.abs(near).max() >= 1 << 24 else near
        both = np.concatenate([[len(near)], near.sum(0), (near * near).sum(0)])
        return both.astype(object)

    n, *sums = map(int, _summed(fit, part, dim, 1 + 2 * dim))
    totals, squares = sums[:dim], sums[dim:]
    whole = [round(Fraction(s, n)) for s in totals]
    trace = sum((Fraction(n * q - s * s, n * n) for s, q in zip(totals, squares)), Fraction(0))
    rest = np.array([s - n * w for s, w in zip(totals, whole)], dtype=object)
    return Centre(n, np.array([w + shift for w in whole]), rest.astype(np.int64), trace)


@dataclass
class Model:
    """What whitens vectors of one length: a mean and some directions."""

    centre: Centre
    found: Found
    identity_error: float | None

    @property
    def kept(self) -> np.ndarray:
        values = self.found.values
        return values > FLAT * max(values.max(initial=0), np.finfo(float).tiny)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        scale = np.where(self.kept, np.sqrt(np.where(self.kept, self.found.values, 1)), np.inf)
        return self.centre.centred(vectors) @ (self.found.vectors / scale)


def fit_model(fit: DataFrame, dim: int, components: int, shift: int) -> Model:
    """Fits on a table of distinct vectors (column ``data``) of one length."""
    centre = _centre(fit, dim, shift)

    def product(columns: np.ndarray) -> np.ndarray:
        def part(vectors: np.ndarray) -> np.ndarray:
            rows = centre.centred(vectors)
            return (rows.T @ (rows @ columns)).astype(np.longdouble)

        total = _summed(fit, part, dim, columns.size)
        return np.array([float(t / centre.n) for t in total]).reshape(columns.shape)

    model = Model(centre, jacobi_davidson(product, dim, min(components, dim)), None)
    kept = model.kept
    if not kept.any():
        return model

    def part(vectors: np.ndarray) -> np.ndarray:
        white = model.project(vectors)[:, kept]
        return np.concatenate([white.sum(0), (white.T @ white).ravel()]).astype(np.longdouble)

    width = int(kept.sum())
    sums = np.array([float(v) for v in _summed(fit, part, dim, width + width * width)]) / centre.n
    covariance = sums[width:].reshape(width, width) - np.outer(sums[:width], sums[:width])
    model.identity_error = float(np.abs(covariance - np.eye(width)).max())
    return model


def _applied(model: Model, dim: int):
    trace, found, kept = model.centre.trace, model.found, model.kept
    explained = [float(Fraction(float(v)) / trace) if trace else None for v in found.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            white, count = model.project(vectors), len(found.values)
            rows = len(vectors)
            each = lambda values, kind: pa.array([v for v in values for _ in range(count)], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    each(batch.column(0).to_pylist(), pa.int64()),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, model.centre.n)),
                    each(model.centre.deviations(vectors), pa.int64()),
                    pa.array(white.ravel(), mask=np.tile(~kept, rows)),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([model.identity_error] * (rows * count), pa.float64()),
                ],
                [field.split()[0] for field in RESULT.split(", ")],
            )

    return run


def whiten(
    vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """A row (vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    spark = vectors.sparkSession
    whole = F.transform(integers(vector, scale), lambda x: x + shift)
    rows = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), _packed(whole).alias("data"))
    rows = stored(rows, "whitening-rows")
    fit = stored(rows.select("dim", "data").distinct(), "whitening-fit")
    result = local_rows(spark, [], RESULT)
    for (dim,) in sorted(fit.select("dim").distinct().collect()):
        model = fit_model(fit.where(F.col("dim") == dim), dim, components, shift)
        result = result.unionAll(rows.where(F.col("dim") == dim).select("vec_id", "data").mapInArrow(_applied(model, dim), RESULT))
    return result
