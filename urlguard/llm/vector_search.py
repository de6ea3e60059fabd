"""Exact top-k inner products by a vector-approximation file.

Every vector has an approximation: a cell of 2^bits for each component. A scan of the
approximations, blocks of queries against blocks of cells, bounds each score from both sides and
keeps what may still be among a query's best. The exact vectors of those are then read in the
order of their upper bounds, in rounds of growing size, until no later one can enter the result:
vectors that come after are never read.

Components x become floor(256 * x) (``scale``). Equal vectors are one class, whose members are
brought in at the end: the best k + 1 of all members lie in the k + 1 best classes (by score, then
by smallest vec_id), and of a class the k + 1 smallest ids suffice. So a large group of copies
costs no more than one vector.

Vectors that are null, empty, or hold null or non-finite components, and rows without vec_id,
take no part. Of rows that repeat a vec_id the smallest vector counts. Only vectors of equal
length are compared. Scores are 64-bit integers; vectors whose scores might be larger are refused. A query gets all others if there are fewer than
k, and no row if there are none. Empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard.llm.common import stored

BITS = 8
BLOCK = 8192  # candidates compared at once
QUERIES = 512  # queries compared at once
FIRST, GROWTH = 4, 16  # exact vectors read in the first round for each one wanted; growth from round to round
CLASS = ["h1", "h2"]


def integers(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)


def _packed(ints: Column) -> Column:
    """Integers as little-endian 64-bit numbers."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([np.array(v, "<i8").tobytes() for v in lists.to_pylist()], pa.binary())

    return pack(ints)


class Grid:
    """Equal cells of each component between its least and largest value; one for each vector length."""

    def __init__(self, least: list[int], largest: list[int], bits: int):
        self.least = np.array(least, np.int64)
        self.width = np.maximum(1, -(-(np.array(largest, np.int64) - self.least + 1) // (1 << bits)))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.least) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of queries and vectors in these cells."""
        wide = queries.astype(np.float64)
        corner = (wide @ self.least)[:, None] + (wide * self.width) @ cells.astype(np.float64).T
        most = (np.abs(wide) @ (np.abs(self.least) + 256.0 * self.width))[:, None]
        slack = np.where(most < 2.0**52, 0.0, most * 2.0**-40)  # whole numbers are exact below
        spread = wide * (self.width - 1)
        low, high = (np.where(side, spread, 0).sum(1)[:, None] for side in (spread < 0, spread > 0))
        return corner + low - slack, corner + high + slack


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])


def _scan(grids: dict[int, Grid], k: int):
    """Of each block of queries and block of cells, the pairs that may be among the query's k best.

    Rows come sorted: the queries of a pair of blocks before its cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts = None, []

        def finish() -> pa.RecordBatch | None:
            ids = [np.concatenate([p[1] for p in parts if p[0] == kind] or [np.zeros(0, np.int64)]) for kind in (0, 1)]
            if not len(ids[0]) or not len(ids[1]):
                return None
            dim = pair[0]
            data = [b"".join(v for p in parts if p[0] == kind for v in p[2]) for kind in (0, 1)]
            queries = np.frombuffer(data[0], "<i8").reshape(-1, dim)
            cells = np.frombuffer(data[1], np.uint8).reshape(-1, dim)
            low, high = grids[dim].bounds(queries, cells)
            best = min(k, low.shape[1])
            floor = np.partition(low, low.shape[1] - best, 1)[:, low.shape[1] - best]
            if best < k:
                floor[:] = -np.inf
            q, c = np.nonzero(high >= floor[:, None])
            columns = (ids[0][q], ids[1][c], low[q, c], high[q, c])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["q", "c", "low", "high"])

        for batch in batches:
            dims, qs, cs, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            data = batch.column(5).to_pylist()
            keys = np.rec.fromarrays([dims, qs, cs, kinds]) if len(dims) else []
            for start, end in _runs(keys) if len(dims) else ():
                now = (int(dims[start]), int(qs[start]), int(cs[start]))
                if now != pair:
                    if parts and (done := finish()) is not None:
                        yield done
                    pair, parts = now, []
                parts.append((int(kinds[start]), ids[start:end], data[start:end]))
        if parts and (done := finish()) is not None:
            yield done

    return run


@functools.cache
def _score():
    @F.arrow_udf("long")
    def score(queries: pa.Array, vectors: pa.Array) -> pa.Array:
        pairs = zip(queries.to_pylist(), vectors.to_pylist())
        return pa.array([int(np.frombuffer(q, "<i8") @ np.frombuffer(v, "<i8")) for q, v in pairs], pa.int64())

    return score


def read_in_order(alive: DataFrame, queries: DataFrame, exact: DataFrame, k: int, first: int) -> DataFrame:
    """(q, c, score): the k best pairs of each query among ``alive`` (q, c, high), score first, then smaller c.

    A round reads the exact vectors of a query's pairs with the largest upper bounds: ``first`` of them, and
    then GROWTH times as many each time. What cannot reach the k-th best score found so far is let go.
    """
    best = None
    left, size = alive, first
    while True:
        order = Window.partitionBy("q").orderBy(F.desc("high"), "c")
        taken = left.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select("q", "c", "high")
        taken = stored(taken, "read-next")
        scored = taken.join(queries, "q").join(exact, "c").select("q", "c", _score()("qv", "cv").alias("score"))
        found = scored if best is None else scored.unionAll(best)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
        best = stored(found.withColumn("nth", rank).where(F.col("nth") <= k).select("q", "c", "score"), "best-so-far")
        # Later pairs in the same order, if they may still enter.
        last = taken.groupBy("q").agg(F.min(F.struct("high", -F.col("c"))).alias("last"))
        floor = best.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        open_ = left.join(last, "q").where(F.struct("high", -F.col("c")) < F.col("last")).join(floor, "q")
        left = stored(open_.where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("q", "c", "high"), "unread")
        if left.isEmpty():
            return best
        size *= GROWTH


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bits: int = BITS,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that ``is_query`` (of vec_id) picks."""
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(vector))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), integers(vector, scale).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    hashed = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    hashed = stored(hashed.withColumn("is_query", is_query), "vectors")

    nth = F.row_number().over(Window.partitionBy(*CLASS).orderBy("vec_id"))
    members = hashed.select(*CLASS, "vec_id", nth.alias("nth")).where(F.col("nth") <= k + 1)
    members = stored(members, "members")
    first = members.where("nth = 1").select("vec_id")
    classes = hashed.join(first, "vec_id").select(F.col("vec_id").alias("c"), *CLASS, "v", F.size("v").alias("dim"))
    sides = classes.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    grids: dict[int, Grid] = {}
    edges: dict[int, list] = {}
    for row in sides.orderBy("dim", "at").collect():  # two numbers for each component
        edges.setdefault(row.dim, []).append((row.low, row.high))
    for dim, found in edges.items():
        if sum(max(low * low, high * high) for low, high in found) >= 1 << 63:
            raise ValueError("scores may exceed 63 bits")
        grids[dim] = Grid(*zip(*found), bits)

    @F.arrow_udf("binary")
    def approximation(packed: pa.Array) -> pa.Array:
        vectors = (np.frombuffer(p, "<i8") for p in packed.to_pylist())
        return pa.array([grids[len(v)].cells(v).tobytes() for v in vectors], pa.binary())

    # The file of approximations is apart from the exact vectors; the scan reads only the former.
    exact = stored(classes.select("c", *CLASS, "dim", _packed(F.col("v")).alias("exact")), "exact-vectors")
    cells = stored(exact.select("c", "dim", approximation("exact").alias("cells")), "approximations")
    asking = hashed.where("is_query").select(*CLASS).distinct()
    asking = stored(exact.join(asking, CLASS).select(F.col("c").alias("q"), "dim", "exact"), "queries")

    n_cells = F.lit(max(1, -(-cells.count() // BLOCK)))
    n_queries = F.lit(max(1, -(-asking.count() // QUERIES)))

    def block(column: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(column), n).cast("int")

    def numbers(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))

    asked = asking.select("dim", block("q", n_queries).alias("qb"), numbers(n_cells).alias("cb"), F.lit(0).alias("kind"), F.col("q").alias("id"), F.col("exact").alias("data"))
    offered = cells.select("dim", numbers(n_queries).alias("qb"), block("c", n_cells).alias("cb"), F.lit(1).alias("kind"), F.col("c").alias("id"), F.col("cells").alias("data"))
    pairs = asked.unionAll(offered).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "kind", "id")
    bounded = stored(pairs.mapInArrow(_scan(grids, k + 1), "q long, c long, low double, high double"), "bounds")

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "c"))
    floors = bounded.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("q")
    floors = floors.agg(F.when(F.count("*") > k, F.min("low")).alias("floor"))
    alive = bounded.join(floors, "q").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    best = read_in_order(
        stored(alive.select("q", "c", "high"), "alive"), asking.select("q", F.col("exact").alias("qv")),
        exact.select("c", F.col("exact").alias("cv")), k + 1, FIRST * (k + 1),
    )

    # From classes back to rows.
    named = exact.select("c", *CLASS)
    inside = best.join(named, "c").join(members.select(*CLASS, "vec_id"), CLASS).select("q", "vec_id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    inside = inside.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")
    queries = hashed.where("is_query").select(*CLASS, F.col("vec_id").alias("query_id"))
    queries = queries.join(named.withColumnRenamed("c", "q"), CLASS).select("q", "query_id")
    others = queries.join(inside, "q").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


CHECK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(e) AS val, generate_subscripts(e, 1) AS pos FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.val * c.val) AS BIGINT) AS score
  FROM x q JOIN x c ON q.pos = c.pos
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
