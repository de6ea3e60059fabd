"""Hard negatives for anchors, with score bounds along a spanning tree of the anchors.

A positive of an anchor is one of the ``positives`` best other rows with its label. A hard negative
for the two is a row with another label whose score lies in a window below the positive's, from
``low`` to ``high`` percent of it; the ``negatives`` best of them are returned.

Anchors are numbered in the order of their place (length, label, side of some random planes) and cut
into blocks. In a task a block of anchors meets a slice of candidates, which arrive in chunks. The
anchors of a block form a minimum spanning tree. Only its root is scored against every candidate; a
child's score is its parent's, plus or minus the length of the edge times the candidate's norm. If
the parent was only bounded itself, bounds widen along the path. A candidate is scored exactly
at a child only if its bounds overlap a window in which the child still looks for rows; windows shrink
from below as better rows are found. The first search (positives) has one window without upper end.

Scores are inner products of the integers floor(scale * component), compared as integers; ties go
to the smaller vec_id. Rows with a null vec_id, label or vector, an empty vector, or null or non-finite
components take no part. Of rows that repeat a vec_id the one with the smallest label, then vector,
counts. Only vectors of equal length are compared. Scores beyond 63 bits are refused. Anchors without
positives, and positives without negatives (such as those with a score below zero, whose window is
empty), give no row. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard.llm.common import stored
from urlguard.llm.vector_search import integers, usable
from urlguard.operators.lookup import lookup

ANCHORS = 512  # anchors of a block
SLICE = 32_768  # candidates that one task compares with a block, about
CHUNK = 2048  # candidates bounded at once
PLANES = 12
EXACT, LARGEST = 2.0**53, 2.0**63  # whole numbers are exact below, in float64 and in longdouble
SLACK = 1 + 1e-12


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int]]:
    """Order and parents (-1: root) of a minimum spanning tree, parents before children (Prim)."""
    root = int(np.square(vectors - vectors.mean(0)).sum(1).argmin())
    far, parent = np.full(len(vectors), np.inf), np.full(len(vectors), -1)
    open_, order, now = np.ones(len(vectors), bool), [], root
    while True:
        order.append(now)
        open_[now] = False
        if not open_.any():
            return order, parent.tolist()
        away = np.square(vectors - vectors[now]).sum(1)
        nearer = open_ & (away < far)
        far[nearer], parent[nearer] = away[nearer], now
        now = int(np.where(open_, far, np.inf).argmin())


class Wanted:
    """The best ``k`` rows whose score lies in a window."""

    def __init__(self, tag: int, low: float, high: float, k: int):
        self.tag, self.low, self.high, self.k = tag, low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if not inside.any():
            return
        scores = np.concatenate([self.scores, scores[inside].astype(np.int64)])
        ids = np.concatenate([self.ids, ids[inside]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.low = max(self.low, int(self.scores[-1]))


class Block:
    """Anchors of one block in the order of their tree, with what each looks for."""

    def __init__(self, ids: list, labels: list, vectors: np.ndarray, wanted: list[list[Wanted]], same_label: bool):
        order, parents = spanning_tree(vectors.astype(float))
        place = {old: new for new, old in enumerate(order)}
        self.ids, self.labels, self.wanted = ([values[k] for k in order] for values in (ids, labels, wanted))
        self.parents = [place.get(parents[k], -1) for k in order]
        self.vectors, self.same_label = vectors[order], same_label
        up = np.maximum(self.parents, 0)
        self.edges = np.sqrt(np.square((self.vectors - self.vectors[up]).astype(float)).sum(1)) * SLACK
        self.largest = np.sqrt(np.square(vectors.astype(float)).sum(1).max())
        self.scored = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Takes up a chunk of candidates."""
        norms = np.sqrt(np.square(vectors.astype(float)).sum(1)) * SLACK
        most = self.largest * norms.max()
        if most >= LARGEST:
            raise ValueError("scores exceed 63 bits")
        kind = np.float64 if most < EXACT else np.longdouble
        vectors, anchors = vectors.astype(kind), self.vectors.astype(kind)
        low, high = np.empty((len(anchors), len(ids)), kind), np.empty((len(anchors), len(ids)), kind)
        for at, parent in enumerate(self.parents):
            if parent < 0:
                low[at] = high[at] = vectors @ anchors[at]
                near = np.arange(len(ids))
            else:
                reach = norms * self.edges[at]
                np.subtract(low[parent], reach, out=low[at])
                np.add(high[parent], reach, out=high[at])
                overlap = np.zeros(len(ids), bool)
                for window in self.wanted[at]:
                    overlap |= (high[at] >= window.low) & (low[at] <= window.high)
                near = np.flatnonzero(overlap)
                exact = (vectors if len(near) == len(ids) else vectors[near]) @ anchors[at]
                low[at, near] = high[at, near] = exact
            self.scored += len(near)
            fits = (labels[near] == self.labels[at]) == self.same_label
            near = near[fits & (ids[near] != self.ids[at])]
            for window in self.wanted[at]:
                window.take(low[at, near], ids[near])

    def found(self) -> pa.RecordBatch:
        rows = [(a, w.tag, i, s) for a, each in zip(self.ids, self.wanted) for w in each for i, s in zip(w.ids.tolist(), w.scores.tolist())]
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "tag", "id", "score"])


def _compared(k: int, same_label: bool, low: int, high: int):
    """Rows come sorted by group; the anchors of a group (kind 0) before its candidates."""

    def windows(given: list | None) -> list[Wanted]:
        if given is None:
            return [Wanted(0, -np.inf, np.inf, k)]
        ends = [(w["tag"], -(-w["score"] * low // 100), w["score"] * high // 100) for w in given]
        return [Wanted(tag, a, b, k) for tag, a, b in ends if a <= b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, block = None, [], None
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in range(5)]  # dim, part, block, slice, kind
            if not batch.num_rows:
                continue
            edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(start, end - start)
                group, kind = tuple(int(k[start]) for k in key[:4]), int(key[4][start])
                if group != now:
                    if block:
                        yield block.found()
                    now, anchors, block = group, [], None
                vectors = np.frombuffer(b"".join(part.column(7).to_pylist()), "<i8").reshape(-1, group[0])
                if kind == 0:
                    anchors.append((part.column(5).to_pylist(), part.column(6).to_pylist(), vectors, part.column(8).to_pylist()))
                    continue
                if block is None and anchors:
                    ids, labels, parts, given = zip(*anchors)
                    block = Block(sum(ids, []), sum(labels, []), np.concatenate(parts), [windows(g) for g in sum(given, [])], same_label)
                if block:
                    own, labels = part.column(5).to_numpy(), part.column(6).to_numpy()
                    for at in range(0, len(own), CHUNK):
                        block.meet(own[at : at + CHUNK], labels[at : at + CHUNK], vectors[at : at + CHUNK])
        if block:
            yield block.found()

    return run


def _best(rows: DataFrame, anchors: DataFrame, keys: list[str], k: int, same_label: bool, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor, tag, id, score, rank) of the best rows for each anchor and window; both sides meet by ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    blocks = anchors.groupBy(*keys).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    groups = stored(blocks.join(sizes, keys), "groups")
    part = F.col("label") if len(keys) > 1 else F.lit(0).cast("long")

    def side(frame: DataFrame, kind: int, block: Column, place: Column, windows: Column) -> DataFrame:
        met = lookup(frame, groups, keys, "inner").withColumn("at", block).withColumn("slice", place)
        return met.select("dim", part.alias("part"), "at", "slice", F.lit(kind).alias("kind"), "vec_id", "label", "data", windows.alias("windows"))

    kind = anchors.schema["windows"].dataType
    asked = side(anchors, 0, F.col("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), F.col("windows"))
    offered = side(rows, 1, F.explode(F.sequence("first", "last")), F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"), F.lit(None).cast(kind))
    group = ["dim", "part", "at", "slice"]
    met = asked.unionAll(offered).repartition(*group).sortWithinPartitions(*group, "kind")
    found = met.mapInArrow(_compared(k, same_label, low, high), "anchor long, tag long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _side_of_planes(data: str, dim: str) -> Column:
    """A number whose bits tell on which sides of some random planes a vector lies."""

    @F.arrow_udf("int")
    def sides(data: pa.Array, dims: pa.Array) -> pa.Array:
        codes = []
        for blob, dim in zip(data.to_pylist(), dims.to_pylist()):
            planes = np.random.default_rng(dim).standard_normal((PLANES, dim))
            codes.append(int(((planes @ np.frombuffer(blob, "<i8")) > 0) @ (1 << np.arange(PLANES))))
        return pa.array(codes, pa.int32())

    return sides(F.col(data), F.col(dim))


def _packed(vectors: Column) -> Column:
    """Integers as little-endian 64-bit numbers."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([np.array(v, "<i8").tobytes() for v in lists.to_pylist()], pa.binary())

    return pack(vectors)


def numbered(anchors: DataFrame) -> DataFrame:
    """Adds ``block``: anchors in order of length, label and place, cut into blocks of ANCHORS."""
    order = ["dim", "label", "code", "vec_id"]
    ranged = anchors.withColumn("code", _side_of_planes("data", "dim"))
    ranged = stored(ranged.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "anchor-ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # One row for each range partition.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    placed = ranged.join(offsets, "range").withColumn("block", F.floor((F.col("before") + inside) / ANCHORS).cast("int"))
    return placed.select(*anchors.columns, "block")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` picks anchors by vec_id. A negative's score is at least ``low`` and at most
    ``high`` percent of the positive's.
    """
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(vector))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), integers(vector, scale).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    rows = rows.select("vec_id", "row.label", F.size("row.v").alias("dim"), _packed(F.col("row.v")).alias("data"), is_anchor.alias("is_anchor"))
    rows = stored(rows, "labelled-vectors")
    anchors = stored(numbered(rows.where("is_anchor").drop("is_anchor")), "anchors")
    rows = rows.drop("is_anchor")

    unbounded = F.lit(None).cast("array<struct<tag:long,score:long>>").alias("windows")
    liked = _best(rows, anchors.select("*", unbounded), ["dim", "label"], positives, same_label=True)
    liked = stored(liked.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = liked.groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive_id").alias("tag"), F.col("positive_score").alias("score"))).alias("windows"))
    armed = stored(anchors.join(windows.withColumnRenamed("anchor", "vec_id"), "vec_id"), "armed-anchors")
    found = _best(rows, armed, ["dim"], negatives, same_label=False, low=low, high=high)
    result = found.select("anchor", F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return result.join(liked, ["anchor", "positive_id"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


CHECK_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, unnest(e) AS val, generate_subscripts(e, 1) AS pos FROM v),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label, CAST(sum(a.val * c.val) AS BIGINT) AS score
  FROM x a JOIN x c ON a.pos = c.pos WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id GROUP BY ALL),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND own <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3"""
