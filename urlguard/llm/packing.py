"""Best-fit decreasing packing of token sequences.

Best fit depends on lengths only, and equal lengths behave alike: a document goes to the tightest
open bin, and the next one of its length to the same bin until it does not fit any more. So the
packing of a whole corpus follows from the number of pieces of each length (at most ``capacity``
numbers). The plan works on runs of bins with the same content; a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time. The plan has a few thousand lines
whatever the size of the corpus, and Spark seats every piece by its rank among its length.

Null text is empty; every document ends with the end id, so each has at least one piece. Rows that
repeat a doc_id are packed each on its own. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlguard.llm.common import stored, text_or_empty, text_slices
from urlguard.llm.tokens import piece_encoder
from urlguard.operators.lookup import lookup

IDS = "ids binary"
PIECES = f"doc_id long, piece int, start long, length long, ids_crc32 long, {IDS}, _part long, _nth long"


class OpenCapacities:
    """Segment tree over 0..capacity: which remaining capacities have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = is_open
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest open capacity of at least ``length``."""
        node = self.leaves + length
        while not self.any[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1  # the right sibling
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length.

    Returns lines (length, first rank, first bin, pieces in each bin, offset): the pieces of this
    length from the first rank on fill bins from the first one on, so many in each.
    """
    tree, bins = OpenCapacities(capacity), [deque() for _ in range(capacity + 1)]
    lines, made = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            bins[room].append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                give(capacity, made, n)
                made += n
            first, n = bins[room].popleft()
            if not bins[room]:
                tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                lines.append((length, rank, first, each, capacity - room))
                give(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than one bin takes: the last of this length
                lines.append((length, rank, first + full, each, capacity - room))
                give(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                bins[room].appendleft((first + full, n - full))
                tree.mark(room, True)
    return lines


def pieces(documents: DataFrame, path: str, end_id: int, capacity: int, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each with its place in its task.

    The ids themselves are a column only if asked for.
    """
    fields = [f.split() for f in PIECES.split(", ") if keep_ids or f != IDS]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind] for _, kind in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_encoder(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), {}
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                columns: dict[str, list] = {name: [] for name, _ in fields}
                doc_ids = batch.column(0).slice(first, len(texts)).to_pylist()
                for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = memoryview(ids)[at : at + 4 * capacity]
                        length = len(own) // 4
                        seen[length] = nth = seen.get(length, -1) + 1
                        row = (doc_id, piece, at // 4, length, zlib.crc32(own), *([own] if keep_ids else []), part, nth)
                        for held, value in zip(columns.values(), row):
                            held.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns.values(), kinds)], list(columns))

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(cut, ", ".join(map(" ".join, fields)))


def seat(placed: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (columns length, _part, _nth)."""
    counts = {r.length: r.n for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lines = sorted(best_fit(counts, capacity)) or [(0, 0, 0, 1, 0)]
    lengths, ranks, firsts, each, offsets = (np.array(c, np.int64) for c in zip(*lines))
    keys = lengths << 48 | ranks

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        line = np.searchsorted(keys, length << 48 | rank, "right") - 1
        k = rank - ranks[line]
        bins, nth = firsts[line] + k // each[line], k % each[line]
        return pa.StructArray.from_arrays(
            [pa.array(bins, pa.int64()), pa.array(offsets[line] + nth * length, pa.int64())], ["sequence_id", "offset"]
        )

    # A piece's rank among its length: pieces of earlier tasks, then its place in its own task.
    key = F.col("_part") * (capacity + 1) + F.col("length")
    tasks = placed.groupBy("_part", "length").agg((F.max("_nth") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select(key.alias("_key"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    ranked = lookup(placed.withColumn("_key", key), base, "_key")
    seated = ranked.withColumn("_seat", place("length", F.col("_base") + F.col("_nth")))
    return seated.select(
        *[c for c in placed.columns if not c.startswith("_")], "_seat.sequence_id", "_seat.offset"
    )


def pack(
    documents: DataFrame, path: str, end_id: int, capacity: int = 4096, keep_ids: bool = True
) -> DataFrame:
    """Packs documents (doc_id, text): one row for each piece with its sequence and offset.

    ``path`` names a tokenizers file. Without ``keep_ids`` only the ids' checksum stays.
    """
    return seat(stored(pieces(documents, path, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (unsigned 32-bit, little-endian) and n_tokens."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("_in"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("_in", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), "n_tokens")
