"""Removal of byte strings that an earlier document has too, by a distributed sparse suffix array.

Every ``length``-byte string (50) of a text is represented by one suffix: the one that starts at the
smallest hashed 24-byte token run inside the string. Neighbouring strings with the same suffix form a
run; equal strings choose equal suffixes, so a repeated string is never missed, and there is one
suffix for some fourteen bytes instead of one for each.

1. Suffixes are range-partitioned by their leading tokens (three words of eight bytes), with splitters
   from a sample. Splitters go on to the fingerprint of the run and to the document, so a passage that
   a third of all documents hold is spread over many buckets.
2. A bucket sorts its suffixes locally by multikey quicksort: by the first token, and only where that
   ties by the next one, down to fingerprint and document. The first of equal runs has the smallest
   document; the others are removed.
3. What the first and the last suffix of a bucket have in common with the next bucket is settled by
   comparing those groups across boundaries.
4. Runs that stay, but share their suffix's tokens with a different run, may still hold a string of
   it (they lie at the edges of shared passages). All their strings go through steps 1 to 3 once more,
   each as a run of its own.

Strings are equal if 24 leading bytes and a 64-bit fingerprint of all their bytes are. The whole 50
bytes of every suffix would not fit the disk budget (some 4 GB for 0.5 GB of documents).

Strings are judged on the input, only against documents with a smaller doc_id, and never cross
documents. Null text is empty. Rows with a null doc_id have no order: they lose nothing and nothing
is lost to them. Rows that repeat a doc_id are not smaller than each other. Other columns pass
unchanged (those named like an added one are replaced); an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.llm.common import others, private, stored, text_or_empty
from urlguard.llm.spans import scramble
from urlguard.operators.lookup import lookup

LENGTH = 50  # bytes of the strings compared
TOKEN = 8
SIGN = np.uint64(1 << 63)  # with it, signed numbers sort as unsigned ones
LEAD = 3 * TOKEN  # bytes of a suffix that are compared as they are
PIECE = 1 << 18  # bytes of text handled at once
HELD = 1 << 18  # suffixes a task holds before it deals them out
PER_BUCKET = 1 << 23  # bytes of text for a bucket at most
SAMPLE = 64  # sampled suffixes for each bucket
SAMPLED_BYTES = 1 << 19  # bytes of text sampled for each bucket
KEY = ["w0", "w1", "w2", "print"]  # the four sort tokens, before the document
NAMES = [*KEY, "doc"]
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
MARK, SUSPECT, EDGE, MIXED = 0, 1, 2, 3
VERDICT = "kind byte, w0 long, w1 long, w2 long, print long, doc long"


def _slid(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse (mod 2^64)."""
    numbers = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0xD1342543DE82EF95
    up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return numbers, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Piece:
    """Neighbouring whole texts, or a part of a long one, with the runs of their strings."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, length: int):
        self.length, self.starts, self.ends = length, starts, ends
        self.size, self.data = len(data), data + bytes(TOKEN)
        at = np.ndarray((self.size + 1,), ">u8", self.data, strides=(1,))
        self.words = at.astype(np.uint64)
        numbers, up, self.down = _powers(max(2 * PIECE, 1 << self.size.bit_length()))
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(numbers[np.frombuffer(data, np.uint8)] * up[: self.size], out=self.sums[1:])

    def tokens(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.words[at + k] for k in range(0, LEAD, TOKEN)]

    def prints(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes of strings first to last."""
        end = last + self.length
        return scramble((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def _valid(self, count: int) -> np.ndarray:
        """Which of the strings lie inside one text."""
        steps = np.zeros(count + 1, np.int32)
        ok = self.ends - self.starts >= self.length
        np.add.at(steps, self.starts[ok], 1)
        np.add.at(steps, self.ends[ok] - self.length + 1, -1)
        return np.cumsum(steps[:count]) > 0

    def strings(self) -> np.ndarray:
        """Starts of all strings."""
        return np.flatnonzero(self._valid(max(0, self.size - self.length + 1)))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run its suffix and its first and last string."""
        if self.size < self.length:
            return (np.zeros(0, np.int64),) * 3
        count = self.size - LEAD + 1
        mixed = np.zeros(count, np.uint64)
        for k, factor in zip(range(0, LEAD, TOKEN), FACTORS):
            mixed += self.words[k : k + count] * factor
        # The low bits tell the place, counted from the start of the text, so ties do not depend on neighbours.
        place = np.arange(self.size) - np.repeat(self.starts, self.ends - self.starts)
        least = _slid((scramble(mixed) & ~np.uint64(63)) | (place[:count] & 63).astype(np.uint64), self.length - LEAD + 1)
        begin = np.arange(len(least))
        chosen = begin + (((least & np.uint64(63)).astype(np.int64) - place[: len(least)]) & 63)
        valid = self._valid(len(least))
        change = chosen[1:] != chosen[:-1]
        first = np.flatnonzero(valid & np.concatenate([[True], change | ~valid[:-1]]))
        last = np.flatnonzero(valid & np.concatenate([change | ~valid[1:], [True]]))
        return chosen[first], first, last


def pieces(column: pa.Array, length: int = LENGTH) -> Iterator[tuple[Piece, np.ndarray, int]]:
    """Pieces of a column of texts with the rows of their texts and the place in a text that was cut.

    Where a text is cut depends on nothing but the text.
    """
    column = column.cast(pa.binary()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    sizes = np.diff(offsets)
    row = 0
    while row < len(column):
        if sizes[row] > PIECE:
            for cut in range(0, int(sizes[row]), PIECE):
                part = bytes(data[offsets[row] + cut : min(offsets[row + 1], offsets[row] + cut + PIECE + length - 1)])
                yield Piece(part, np.array([0]), np.array([len(part)]), length), np.array([row]), cut
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        rows = np.arange(row, end)
        yield Piece(bytes(data[offsets[row] : offsets[end]]), offsets[row:end] - offsets[row], offsets[row + 1 : end + 1] - offsets[row], length), rows, 0
        row = end


Suffixes = list[np.ndarray]  # a column for each of NAMES, as unsigned numbers


def _suffixes(docs: pa.Array, texts: pa.Array, length: int, every: bool) -> Iterator[Suffixes]:
    """Suffixes of a batch: one for each run, or for ``every`` string."""
    ids = docs.to_numpy(zero_copy_only=False).view(np.uint64)
    for piece, rows, _ in pieces(texts, length):
        if every:
            first = last = at = piece.strings()
        else:
            at, first, last = piece.runs()
        yield [*piece.tokens(at), piece.prints(first, last), ids[rows[piece.text_of(first)]] ^ SIGN]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by these columns: by the first, and where rows tie, by the next ones."""
    order = np.argsort(columns[0])
    if len(order) < 2:
        return order
    same = columns[0][order]
    same = same[1:] == same[:-1]
    for column in columns[1:]:
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        if not len(tied):
            break
        rows = order[tied]
        # Neighbouring groups of ties are told apart by a number.
        group = np.cumsum(~np.append(False, same))[tied]
        values = column[rows]
        inner = np.argsort(values)
        inner = inner[np.argsort(group[inner], kind="stable")]
        order[tied] = rows[inner]
        values = values[inner]
        equal = (values[1:] == values[:-1]) & (group[1:] == group[:-1])
        same = np.zeros(len(order) - 1, bool)
        same[tied[1:][equal] - 1] = True
    return order


def in_order(found: Suffixes) -> Suffixes:
    order = multikey_order(found)
    return [column[order] for column in found]


def together(parts: list[Suffixes]) -> Suffixes:
    return [np.concatenate(columns) for columns in zip(*parts)]


def _changes(ordered: Suffixes, columns: int) -> np.ndarray:
    """Which rows differ from the one before in the first ``columns``; the first row does."""
    return np.append(True, functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in ordered[:columns])))


def _distinct(ordered: Suffixes) -> Suffixes:
    """One of equal rows: runs of a document that are alike share their fate."""
    new = _changes(ordered, len(NAMES))
    return ordered if new.all() or not len(ordered[0]) else [column[new] for column in ordered]


def packed(found: Suffixes) -> bytes:
    """Rows as compressed planes of bytes: sorted tokens differ little."""
    planes = np.empty((len(NAMES), 8, len(found[0])), np.uint8)
    for plane, column in zip(planes, found):
        plane[:] = np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(planes)


def unpacked(blob: bytes) -> Suffixes:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(len(NAMES), 8, -1)
    return [np.ascontiguousarray(plane.T).view(np.uint64)[:, 0] for plane in planes]


def _buckets_of(found: Suffixes, splitters: Suffixes) -> list[int]:
    """Where the buckets after the first begin among rows in order."""
    places = []
    for splitter in zip(*splitters):
        low, high = 0, len(found[0])
        for column, token in zip(found, splitter):
            own = column[low:high]
            low, high = low + int(np.searchsorted(own, token, "left")), low + int(np.searchsorted(own, token, "right"))
            if low == high:
                break
        places.append(low)
    return places


def _sampled(length: int, every: bool, share: float):
    """A share of a batch's suffixes, chosen by hash."""
    limit = np.uint64(min(share, 1.0) * (2**64 - 2048))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _suffixes(*batch.columns, length, every):
                take = scramble(found[3] + scramble(found[4])) <= limit
                yield pa.RecordBatch.from_arrays([pa.array([packed([column[take] for column in found])], pa.binary())], ["rows"])

    return run


def _dealt(length: int, every: bool, splitters: Suffixes):
    """Rows (bucket, suffixes in order), a task's suffixes dealt out by the splitters."""

    def deal(held: list[Suffixes]) -> pa.RecordBatch:
        found = _distinct(in_order(together(held)))
        edges = [0, *_buckets_of(found, splitters), len(found[0])]
        full = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        blobs = pa.array([packed([column[a:b] for column in found]) for _, a, b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in full], pa.int32()), blobs], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for found in _suffixes(*batch.columns, length, every):
                held.append(found)
                count += len(found[0])
                if count >= HELD:
                    yield deal(held)
                    held, count = [], 0
        if count:
            yield deal(held)

    return run


def _verdicts(suspects: bool):
    """Sorts each bucket and judges its suffixes.

    Only the first and the last run of a bucket can go on in another one. Their first rows are left
    open: EDGE, or MIXED where the bucket shows that the run's tokens have a different run too.
    """

    def told(kind: int, found: Suffixes, rows: np.ndarray) -> pa.RecordBatch:
        own = [column[rows] for column in found]
        own[-1] = own[-1] ^ SIGN
        columns = [pa.array(np.full(len(own[0]), kind, np.int8)), *(pa.array(column.view(np.int64)) for column in own)]
        return pa.RecordBatch.from_arrays(columns, ["kind", *NAMES])

    def judge(found: Suffixes) -> Iterator[pa.RecordBatch]:
        docs = found[-1]
        new_run, new_group = _changes(found, 4), _changes(found, 3)
        run, group = np.cumsum(new_run) - 1, np.cumsum(new_group) - 1
        later = docs[np.flatnonzero(new_run)][run] < docs
        yield told(MARK, found, later)
        at_edge = ~later & ((run == 0) | (run == run[-1]))
        opens = np.flatnonzero(new_group)
        several = np.add.reduceat(new_run.astype(np.int64), opens) > 1
        yield told(EDGE, found, at_edge & ~several[group])
        yield told(MIXED, found, at_edge & several[group])
        if suspects:  # a group inside the bucket is whole: with one document it has nothing to lose
            several[1:-1] &= (np.minimum.reduceat(docs, opens) != np.maximum.reduceat(docs, opens))[1:-1]
            yield told(SUSPECT, found, several[group] & ~later & ~at_edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, blob in zip(*(column.to_pylist() for column in batch.columns)):
                if bucket != now and parts:
                    found, parts = together(parts), []
                    yield from judge(in_order(found))
                now = bucket
                parts.append(unpacked(blob))
        if parts:
            found, parts = together(parts), []
            yield from judge(in_order(found))

    return run


def _splitters(sample: list[Suffixes], buckets: int) -> Suffixes:
    if not sample:
        return [np.zeros(0, np.uint64)] * len(NAMES)
    found = in_order(together(sample))
    at = np.arange(1, buckets) * len(found[0]) // buckets
    return _distinct([column[at] for column in found])


def repeated(texts: DataFrame, length: int, every: bool) -> DataFrame:
    """Verdicts (kind, ..., print, doc) on the strings of texts (doc long, text): MARK or SUSPECT.

    A marked print occurs in a document with a smaller number than doc. A suspect run is the first of
    its kind but shares its suffix's tokens with a different one.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_BUCKET))
    share = min(1.0, buckets * SAMPLED_BYTES / max(1, total))
    chosen = F.pmod(F.xxhash64("doc", F.octet_length("text")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    # A string is a suffix of its own, a run takes some ten bytes; at most SAMPLE rows for each bucket come to the driver.
    expected = total * share / (1 if every else 10)
    sample = texts.where(chosen).mapInArrow(_sampled(length, every, SAMPLE * buckets / max(1, expected)), "rows binary").collect()
    splitters = _splitters([unpacked(row["rows"]) for row in sample], buckets)
    dealt = texts.mapInArrow(_dealt(length, every, splitters), "bucket int, rows binary")
    judged = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_verdicts(not every), VERDICT)
    judged = stored(judged, "suffix-verdicts")

    # Runs at the boundaries, at most two of a bucket.
    edges = judged.where(F.col("kind") >= EDGE).distinct()
    firsts = edges.groupBy(*KEY).agg(F.min("doc").alias("first"))
    groups = edges.groupBy(*KEY[:3]).agg(((F.min("print") != F.max("print")) | (F.max("kind") == MIXED)).alias("several"))
    met = lookup(lookup(edges, firsts, KEY, "inner"), groups, KEY[:3], "inner")
    verdict = F.when(F.col("doc") > F.col("first"), MARK).when(F.col("several"), SUSPECT)
    settled = met.select(verdict.cast("byte").alias("kind"), "print", "doc").where("kind is not null")
    return judged.where(F.col("kind") < EDGE).select("kind", "print", "doc").unionAll(settled)


def _runs_in(texts: Column, prints: Column, length: int) -> Column:
    """The bytes of a text's runs that have these prints."""

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array, prints: pa.Array) -> pa.Array:
        wanted = _lists(prints)
        found: list[dict] = [{} for _ in wanted]
        for piece, rows, _ in pieces(texts, length):
            _, first, last = piece.runs()
            marks, owner = piece.prints(first, last), rows[piece.text_of(first)]
            for row, a, b in _by_row(owner):
                hit = np.flatnonzero(np.isin(marks[a:b], wanted[row])) + a
                found[row].update((int(marks[k]), piece.data[first[k] : last[k] + length]) for k in hit.tolist())
        return pa.array([list(f.values()) for f in found], pa.list_(pa.binary()))

    return cut(texts, prints)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The prints of each row."""
    edges = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].tolist()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] if ok else None for a, b, ok in zip(edges, edges[1:], column.is_valid().to_pylist())]


def _by_row(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal rows: (row, start, end)."""
    edges = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(owner)]):
        if b > a:
            yield int(owner[a]), a, b


def _joined(ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Maximal spans of ranges (starts, ends) that overlap or touch."""
    first, end = (np.concatenate(side) for side in zip(*ranges))
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return list(zip(first[new].tolist(), reach[np.append(new[1:] - 1, len(first) - 1)].tolist()))


def without_spans(texts: Column, marked: Column, tested: Column, found: Column, length: int) -> Column:
    """Struct(n_bytes, n_removed, spans, kept) of a text.

    ``marked`` are prints of runs to remove; of runs in ``tested`` the strings in ``found`` go.
    """

    @F.arrow_udf("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    def cut(texts: pa.Array, marked: pa.Array, tested: pa.Array, found: pa.Array) -> pa.Array:
        texts = texts.cast(pa.binary())
        sets = [_lists(column) for column in (marked, tested, found)]
        ranges: dict[int, list] = {}
        for piece, rows, cut_at in pieces(texts, length):
            _, first, last = piece.runs()
            prints, owner = piece.prints(first, last), rows[piece.text_of(first)]
            for row, a, b in _by_row(owner):
                gone, open_, strings = (s[row] for s in sets)
                base = 0 if cut_at else int(piece.starts[row - rows[0]])
                if gone is not None:
                    hit = np.flatnonzero(np.isin(prints[a:b], gone)) + a
                    ranges.setdefault(row, []).append((first[hit] - base + cut_at, last[hit] - base + cut_at + length))
                if strings is not None and open_ is not None:
                    hit = np.flatnonzero(np.isin(prints[a:b], open_)) + a
                    counts = last[hit] - first[hit] + 1
                    each = np.repeat(first[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    each = each[np.isin(piece.prints(each, each), strings)]
                    ranges.setdefault(row, []).append((each - base + cut_at, each - base + cut_at + length))
        kept, sizes, removed, spans = [], [], [], []
        offsets = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].tolist()
        data = memoryview(texts.buffers()[2] or b"")
        for row, (begin, end) in enumerate(zip(offsets, offsets[1:])):
            own = _joined(ranges[row]) if row in ranges else []
            edges = [begin, *(begin + edge for span in own for edge in span), end]
            kept += (data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            sizes.append(end - begin)
            removed.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "end": b} for a, b in own])
        ends = np.cumsum([0, *(size - gone for size, gone in zip(sizes, removed))]).astype("<i4")
        left = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(kept))])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), left]
        return pa.StructArray.from_arrays(columns, ["n_bytes", "n_removed", "spans", "kept"])

    return cut(texts, marked, tested, found)


def dedup(documents: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``spans`` (removed, as byte ranges) and ``kept`` (bytes).

    ``length`` is at least 24 and at most 87 bytes: the place inside a string takes six bits.
    """
    if not LEAD <= length <= LEAD + 63:
        raise ValueError(f"strings have {LEAD} to {LEAD + 63} bytes")
    texts = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    texts = texts.where(F.octet_length("text") >= length)
    judged = stored(repeated(texts, length, every=False), "suffix-runs")

    def gathered(frame: DataFrame, kind: int, name: str) -> DataFrame:
        return frame.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_set("print").alias(name))

    tested = stored(gathered(judged, SUSPECT, "tested"), "suffix-suspects")
    open_runs = texts.join(tested, "doc").select("doc", F.explode(_runs_in(F.col("text"), F.col("tested"), length)).alias("text"))
    open_runs = stored(open_runs.distinct(), "suffix-open")
    found = gathered(repeated(open_runs, length, every=True), MARK, "found")
    known = gathered(judged, MARK, "marked").join(tested.join(found, "doc"), "doc", "full")
    known = stored(known, "suffix-known")

    doc, marked, strings, open_, out = private("doc", "marked", "found", "tested", "out")
    known = known.select(F.col("doc").alias(doc), F.col("marked").alias(marked), F.col("tested").alias(open_), F.col("found").alias(strings))
    told = lookup(documents.withColumn(doc, F.col(doc_id).cast("long")), known, doc, "left")
    cut = without_spans(text_or_empty(text), F.col(marked), F.col(open_), F.col(strings), length)
    return told.withColumn(out, cut).select(*others(documents, "n_bytes", "n_removed", "spans", "kept"), f"{out}.*")


CHECK_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f ON w.s = f.s WHERE m < doc_id),
b AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
r AS (SELECT doc_id, span, min(i) AS low, max(i) + 50 AS high FROM n GROUP BY doc_id, span),
k AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM r),
t AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS kept,
         max(high) AS upto, sum(high - low) AS gone, count(*) AS spans
  FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * upto + 1), h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""
