"""Token-id shards on shared storage with constant-time keyed access.

A shard is two files. ``.ids`` holds nothing but ids, little-endian, two or four bytes each.
``.idx`` holds the rows' keys and offsets and a minimal perfect hash from keys to rows with a
fingerprint for each, so that most look-ups of absent keys are refused at once; the rest are by the
stored key. Every keyed row is read by its key through the hash. A
manifest table written by Spark names the files of the tasks that counted: a task that is run
again writes files of its own, and files the manifest does not name mean nothing.

Documents are in ascending key order within and across shards. Null text is empty and still has
the end id. Rows with a null key come first and can be read in order only. Rows that repeat a
key are all kept, in the order of a hash of their text, and a look-up gives them all; many of them may
fill several shards, which then share the key. An empty table gives an empty manifest. The work folder may be on any file system that pyarrow can open.
"""

from __future__ import annotations

import functools
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlguard.llm.common import private, text_or_empty, text_slices
from urlguard.llm.perfect_hash import PerfectHash, fingerprint
from urlguard.llm.tokens import piece_encoder
from urlguard.session import new_folder

# --- fixed values: the shard format --------------------------------------------------------
MAGIC = b"IDSHARD1"
MANIFEST = "shard int, ids_file string, index_file string, first_key long, last_key long, n_rows long, n_ids long"
ROWS = "key long, place long, ids binary"
READ_IDS = 1 << 20  # ids read at once, or those of one row


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def pack_arrays(arrays: dict[str, np.ndarray], more: dict) -> bytes:
    """Magic, length of the header, JSON header, then the arrays one after the other."""
    header = json.dumps({"arrays": [[n, a.dtype.str, len(a)] for n, a in arrays.items()], **more}).encode()
    out = io.BytesIO()
    out.write(MAGIC + len(header).to_bytes(4, "little") + header)
    for array in arrays.values():
        out.write(array.tobytes())
    return out.getvalue()


def unpack_arrays(data: bytes) -> tuple[dict[str, np.ndarray], dict]:
    if data[:8] != MAGIC:
        raise ValueError("not a shard index")
    at = 12 + int.from_bytes(data[8:12], "little")
    header = json.loads(data[12:at])
    arrays = {}
    for name, kind, n in header.pop("arrays"):
        arrays[name] = np.frombuffer(data, kind, n, at)
        at += arrays[name].nbytes
    return arrays, header


def index_of(keys: np.ndarray, n_null: int, offsets: np.ndarray, width: int) -> bytes:
    """``keys`` are sorted and belong to the rows from ``n_null`` on."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slots = hashed.slots(distinct)
    prints, rows, repeats = (np.zeros(len(distinct), t) for t in (np.uint32, np.int64, np.int32))
    prints[slots], rows[slots], repeats[slots] = fingerprint(distinct), first + n_null, count
    arrays = {
        "keys": keys, "offsets": offsets, "sizes": hashed.sizes, "words": hashed.words,
        "prints": prints, "rows": rows, "repeats": repeats,
    }
    return pack_arrays(arrays, {"n_null": n_null, "width": width})


class Shard:
    """One shard, opened from its files."""

    def __init__(self, folder: str, ids_file: str, index_file: str):
        self.system, path = open_folder(folder)
        with self.system.open_input_stream(f"{path}/{index_file}") as file:
            arrays, more = unpack_arrays(file.read())
        self.keys, self.offsets = arrays["keys"], arrays["offsets"]
        self.prints, self.rows, self.repeats = arrays["prints"], arrays["rows"], arrays["repeats"]
        self.hashed = PerfectHash(arrays["sizes"], arrays["words"])
        self.n_null, self.kind = more["n_null"], np.dtype(f"<u{more['width']}")
        self.ids = self.system.open_input_file(f"{path}/{ids_file}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; -1 and 0 where the shard lacks it."""
        keys = np.asarray(keys, np.int64)
        if not len(self.prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int32)
        slots = self.hashed.slots(keys)
        held = (slots >= 0) & (self.prints[slots] == fingerprint(keys))
        rows = self.rows[slots]
        held &= self.keys[np.clip(rows - self.n_null, 0, len(self.keys) - 1)] == keys  # a print has 32 bits
        return np.where(held, rows, -1), np.where(held, self.repeats[slots], 0)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of rows ``first`` to ``last - 1``."""
        at, end = self.offsets[first] * self.kind.itemsize, self.offsets[last] * self.kind.itemsize
        self.ids.seek(int(at))
        return np.frombuffer(self.ids.read(int(end - at)), self.kind)

    def gather(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows with their joined ids, about READ_IDS at a time; neighbouring rows are one read."""
        upto = np.cumsum(self.offsets[rows + 1] - self.offsets[rows])
        at = 0
        while at < len(rows):
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + READ_IDS, "right")))
            part = rows[at:end]
            cuts = [0, *(np.flatnonzero(np.diff(part) != 1) + 1).tolist(), len(part)]
            yield part, np.concatenate([self.read(int(part[a]), int(part[b - 1]) + 1) for a, b in zip(cuts, cuts[1:])])
            at = end

    def by_key(self) -> np.ndarray:
        """The rows of all keys in order, each found through the hash; rows without a key before them."""
        distinct, counts = np.unique(self.keys, return_counts=True)
        first, repeats = self.find(distinct)
        if (first < 0).any() or (repeats != counts).any():
            raise ValueError("the index does not lead to the rows of its keys")
        nth = np.arange(len(self.keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.concatenate([np.arange(self.n_null), np.repeat(first, counts) + nth])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row of a key."""
        (first,), (n,) = self.find(np.array([key]))
        return [self.read(k, k + 1) for k in range(first, first + n)]


def write(documents: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> str:
    """Encodes documents into shards; returns the folder. ``path`` names a tokenizers file."""
    spark = documents.sparkSession
    folder = new_folder(spark, "shards")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        end = np.array([end_id], kind).tobytes()
        system, top = open_folder(folder)
        system.create_dir(top, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        keys, sizes, n_null = [], [], 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(f"{top}/{name}.ids")
            n_null += batch.column(0).null_count
            keys.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            for _, texts in text_slices(batch.column(1)):
                for ids in encoder.encode(texts):
                    sizes.append(len(ids) // 4 + 1)
                    out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        held = np.concatenate(keys)
        with system.open_output_stream(f"{top}/{name}.idx") as file:
            file.write(index_of(held, n_null, offsets, width))
        span = (int(held[0]), int(held[-1])) if len(held) else (None, None)
        yield pa.RecordBatch.from_pylist([{
            "shard": part, "ids_file": f"{name}.ids", "index_file": f"{name}.idx", "first_key": span[0],
            "last_key": span[1], "n_rows": len(sizes), "n_ids": int(offsets[-1]),
        }], pa.schema([
            ("shard", pa.int32()), ("ids_file", pa.string()), ("index_file", pa.string()), ("first_key", pa.int64()),
            ("last_key", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64()),
        ]))

    rows = documents.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    # Range partitions are in key order. A key that many rows share is cut by the hash of its texts.
    order = ["key", "hash", "text"]
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.select("key", "text").mapInArrow(write_shard, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard, with the number of ids in all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every shard, found through the index: key, place among all ids, ids (unsigned 32-bit)."""

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            shard = Shard(folder, row["ids_file"], row["index_file"])
            for rows, ids in shard.gather(shard.by_key()):
                sizes = shard.offsets[rows + 1] - shard.offsets[rows]
                edges = (np.concatenate([[0], np.cumsum(sizes)]) * 4).astype(np.int32)
                keys = [shard.keys[k - shard.n_null] if k >= shard.n_null else None for k in rows.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()),
                    pa.array(shard.offsets[rows] + row["start"], pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4").tobytes())]),
                ], ["key", "place", "ids"])

    shards = manifest(spark, folder)
    n = max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())
    return shards.repartition(n).mapInArrow(read_shard, ROWS)


def locate(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """Keyed access in bulk: rows of ``keys`` with the ids of each row that has the key.

    Keys meet the shards whose key span holds them (spans share at most their ends, where a key has
    rows in several), so only shards with a key asked for are opened. Absent and null keys give no row.
    """
    spark = keys.sparkSession
    (name,) = private("shard")
    spans = manifest(spark, folder).where("first_key is not null").select("shard", "first_key", "last_key").orderBy("shard").collect()
    starts, ends, numbers = (np.array([r[k] for r in spans], np.int64) for k in ("first_key", "last_key", "shard"))
    files = manifest(spark, folder).select(F.col("shard").alias(name), "ids_file", "index_file")

    @F.arrow_udf("array<int>")
    def shards_of(wanted: pa.Array) -> pa.Array:
        wanted = wanted.to_numpy(zero_copy_only=False)
        first, after = np.searchsorted(ends, wanted, "left"), np.searchsorted(starts, wanted, "right")
        return pa.array([numbers[a:b].tolist() for a, b in zip(first.tolist(), after.tolist())], pa.list_(pa.int32()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = functools.lru_cache(maxsize=1)(lambda ids, index: Shard(folder, ids, index))
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                found += [{"key": row["key"], "ids": ids.astype("<u4").tobytes()} for ids in opened(row["ids_file"], row["index_file"]).get(row["key"])]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.int64()), ("ids", pa.binary())]))

    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct()
    asked = asked.withColumn(name, F.explode(shards_of("key")))
    met = asked.join(files, name).select("key", "ids_file", "index_file").sortWithinPartitions("ids_file")
    return met.mapInArrow(look_up, "key long, ids binary")
