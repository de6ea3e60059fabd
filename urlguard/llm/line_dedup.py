"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

Line hashes with the number of documents that hold them live in runs: tables bucketed and sorted by
hash. Each batch is merge-joined with the runs, leaves out the keys that they have settled (found in enough
documents) and adds what is left as a run of its own; when a level has two runs they are
merged into one run of the next level, counts summed. Runs meet bucket by bucket in their order, without
being moved or sorted again. A manifest in the work folder names the runs of every level, so a batch of
another day can be added to them. Every key's documents are counted in full, so the result does
not depend on the order of batches.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case;
keys shorter than ``least_chars`` are never dropped. Keys are compared by 128-bit hashes. Null or
empty text is one empty line. Rows that repeat a doc_id are one document; rows without one (or a table
without the column) are documents of their own, equal rows one. Other columns pass unchanged (those named
like an added one are replaced); an empty table stays empty.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.llm.common import CLEANUP, local_rows, others, private, settings, stored, text_or_empty, text_slices
from urlguard.session import new_folder

BLANK = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]
RUN = [*KEY, "n"]
MANIFEST = "version int, buckets int, level int, nth int, path string"
# Sorted files count as sorted, and the shuffle files of a batch go when its run is written.
MERGING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", CLEANUP: "true"}
HALF = 1 << 63


def _hash(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def _keys(text: str) -> list[bytes]:
    """Key of each line; bytes.lower() changes A-Z only."""
    return [line.strip(BLANK) for line in text.encode().lower().split(b"\n")]


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode()) >= least_chars)


def line_hashes(text: Column | str, least_chars: int = 1) -> Column:
    """Distinct 128-bit hashes of a text's line keys: array of struct(hi long, lo long)."""

    @F.arrow_udf("array<struct<hi:long,lo:long>>")
    def hashes(texts: pa.Array) -> pa.Array:
        ends, his, los = [0], [], []
        for text in (t for _, part in text_slices(texts) for t in part):
            found = {_hash(k) for k in set(_keys(text)) if _long_enough(k, least_chars)}
            his.extend((h >> 64) - HALF for h in found)
            los.extend((h & (2 * HALF - 1)) - HALF for h in found)
            ends.append(len(his))
        pairs = pa.StructArray.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64())], KEY)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return hashes(text_or_empty(text))


def without_lines(text: Column | str, dropped: Column | str) -> Column:
    """Struct(n_lines, n_dropped, kept) of a text and the hashes of the keys to drop (or null)."""

    @F.arrow_udf("n_lines long, n_dropped long, kept string")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        totals, gone, kept = [], [], []
        for text, drop in zip((t for _, part in text_slices(texts) for t in part), drops.to_pylist()):
            if not drop:
                totals.append(text.count("\n") + 1)
                gone.append(0)
                kept.append(text)
                continue
            bad = {(d["hi"] + HALF) << 64 | (d["lo"] + HALF) for d in drop}
            lines = text.split("\n")
            stay = [line for line, key in zip(lines, _keys(text)) if _hash(key) not in bad]
            totals.append(len(lines))
            gone.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            ["n_lines", "n_dropped", "kept"],
        )

    return cut(text_or_empty(text), dropped)


class LineRuns:
    """The levelled runs (hi, lo, n) in a folder, each a table bucketed and sorted by its key.

    ``folder`` may be that of earlier batches: its latest manifest tells the runs. A key met in more
    than one run has its counts added up when runs are merged or read together.
    """

    def __init__(self, spark: SparkSession, threshold: int, folder: str | None = None, buckets: int | None = None):
        self.spark, self.threshold = spark, threshold
        self.folder = folder or new_folder(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.tables = 0, set()
        if folder:
            self._reopen()

    def _reopen(self) -> None:
        manifests = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        newest = manifests.where(F.col("version") == manifests.agg(F.max("version")).scalar()).orderBy("level", "nth").collect()
        for row in newest:
            self.version, self.buckets = row.version, row.buckets
            while len(self.levels) <= row.level:
                self.levels.append([])
            if row.path:
                self.levels[row.level].append(row.path)

    def _save(self) -> None:
        """Writes the levels down: a row for each run, of which there are as many as the batches' number has bits."""
        self.version += 1
        rows = [(self.version, self.buckets, level, nth, path) for level, paths in enumerate(self.levels) for nth, path in enumerate(paths)]
        local_rows(self.spark, rows, MANIFEST).write.mode("append").json(f"{self.folder}/manifest")

    def _table(self, path: str) -> str:
        name = f"run_{path.rsplit('-', 1)[1]}"
        self.tables.add(name)
        return name

    def _run(self, path: str) -> DataFrame:
        """A run as a bucketed table; the catalog holds no more than its description."""
        name = self._table(path)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (hi BIGINT, lo BIGINT, n BIGINT) USING parquet "
            f"CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        # One file for each bucket, so that a bucket is in order as it lies.
        dealt = run.select(*RUN).repartition(self.buckets, *KEY)
        with settings(self.spark, MERGING):
            dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(self._table(path))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    @staticmethod
    def _added(first: DataFrame, second: DataFrame) -> DataFrame:
        """Two runs merged: a join of tables that are in order already."""
        zero = F.lit(0).cast("long")
        a, b = first.withColumnRenamed("n", "a"), second.withColumnRenamed("n", "b")
        return a.join(b, KEY, "full").select(*KEY, (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("n"))

    def merged(self) -> DataFrame:
        """Documents of each key over all runs."""
        runs = [self._run(p) for level in self.levels for p in level]
        if not runs:
            return local_rows(self.spark, [], "hi long, lo long, n long")
        return reduce(self._added, runs)

    def settled(self) -> DataFrame:
        return self.merged().where(F.col("n") >= self.threshold).select(*KEY)

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """The keys of a batch that the runs have not settled.

        The batch is moved and sorted once and meets run after run in their order; with as many buckets
        as shuffle partitions no run is moved.
        """
        met, total = counted, F.lit(0).cast("long")
        for k, path in enumerate(p for level in self.levels for p in level):
            met = met.join(self._run(path).withColumnRenamed("n", f"n{k}"), KEY, "left")
            total = total + F.coalesce(F.col(f"n{k}"), F.lit(0))
        return met.where(total < self.threshold).select(*RUN)

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch: a row (hi, lo) for each document and distinct key in it."""
        counted = hashes.groupBy(*KEY).agg(F.count("*").alias("n"))
        self._write(self.unsettled(counted) if any(self.levels) else counted, 0)
        level = 0
        while len(self.levels[level]) > 1:
            first, second = self.levels[level]
            self._write(self._added(self._run(first), self._run(second)), level + 1)
            self.levels[level] = []
            level += 1
        self._save()

    def close(self) -> None:
        """Takes the runs out of the catalog; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def cuts(
    documents: DataFrame, threshold: int = 10, least_chars: int = 1, batches: int = 4, text: str = "text", doc_id: str = "doc_id"
) -> tuple[DataFrame, str]:
    """Documents with a struct of ``n_lines``, ``n_dropped`` and ``kept``, and its name.

    Documents are dealt to ``batches`` by hash; the batches are added in turn.
    """
    spark = documents.sparkSession
    first, second, doc, hashes, drops, out = private("first", "second", "doc", "hashes", "drops", "out")
    columns = [F.col(c) for c in documents.columns]
    # Rows of equal content share their decisions, so content names a row.
    named = documents.select("*", F.xxhash64(*columns).alias(first), F.xxhash64(F.lit(1), *columns).alias(second))
    ids = [c for c in documents.columns if c.lower() == doc_id.lower()]
    named = named.withColumn(doc, F.coalesce(*[F.col(c).cast("long") for c in ids], F.col(first)))
    exploded = named.select(first, second, doc, F.explode(line_hashes(text, least_chars)).alias(hashes))
    held = stored(exploded.select(first, second, doc, f"{hashes}.hi", f"{hashes}.lo"), "line-hashes")
    # Documents of several rows count once for a key.
    several = stored(named.groupBy(doc).agg(F.count("*").alias("n")).where("n > 1").select(doc), "line-repeats")
    counted = held.join(several, doc, "left_anti").select(doc, *KEY).unionAll(held.join(several, doc, "left_semi").select(doc, *KEY).distinct())
    runs = LineRuns(spark, threshold)
    for batch in range(batches):
        runs.add(counted.where(F.pmod(F.xxhash64(doc), F.lit(batches)) == batch).select(*KEY))
    with settings(spark, MERGING):
        settled = stored(runs.settled(), "settled-lines")
    runs.close()
    lost = held.join(settled, KEY).groupBy(first, second).agg(F.collect_set(F.struct(*KEY)).alias(drops))
    joined = named.join(lost, [first, second], "left")
    return joined.withColumn(out, without_lines(text, drops)).select(*documents.columns, out), out


def dedup(documents: DataFrame, *args, **settings) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept`` to documents with a text column, see cuts."""
    frame, out = cuts(documents, *args, **settings)
    return frame.select(*others(documents, "n_lines", "n_dropped", "kept"), f"{out}.*")


CHECK_SQL = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key AS shared FROM (SELECT DISTINCT doc_id, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(shared) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (shared IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = shared GROUP BY doc_id"""
