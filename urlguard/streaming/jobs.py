"""Long-running state of the scanner as Structured Streaming jobs."""

from __future__ import annotations

import itertools
import logging
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from urlguard import fixed_values as fv
from urlguard.functions.urls import scan_key, validate_url
from urlguard.operators.calibration import is_extreme
from urlguard.operators.gates import block_gate_by_keys, block_keys
from urlguard.operators.telemetry import audit_rows
from urlguard.plans.scan import Tables, scan
from urlguard.session import new_folder

log = logging.getLogger(__name__)


def batches_to(path: str, step: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function that writes what ``step`` makes of a micro-batch.

    The batch number names the output folder and replaces it, so a repeated batch leaves no
    second copy. The batch is kept while it is worked on, since a step reads it more than once.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return run


def stream_scan(urls: DataFrame, tables: Callable[[], Tables], as_of: str, path: str, columns: list[str] | None = None):
    """Writer of verdicts for a stream of URLs: each micro-batch goes through the batch plan.

    ``tables`` gives the look-ups as they are now. With prepared look-ups (plans/stored.py) a
    micro-batch parses no page and groups no host table: it reads the prepared rows that its keys ask for.
    """
    step = lambda batch: scan(batch, tables(), as_of).select(*(columns or ["*"]))
    return urls.writeStream.foreachBatch(batches_to(path, step))


RUN = 1 << 18  # rows of a key sorted in memory
SLICE = 60_000_000  # microseconds of a slice of a longer timeline
READ = 1 << 10  # rows handed on at once


class InOrder:
    """One key's rows of a micro-batch in order, in bounded memory.

    Up to ``run`` rows are sorted in memory. Rows beyond that wait in a map state, which the
    RocksDB store keeps on disk, by slice of time; the slices are then read in turn and
    removed. Nothing stays in the state after the batch.
    """

    def __init__(self, handle: StatefulProcessorHandle, order: list[str], run: int = RUN):
        self.waiting = handle.getMapState("waiting", "slice long, part int", "rows binary")
        self.order, self.run = order, run

    def _sorted(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).sort_values(self.order, kind="stable", ignore_index=True)

    def _put(self, frames: list[pd.DataFrame], parts: Counter) -> None:
        rows = pd.concat(frames)
        for piece, group in rows.groupby(rows[self.order[0]] // SLICE):
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_pandas(group, preserve_index=False)
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            self.waiting.updateValue((int(piece), parts[piece]), (sink.getvalue().to_pybytes(),))
            parts[piece] += 1

    def _taken(self, key: tuple[int, int]) -> pd.DataFrame:
        rows = pa.ipc.open_stream(self.waiting.getValue(key)[0]).read_pandas()
        self.waiting.removeKey(key)
        return rows

    def frames(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows, sorted by the order columns, in frames that follow each other."""
        held, n, parts = [], 0, Counter()
        for rows in batches:
            for start in range(0, len(rows), self.run):
                held.append(rows.iloc[start : start + self.run])
                n += len(held[-1])
                if n >= self.run:
                    self._put(held, parts)
                    held, n = [], 0
        if parts and held:
            self._put(held, parts)
            held = []
        if held:
            yield self._sorted(held)
        for piece in sorted(parts):
            yield self._sorted([self._taken((int(piece), k)) for k in range(parts[piece])])


def alone(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Sets a key's only timer."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The event time as TIMESTAMP, which watermarks need (the session is UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


class FirstOfHour(StatefulProcessor):
    """Passes a row of a key unless one was passed less than ``width`` microseconds before."""

    def __init__(self, columns: list[str], width: int, tie: str, run: int = RUN):
        self.columns, self.width, self.tie, self.run = columns, width, tie, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.ordered = InOrder(handle, ["moment", self.tie], self.run)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for frame in self.ordered.frames(rows):
            at, kept = frame["moment"].to_numpy(np.int64), []
            position = 0 if last is None else int(at.searchsorted(last + self.width))
            while position < len(at):
                kept.append(position)
                last = int(at[position])
                position = int(at.searchsorted(last + self.width))
            if kept:
                yield frame.iloc[kept][self.columns]
        self.last.update((last,))
        alone(self.handle, (last + self.width) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


BUCKETS = 1 << 12  # scan keys share so many states


def first_of_hours(key: np.ndarray, at: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, last): the rows that pass, and each key's last one after them.

    Rows are in order of time; ``key`` numbers their keys from 0, ``last`` is what each key passed last (NEVER:
    nothing). All keys go from row to row side by side.
    """
    order = np.argsort(key, kind="stable")
    times, rank = np.unique(at[order], return_inverse=True)
    place, ends = key[order] * (len(times) + 1) + rank, np.cumsum(np.bincount(key, minlength=len(last)))
    last, going, kept = last.copy(), np.arange(len(last)), [np.zeros(0, np.int64)]
    while len(going):
        due = np.where(last[going] == NEVER, NEVER, last[going] + width)
        row = np.searchsorted(place, going * (len(times) + 1) + np.searchsorted(times, due))
        going, row = going[row < ends[going]], row[row < ends[going]]
        last[going] = at[order[row]]
        kept.append(order[row])
    return np.sort(np.concatenate(kept)), last


NEVER = np.iinfo(np.int64).min


class FirstOfHours(FirstOfHour):
    """The same for a bucket of keys: what is paid for each state is paid for many keys at once.

    The state is the bucket's keys with the instant each passed last. Keys whose hour the watermark has
    passed are dropped when the bucket is met again, or by its timer when the hour of all of them has passed.
    """

    def __init__(self, key: str, columns: list[str], width: int, tie: str, run: int = RUN):
        super().__init__(columns, width, tie, run)
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "keys array<string>, at array<bigint>")
        self.ordered = InOrder(handle, ["moment", self.tie], self.run)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, at = self.last.get() if self.last.exists() else ([], [])
        known = pd.Series(np.array(at, np.int64), index=pd.Index(keys, dtype=object))
        for frame in self.ordered.frames(rows):
            codes, names = pd.factorize(frame[self.key].astype(object))
            before = known.reindex(names, fill_value=NEVER).to_numpy(np.int64)
            kept, last = first_of_hours(codes, frame["moment"].to_numpy(np.int64), before, self.width)
            known = pd.concat([known[~known.index.isin(names)], pd.Series(last, index=names)])
            if len(kept):
                yield frame.iloc[kept][self.columns]
        known = known[(known + self.width) // 1000 + 1 > timerValues.getCurrentWatermarkInMs()]
        if len(known):
            self.last.update((known.index.tolist(), known.tolist()))
            alone(self.handle, (int(known.max()) + self.width) // 1000 + 1)
        else:
            self.last.clear()


def first_of_instant(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Of a key's rows at one instant the one with the smallest ``tie``, as far as a batch of rows tells.

    This runs before rows are moved to their key, so a hot key moves less.
    """

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(tie, kind="stable").drop_duplicates([key, "moment"])

    return rows.mapInPandas(reduce, rows.schema)


def stream_dedup(scans: DataFrame, ts: str = "ts", ttl: int = 3600, tie: str = "scan_id", run: int = RUN) -> DataFrame:
    """Drops a repeat of a scan key within ``ttl`` seconds of the scan that was kept.

    The hour counts from the kept scan and is not prolonged by repeats; of scans at one instant
    the one with the smallest ``tie`` counts. Trusted and invalid input is not remembered: it
    passes unchanged. A key is forgotten when the watermark passes its hour, so the state holds the
    keys of about two hours. Keys are handled by bucket of their hash, many in one state.
    """
    remembered = validate_url(F.col("url"))["ok"]
    if "is_trusted" in scans.columns:
        remembered = remembered & ~F.col("is_trusted")
    marked = event_time(scans, ts).withColumns(
        {"scan_key": scan_key(F.col("url")), "_remembered": F.coalesce(remembered, F.lit(False))}
    )
    columns = [*scans.columns, "scan_key"]
    passing = marked.filter(~F.col("_remembered")).select(*columns)
    # The state's rows go through named tuples, whose names have rules of their own.
    short = {name: f"c{k}" for k, name in enumerate(columns)}
    keyed = marked.filter("_remembered").select(
        *[F.col(name).alias(c) for name, c in short.items()], F.unix_micros(ts).alias("moment")
    )
    waiting = first_of_instant(keyed, short["scan_key"], short[tie]).withWatermark(short[ts], "1 hour")
    bucket = F.pmod(F.xxhash64(short["scan_key"]), F.lit(BUCKETS)).alias("bucket")
    kept_rows = waiting.select("*", bucket).groupBy("bucket").transformWithStateInPandas(
        FirstOfHours(short["scan_key"], list(short.values()), ttl * 1_000_000, short[tie], run),
        keyed.select(*short.values()).schema, "Append", "EventTime",
    )
    return kept_rows.select(*[F.col(c).alias(name) for name, c in short.items()]).unionByName(passing)


class RefreshedBlocklist:
    """A blocklist that is read again when its snapshot is older than ``interval`` seconds.

    A snapshot has a version and the time it was read, and lies in the work folder in the form
    that the gate meets: keys, not feeds. If a reading fails the last snapshot stays in use, and the next
    call tries again. A restarted stream reads anew.
    """

    def __init__(
        self, read: Callable[[], DataFrame], psl: DataFrame, interval: float = fv.BLOCKLIST_REFRESH_SECONDS,
        clock: Callable[[], float] = time.time,
    ):
        self.read, self.psl, self.interval, self.clock = read, psl, interval, clock
        self.version, self.read_at = 0, None
        self.urls = self.domains = None

    def _stored(self, frame: DataFrame, kind: str) -> DataFrame:
        path = new_folder(frame.sparkSession, f"blocklist-{kind}-{self.version + 1}")
        frame.write.parquet(path)
        return frame.sparkSession.read.schema(frame.schema).parquet(path)

    def current(self) -> "RefreshedBlocklist":
        now = self.clock()
        if self.read_at is None or now - self.read_at > self.interval:
            try:
                urls, domains = block_keys(self.read(), self.psl)
                self.urls, self.domains = self._stored(urls, "urls"), self._stored(domains, "domains")
            except PySparkException:
                if self.read_at is None:
                    raise
                log.warning("blocklist refresh failed, version %d stays", self.version, exc_info=True)
            else:
                self.version, self.read_at = self.version + 1, now
        return self


def refreshing_gate(scans: DataFrame, blocklist: RefreshedBlocklist, path: str):
    """Writer that gates each micro-batch with the blocklist's snapshot of that time.

    Rows tell the version of the snapshot (``list_version``).
    """

    def step(batch: DataFrame) -> DataFrame:
        now = blocklist.current()
        gated = block_gate_by_keys(batch, now.urls, now.domains, now.psl)
        return gated.withColumn("list_version", F.lit(now.version))

    return scans.writeStream.foreachBatch(batches_to(path, step))


def stream_telemetry(scans: DataFrame) -> DataFrame:
    """Scans per hour and verdict; rows more than ten minutes late are dropped."""
    return (
        event_time(scans).withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"), "verdict")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "verdict", "n")
    )


def stream_drift(scores: DataFrame) -> DataFrame:
    """Rows, variance and extreme share of the last hour, every ten minutes."""
    p = F.col("y_prob")
    return (
        event_time(scores).withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour", "10 minutes").alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.var_pop(p).alias("variance"),
            F.avg(is_extreme(p).cast("double")).alias("extreme_share"),
        )
        .select(
            F.col("w.start").alias("window_start"), "n", "variance", "extreme_share",
            ((F.col("n") >= fv.MIN_DRIFT_ROWS) & (F.col("extreme_share") > fv.EXTREME_SHARE)).alias("drift"),
            ((F.col("n") >= fv.MIN_DRIFT_ROWS) & (F.col("variance") < fv.COLLAPSE_VARIANCE)).alias("collapsed"),
        )
    )


# ------------------------------------------------------------------ anchored hourly budget

HOUR = 3_600_000_000
BUDGET_STATE = T.StructType(
    [
        T.StructField("used", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("frozen", T.BooleanType()),
    ]
)
BUDGET_OUTPUT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("used", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
    ]
)


def spend(at: int, used: int, start: int | None, frozen: bool, limit: int):
    """One event against the budget: (used, start, frozen, outcome).

    The hour begins at the first event and begins anew with the first event more than an
    hour later. An event that finds the budget used up freezes the key.
    """
    if frozen:
        return used, start, True, "frozen"
    if start is None or at - start > HOUR:
        used, start = 0, at
    if used >= limit:
        return used, start, True, "exhausted"
    return used + 1, start, False, "granted"


class Budget(StatefulProcessor):
    """One key's override events against its hourly budget."""

    def __init__(self, limit: int, run: int = RUN):
        self.limit, self.run = limit, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.budget = handle.getValueState("budget", BUDGET_STATE)
        self.ordered = InOrder(handle, ["at", "event_id"], self.run)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, start, frozen = self.budget.get() if self.budget.exists() else (0, None, False)
        for frame in self.ordered.frames(rows):
            events = zip(frame["at"].tolist(), frame["event_id"].tolist())
            while out := list(itertools.islice(events, READ)):
                for k, (at, event_id) in enumerate(out):
                    used, start, frozen, outcome = spend(at, used, start, frozen, self.limit)
                    out[k] = (key[0], event_id, at, used, outcome)
                yield pd.DataFrame(out, columns=BUDGET_OUTPUT.fieldNames())
        self.budget.update((used, start, frozen))
        if not frozen:
            alone(self.handle, (start + HOUR) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The hour is over: a later event would begin a new one, unless the key is frozen."""
        if self.budget.exists() and not self.budget.get()[2]:
            self.budget.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_budget(
    events: DataFrame, key: str, limit: int = fv.OVERRIDES_PER_HOUR, late: str = "1 hour", run: int = RUN
) -> DataFrame:
    """Outcome of every override event: granted, exhausted (freezes) or frozen.

    The order of events decides, so one key is one state. Only key, id and instant go to
    Python. The state of a key that falls silent is dropped when the watermark, ``late`` behind
    the newest event, passes its hour; a frozen key stays. Rows without an instant take no part.
    """
    when = F.col("ts").cast("timestamp")
    slim = events.select(
        F.col(key).cast("string").alias("key"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.unix_micros(when).alias("at"), when.alias("ts"),
    )
    waiting = slim.filter("at IS NOT NULL").withWatermark("ts", late)
    return waiting.groupBy("key").transformWithStateInPandas(Budget(limit, run), BUDGET_OUTPUT, "Append", "EventTime")


# ------------------------------------------------------------------ sinks


def stream_audit(scans: DataFrame, path: str, checkpoint: str):
    """Writer of JSON audit lines by day; the file sink commits each batch once."""
    return (
        audit_rows(scans)
        .writeStream.format("text")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def finish(writer) -> None:
    """Processes everything that is there, then stops."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all available input into a table in the work folder."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    finish(
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
        .outputMode("append")
    )
    return spark.read.schema(stream.schema).parquet(path)


def update_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream in update mode; the newest row per key is the result."""
    spark = stream.sparkSession
    path = new_folder(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    finish(
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
        .outputMode("update")
    )
    rows = spark.read.parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")
