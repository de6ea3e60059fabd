"""State, refreshes and look-ups of the streams."""

import random
import weakref
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from urlguard.functions import features as fx
from urlguard.plans.inputs import AS_OF, Inputs
from urlguard.plans.scan import scan
from urlguard.plans.stored import KeyedTable, StoredLookups
from urlguard.plans.url_queries import one_feature, tables
from urlguard.session import new_folder
from urlguard.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


# ------------------------------------------------------------------ one key's rows in order


class FakeValue:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeMap(dict):
    most = 0

    def updateValue(self, key, value):
        assert key not in self
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


class FakeHandle:
    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, set()

    def getValueState(self, name, schema):
        return self.values.setdefault(name, FakeValue())

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, FakeMap())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Frames:
    """Frames of one hot key, and how many of them were alive at once."""

    def __init__(self, at):
        self.at, self.most, self.seen = at, 0, []

    def __iter__(self):
        for k in range(0, len(self.at), 50):
            at = self.at[k : k + 50]
            rows = pd.DataFrame({"moment": at, "at": at, "event_id": range(k, k + len(at))})
            self.seen.append(weakref.ref(rows))
            yield rows
            del rows
            self.most = max(self.most, sum(r() is not None for r in self.seen))


@pytest.mark.parametrize("run", [200, 10_000])
def test_hot_key_of_a_stream_waits_in_the_state(run):
    rng = random.Random(3)
    at = [rng.randrange(0, 400) * 60_000_000 for _ in range(3000)]
    replay = sorted((t, k) for k, t in enumerate(at))

    budget, handle, frames = jobs.Budget(5, run), FakeHandle(), Frames(at)
    budget.init(handle)
    out = list(budget.handleInputRows(("hot",), iter(frames), None))
    got = [(r.at, r.event_id, r.outcome) for part in out for r in part.itertuples()]
    used, start, frozen, want = 0, None, False, []
    for t, k in replay:
        used, start, frozen, outcome = jobs.spend(t, used, start, frozen, 5)
        want.append((t, k, outcome))
    assert got == want and handle.values["budget"].get() == (used, start, frozen)
    assert frozen and not handle.timers and max(map(len, out)) <= jobs.READ
    waiting = handle.maps["waiting"]
    assert not waiting  # nothing stays behind
    if run == 200:
        assert waiting.most > 100 and frames.most <= run // 50 + 2  # rows waited there, not in memory

    first, handle, frames = jobs.FirstOfHour(["event_id"], jobs.HOUR, "event_id", run), FakeHandle(), Frames(at)
    first.init(handle)
    out = list(first.handleInputRows(("hot",), iter(frames), None))
    last, want = None, []
    for t, k in replay:
        if last is None or t - last >= jobs.HOUR:
            last = t
            want.append(k)
    assert [k for part in out for k in part["event_id"]] == want
    assert handle.values["last"].get() == (last,) and handle.timers == {(last + jobs.HOUR) // 1000 + 1}


# ------------------------------------------------------------------ state that expires


def fed(spark, schema, batches):
    path = new_folder(spark, "fed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name):
    """The rows of a stream, and the folder of its state."""
    path, checkpoint = new_folder(stream.sparkSession, name), new_folder(stream.sparkSession, f"{name}-checkpoint")
    jobs.finish(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return stream.sparkSession.read.schema(stream.schema).parquet(path), checkpoint


def state_keys(spark, checkpoint, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return {r.key[0] for r in rows.select("key").collect()}


def test_budget_of_a_silent_key_is_dropped_but_a_frozen_one_stays(spark):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [("quiet", 1, at(0)), *[("frozen", 10 + k, at(k)) for k in range(4)], ("late", 2, at(10))],
        [("busy", 20, at(100)), ("late", 3, at(65))],
        [("busy", 21, at(300))],
        [("busy", 22, at(301)), ("quiet", 23, at(302)), ("frozen", 24, at(303))],
    ]
    stream = fed(spark, "user string, event_id long, ts timestamp", batches)
    rows, checkpoint = run(jobs.stream_budget(stream, "user", 3, late="30 minutes"), "budget")
    got = {r.event_id: (r.used, r.outcome) for r in rows.collect()}
    assert got[13] == (3, "exhausted") and got[24] == (3, "frozen")
    assert got[23] == (1, "granted") and got[3] == (2, "granted") and got[21] == (1, "granted") and got[22] == (2, "granted")
    assert state_keys(spark, checkpoint, "budget") == {"frozen", "busy", "quiet"}  # "late" fell silent and is gone
    assert len(got) == sum(map(len, batches))


def test_keys_of_the_repeat_filter_are_forgotten(spark):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), "https://a.test"), (2, at(30), "https://a.test"), (3, at(0), "https://b.test")],
        [(4, at(59), "https://a.test"), (5, at(60), "https://a.test"), (6, at(60), "https://a.test")],
        [(7, at(400), "https://c.test")],
        [(8, at(401), "https://c.test"), (9, at(402), "https://b.test")],
    ]
    stream = fed(spark, "scan_id long, ts timestamp, url string", batches)
    rows, checkpoint = run(jobs.stream_dedup(stream), "dedup")
    assert {r.scan_id for r in rows.collect()} == {1, 3, 5, 7, 9}
    assert len(state_keys(spark, checkpoint, "last")) == 2  # c and b


def test_scan_keys_share_states_and_pass_as_if_alone(spark):
    rng = random.Random(5)
    at = lambda minutes: START + timedelta(minutes=minutes)
    minutes = sorted(rng.randrange(0, 300) for _ in range(15_000))
    rows = [(k, at(m), f"https://h{rng.randrange(6_000)}.test") for k, m in enumerate(minutes)]
    batches = [rows[k : k + 5_000] for k in range(0, len(rows), 5_000)]
    for part in batches:
        rng.shuffle(part)
    stream = fed(spark, "scan_id long, ts timestamp, url string", batches)
    found, checkpoint = run(jobs.stream_dedup(stream, run=3), "dedup")
    last, want = {}, set()
    for scan_id, ts, url in rows:
        if url not in last or ts - last[url] >= timedelta(hours=1):
            last[url] = ts
            want.add(scan_id)
    assert {r.scan_id for r in found.collect()} == want
    assert 0 < len(state_keys(spark, checkpoint, "last")) <= jobs.BUCKETS < len(last)


# ------------------------------------------------------------------ blocklist refresh


def test_blocklist_is_read_once_an_hour_and_changes_between_batches(spark, psl):
    reads, minutes = [], iter([0, 30, 60, 61, 200, 201])

    def read():
        reads.append(len(reads))
        if len(reads) == 3:
            raise PySparkException("feed is down")
        urls = [f"http://bad{k}.com/" for k in range(len(reads))]
        return spark.createDataFrame([(u, "a") for u in urls], "url string, source string")

    blocklist = jobs.RefreshedBlocklist(read, psl, clock=lambda: next(minutes) * 60)
    batches = [[(k, "http://bad0.com/x"), (k, "http://bad1.com/x")] for k in range(6)]
    path = new_folder(spark, "gated")
    stream = fed(spark, "batch_no long, url string", batches)
    writer = jobs.refreshing_gate(stream, blocklist, path)
    jobs.finish(writer.option("checkpointLocation", new_folder(spark, "gated-checkpoint")))
    rows = spark.read.parquet(path).collect()
    got = {(r.batch_no, r.url[7:11]): (r.list_version, r.is_blocked) for r in rows}
    for batch, version in enumerate([1, 1, 1, 2, 2, 3]):  # one hour is not yet too old; the failed read is tried again
        assert got[batch, "bad0"] == (version, True)
        assert got[batch, "bad1"] == (version, version > 1)
    assert len(reads) == 4


def test_first_reading_must_succeed(spark, psl):
    def read():
        raise PySparkException("feed is down")

    with pytest.raises(PySparkException):
        jobs.RefreshedBlocklist(read, psl).current()


# ------------------------------------------------------------------ prepared look-ups


def scans_of(frame):
    """The columns that each file scan of a plan reads."""
    text = frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    return text, [line for line in text.split("\n") if "ReadSchema" in line]


def test_a_batch_parses_no_page_with_prepared_lookups(spark):
    i = Inputs(spark, FOLDER)
    stored = StoredLookups(tables(i), buckets=4)
    batch = spark.createDataFrame(i["url_fx"].limit(20).collect())
    text, _ = scans_of(scan(batch, stored.current(), AS_OF))
    assert "html" not in text and "LeftSemi" in text
    prepared = {r.page_id: r for r in scan(batch, stored.current(), AS_OF).collect()}
    plain = {r.page_id: r for r in scan(batch, tables(i), AS_OF).collect()}
    assert prepared == plain and len(plain) == 20


def test_a_feature_reads_its_own_lookup_only(spark):
    i = Inputs(spark, FOLDER)
    for name, used in fx.HOST_FEATURES.items():
        plan, _ = scans_of(one_feature(i, name))
        for table, column in (("whois", "creation_date"), ("dns", "a_records"), ("cert", "not_before")):
            assert (column in plan) == (table == used), (name, table)


def test_prepared_lookups_are_kept_up_by_bucket(spark):
    table = KeyedTable(spark, "k", "keyed", buckets=8)
    rows = lambda keys, n: spark.createDataFrame([(f"k{k}", n, k) for k in keys], "k string, n int, at int")
    table.update(rows(range(100), 1))
    before = dict(table.folders)
    assert len(before) == 8 and table.rows().count() == 100
    table.update(rows([3, 200], 2))
    changed = {b for b in table.folders if table.folders[b] != before[b]}
    assert 1 <= len(changed) <= 2
    got = {r.k: r.n for r in table.rows().collect()}
    assert len(got) == 101 and got["k3"] == got["k200"] == 2 and got["k4"] == 1
    table.update(spark.createDataFrame([("k3", 9, -1)], "k string, n int, at int"), newest=F.col("at"))
    assert {r.k: r.n for r in table.rows().collect()}["k3"] == 2  # an older record does not replace a newer one


def test_new_pages_and_records_replace_old_ones(spark):
    i = Inputs(spark, FOLDER)
    stored = StoredLookups(tables(i), buckets=4)
    url = i["crawl_fx"].first().url
    stored.crawled(spark.createDataFrame([(url, 200, 6, "<iframe src=x></iframe>")], "url string, http_status int, redirect_count int, html string"))
    page = fx.meet_pages(spark.createDataFrame([(url,)], "url string"), stored.current().pages).first()
    assert (page.iframe_present, page.redirect_count, page.http_failed) == (-1, -1, False)
    assert stored.current().pages.count() == fx.page_table(i["crawl_fx"]).count()
