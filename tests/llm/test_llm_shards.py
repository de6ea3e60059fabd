import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_help import ODD_TEXTS, SMALL, documents
from tokenizers import Tokenizer

import __spark_entry__ as entry
from urlguard.llm import shards
from urlguard.llm.perfect_hash import PerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    array = np.array(sorted(keys), np.int64)
    slots = PerfectHash.build(array).slots(array)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_shards_round_trip(spark):
    frame = documents(spark, ODD_TEXTS)
    folder = shards.write(frame, PATH, end_id=0)
    rows = sorted(shards.read(spark, folder).collect(), key=lambda r: r.place)
    place = 0
    assert [r.key for r in rows] == sorted((k for k, _ in ODD_TEXTS), key=lambda k: (k is not None, k or 0))
    for row in rows:
        assert row.place == place
        place += len(row.ids) // 4
    found = sorted((str(r.key), np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert found == sorted((str(k), expected(t)) for k, t in ODD_TEXTS)


def test_keyed_access(spark):
    folder = shards.write(documents(spark, ODD_TEXTS), PATH, end_id=0)
    asked = spark.createDataFrame([(4,), (12,), (999,), (-5,), (None,), (4,)], "k long")
    found = shards.locate(asked, "k", folder).collect()
    assert sorted(r.key for r in found) == [4, 4, 12]
    texts = dict(ODD_TEXTS)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == expected(texts[r.key]) for r in found)


@pytest.mark.parametrize("key", [7, None])
def test_a_hot_key_fills_several_shards(spark, key):
    """A third of all rows has one key, or none: shards share it, look-ups give all of its rows."""
    texts = [(key if k % 3 == 0 else k, f"text number {k} " * (k % 5)) for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = shards.write(documents(spark, texts), PATH, end_id=0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r.n_rows for r in shards.manifest(spark, folder).collect()]
    assert len(sizes) >= 6 and max(sizes) < 200
    rows = shards.read(spark, folder).orderBy("place").collect()
    assert sorted((str(r.key), bytes(r.ids)) for r in rows) == sorted((str(k), np.array(expected(t), "<u4").tobytes()) for k, t in texts)
    found = shards.locate(spark.createDataFrame([(7,), (8,)], "k long"), "k", folder).collect()
    assert sorted((r.key, bytes(r.ids)) for r in found) == sorted((k, np.array(expected(t), "<u4").tobytes()) for k, t in texts if k in (7, 8))


def test_rows_come_through_the_hash(spark, tmp_path):
    """An index whose hash leads elsewhere gives other rows; one that leads nowhere is refused."""
    folder = shards.write(documents(spark, [(k, f"text {k} " * (k + 1)) for k in range(9)]).coalesce(1), PATH, end_id=0)
    whole = {r.key: bytes(r.ids) for r in shards.read(spark, folder).collect()}
    for row in shards.manifest(spark, folder).collect():
        system, top = shards.open_folder(folder)
        with system.open_input_stream(f"{top}/{row.index_file}") as file:
            arrays, more = shards.unpack_arrays(file.read())
        arrays = {n: a.copy() for n, a in arrays.items()}
        arrays["repeats"][:] = 0
        with system.open_output_stream(f"{top}/{row.index_file}") as file:
            file.write(shards.pack_arrays(arrays, more))
    assert len(whole) == 9
    with pytest.raises(Exception, match="does not lead"):
        shards.read(spark, folder).collect()


def test_reads_are_cut_by_ids(spark, monkeypatch):
    monkeypatch.setattr(shards, "READ_IDS", 50)
    test_shards_round_trip(spark)


def test_absent_keys_are_refused():
    keys = np.arange(0, 200_000, 7)
    index = shards.index_of(keys, 0, np.arange(len(keys) + 1), 2)
    arrays, _ = shards.unpack_arrays(index)
    shard = shards.Shard.__new__(shards.Shard)
    shard.prints, shard.rows, shard.repeats = arrays["prints"], arrays["rows"], arrays["repeats"]
    shard.hashed = PerfectHash(arrays["sizes"], arrays["words"])
    shard.keys, shard.n_null = arrays["keys"], 0
    first, n = shard.find(keys)
    assert (first == np.arange(len(keys))).all() and (n == 1).all()
    absent = np.setdiff1d(np.arange(200_000), keys)
    assert not shard.find(absent)[1].any()


def test_empty_table(spark):
    folder = shards.write(documents(spark, []), PATH, end_id=0)
    assert shards.read(spark, folder).count() == 0
    assert shards.locate(spark.createDataFrame([(1,)], "k long"), "k", folder).count() == 0


def test_query_equals_brute_force(spark):
    rows = sorted(entry.queries()["op3_id_shards"](spark, SMALL).collect())
    start = 0
    for row, doc in zip(rows, spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = expected(doc.text)
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
