import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_help import ODD_TEXTS, SMALL, documents
from tokenizers import Tokenizer

import __spark_entry__ as entry
from urlguard.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain_best_fit(counts, capacity):
    """How full each bin is after best-fit decreasing, one piece after the other.

    Which of several bins with equal room takes a piece is open; it cannot change this.
    """
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(room, -k) for k, room in enumerate(rooms) if room >= length]
            if not fits:
                rooms.append(capacity)
                k = len(rooms) - 1
            else:
                k = -min(fits)[1]
            rooms[k] -= length
    return sorted(capacity - room for room in rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_one_by_one(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 16, 33, 100])
    counts = {k: draw.randint(1, 30) for k in draw.sample(range(1, capacity + 1), min(capacity, 12))}
    content = {}
    for length, rank, first, each, offset in (lines := sorted(packing.best_fit(counts, capacity))):
        following = [x[1] for x in lines if x[0] == length and x[1] > rank]
        for k in range(rank, min(following, default=counts[length])):
            at = (first + (k - rank) // each, offset + (k - rank) % each * length)
            content.setdefault(at[0], []).append((at[1], length))
    found = []
    for pieces in content.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        found.append(at)
    assert sum(counts.values()) == sum(map(len, content.values()))
    assert sorted(found) == plain_best_fit(counts, capacity)


def test_segment_tree():
    tree = packing.OpenCapacities(100)
    marked = set()
    draw = random.Random(5)
    for _ in range(2000):
        k = draw.randint(0, 100)
        is_open = draw.random() < 0.3
        tree.mark(k, is_open)
        (marked.add if is_open else marked.discard)(k)
        asked = draw.randint(0, 100)
        assert tree.tightest(asked) == min((m for m in marked if m >= asked), default=None)


def check(rows, docs, capacity):
    """Every piece is right, every sequence gapless; returns the number of sequences."""
    expected = []
    for doc_id, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            expected.append((doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    content = {}
    for r in rows:
        content.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in content.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(content)


def test_pack(spark):
    packed = packing.pack(documents(spark, ODD_TEXTS), PATH, 1, 64).cache()
    rows = packed.drop("ids").collect()
    check(rows, ODD_TEXTS, 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        at = np.frombuffer(whole[r.sequence_id].ids, "<u4")[r.offset : r.offset + r.length]
        assert zlib.crc32(at.tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH, 1).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = entry.queries()["op6_best_fit_packing"](spark, SMALL).collect()
    n = check(rows, docs, 4096)
    total = sum(r.length for r in rows)
    assert n <= total / 4096 * 1.02 + 1
