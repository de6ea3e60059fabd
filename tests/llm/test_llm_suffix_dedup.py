import random

import numpy as np
import pyarrow as pa
import pytest
from llm_help import ODD_TEXTS, documents, empty

from urlguard.llm import suffix_dedup


def brute(rows, length=50):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1) if key is not None else ():
            s = data[k : k + length]
            first[s] = min(first.get(s, key), key)
    found = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - length + 1) if key is not None else ():
            if first[data[k : k + length]] < key:
                gone[k + 1 : k + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        spans = tuple(zip(edges[::2], edges[1::2]))
        kept = bytes(b for b, g in zip(data, gone[1:]) if not g)
        found.append((key, len(data), len(data) - len(kept), spans, kept))
    return sorted(found, key=repr)


def result(frame, length=50):
    rows = suffix_dedup.dedup(frame, length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in rows), key=repr)


def mixed_texts(seed, count=150):
    draw = random.Random(seed)
    syllables = ["eau", "le ", "on", "tion", "é", "the ", "of ", "漢", "\n"]

    def prose(n):
        return "".join(draw.choice(syllables) for _ in range(n))

    passages = [prose(draw.randint(0, 200)) for _ in range(20)]
    rows = []
    for _ in range(count):
        text = ""
        for _ in range(draw.randint(0, 4)):
            passage = draw.choice(passages)
            start = draw.randint(0, len(passage)) if draw.random() < 0.5 else 0
            text += passage[start : start + draw.randint(0, 300)] + prose(draw.randint(0, 15))
        rows.append((draw.randint(0, count) if draw.random() < 0.95 else None, text))
    return rows


@pytest.mark.parametrize("seed, length", [(1, 50), (2, 24), (3, 87)])
def test_equals_brute_force(spark, seed, length):
    rows = mixed_texts(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(frame, length) == brute(rows, length)


def test_odd_and_periodic_texts(spark):
    passage = "the same licence line that stands in a third of all documents, word for word. "
    rows = ODD_TEXTS + [(100 + k, "ab" * (40 + k)) for k in range(8)] + [(200 + k, f"{k} " + passage * 2 + f" {k}") for k in range(30)]
    assert result(documents(spark, rows)) == brute(rows)


def test_long_texts_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    rows = mixed_texts(4, 60) + [(1000, "x" * 700), (1001, "y" + "x" * 900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(frame) == brute(rows)  # tasks fork with the small pieces


def test_other_columns_and_empty_table(spark):
    frame = documents(spark, [(1, "a" * 60), (2, "a" * 60)])
    found = suffix_dedup.dedup(frame)
    assert found.columns == [c for c in frame.columns if c not in ("kept",)] + ["n_bytes", "n_removed", "spans", "kept"]
    assert {(r.doc_id, r.n_removed, r.score) for r in found.collect()} == {(1, 0, "x"), (2, 60, "x")}
    assert suffix_dedup.dedup(empty(spark, "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(frame, length=20)


def test_order_and_packing():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 3000).astype(np.uint64) for _ in range(5)]
    order = suffix_dedup.multikey_order(columns)
    assert (order == np.lexsort((order.argsort(), *columns[::-1]))).all() or sorted(zip(*columns)) == [tuple(c[k] for c in columns) for k in order]
    ordered = suffix_dedup.in_order(columns)
    assert list(zip(*ordered)) == sorted(zip(*columns))
    for a, b in zip(ordered, suffix_dedup.unpacked(suffix_dedup.packed(ordered))):
        assert (a == b).all()
    splitters = suffix_dedup._splitters([columns], 8)
    places = suffix_dedup._buckets_of(ordered, splitters)
    rows, cuts = list(zip(*ordered)), list(zip(*splitters))
    assert places == [next((k for k, row in enumerate(rows) if row >= cut), len(rows)) for cut in cuts]


def test_hot_runs_are_spread():
    """Splitters cut inside a run that most documents hold, and boundaries settle it."""
    hot = [np.full(900, 7, np.uint64)] * 4 + [np.arange(900).astype(np.uint64)]
    splitters = suffix_dedup._splitters([hot], 10)
    sizes = np.diff([0, *suffix_dedup._buckets_of(hot, splitters), 900])
    assert len(sizes) == 10 and sizes.max() <= 91


def test_runs_cover_every_string_once():
    draw = random.Random(5)
    text = "".join(draw.choice("abc de") for _ in range(3000)).encode()
    for piece, _, _ in suffix_dedup.pieces(pa.array([text, b"short", b"", text[100:400]], pa.binary())):
        suffix, first, last = piece.runs()
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        assert covered.tolist() == piece.strings().tolist()
        assert (suffix >= last).all() and (suffix <= first + piece.length - suffix_dedup.LEAD).all()
        assert len(first) < len(covered) / 5


def test_bench_documents_match_sql_shape(spark):
    from llm_help import SMALL

    from urlguard.llm import queries

    found = queries.op13_suffix_dedup(spark, SMALL)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found.agg({"n_removed": "sum"}).first()[0] > 0
