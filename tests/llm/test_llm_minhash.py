import random

import pytest
from llm_help import ODD_TEXTS, documents, shingles

from urlguard.llm import minhash
from urlguard.llm.components import components


def roots(nodes, edges):
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(draw.choice([5, 30, 60]))]
    edges += [(100, k) for k in range(101, 150)] + [(k, k + 1) for k in range(200, 260)] + [(7, 7)]
    expected = {k: c for k, c in roots({x for e in edges for x in e}, edges).items() if k != c}
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == expected


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(texts):
    """Component of each row by all pairs."""
    nodes = [(k if k is not None else ("none", t), shingles(t)) for k, t in texts]
    ids = {n: n if isinstance(n, int) else 1 << 62 for n, _ in nodes}
    edges = []
    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if (x and y and 100 * len(x & y) >= 75 * len(x | y)) or a == b:
                edges.append((ids[a], ids[b]))
    return {n: c for n, c in roots(set(ids.values()), edges).items()}


def family(seed, n, size=120):
    """Near copies of near copies, so that some links lead through others only."""
    draw = random.Random(seed)
    texts = [[f"w{draw.randint(0, 500)}" for _ in range(size)]]
    for _ in range(n - 1):
        text = list(draw.choice(texts))
        for _ in range(draw.choice([1, 2, 3, 5])):
            text[draw.randrange(size)] = f"z{draw.randint(0, 10**6)}"
        texts.append(text)
    return [" ".join(t) for t in texts]


def check(spark, texts):
    expected = brute(texts)
    rows = minhash.near_duplicates(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for k, t in texts:
        sizes.setdefault(k, set()).add(len(shingles(t)))
    for r in rows:
        assert r.n_shingles in sizes[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == expected[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [t for seed in range(3) for t in family(seed, 60)]
    order = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(order)
    check(spark, list(zip(order, texts)) + ODD_TEXTS)


def test_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = check(spark, [(None, text), (None, text), (5, text + " more"), (None, "alone here"), (6, "other words")])
    assert sorted((str(r.component_id), r.kept) for r in rows if r.doc_id is None) == [("5", False), ("5", False), ("None", True)]


def test_copies_need_no_pairs(spark):
    texts = [(k, "one two three four five six seven eight") for k in range(300, 0, -1)]
    rows = minhash.near_duplicates(documents(spark, texts)).collect()
    assert {r.component_id for r in rows} == {1} and sum(r.kept for r in rows) == 1


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = minhash.near_duplicates(documents(spark, [(1, None), (2, "  ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_one_document_with_two_texts_joins_their_classes(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    check(spark, [(1, a), (2, b), (5, a), (5, b)])
    check(spark, [(9, a), (7, b), (5, a), (5, b), (5, c), (5, ""), (4, c + " tail"), (8, None)])
    # Class b has no document of its own: both of its rows belong to documents that are at home elsewhere.
    check(spark, [(1, a), (1, b), (2, c), (2, b), (3, b + " x"), (6, b)])


def test_a_third_of_the_rows_repeats_one_document(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = family(5, 40)
    order = list(range(100, 100 + len(texts)))
    rows = list(zip(order, texts)) + [(120, texts[20])] * 20 + [(121, t) for t in texts[:6]] + [(None, texts[3])] * 5
    check(spark, rows)


def test_long_sets_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    texts = family(6, 30)
    check(spark, [(k, t) for k, t in enumerate(texts, 10)])
