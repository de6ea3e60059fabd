import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_help import ODD_TEXTS, documents
from tokenizers import Tokenizer

from urlguard.llm import bpe
from urlguard.llm.tokens import PieceEncoder

PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
LIBRARY = {n: Tokenizer.from_file(p) for n, p in PATHS.items()}
PIECES = {n: PieceEncoder(p) for n, p in PATHS.items()}
OWN = bpe.encoder(PATHS["byte_bpe_50k.json"])
TEXT = st.text(st.sampled_from("ab thein'sS \n\t.,09éÉİΣ漢😀\xa0́<|>-"), max_size=60)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_own_encoding_equals_library(text):
    expected = LIBRARY["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
    assert ids(OWN.encode([text])[0]) == expected


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(list(PATHS)))
def test_pieces_equal_library(text, name):
    assert ids(PIECES[name].encode([text])[0]) == LIBRARY[name].encode(text, add_special_tokens=False).ids


def test_pairs_that_pass_are_encodings():
    """A pair passes if and only if the library encodes the joined bytes as that pair."""
    vocabulary, library = OWN.vocabulary, LIBRARY["byte_bpe_50k.json"]
    rng = np.random.default_rng(7)
    plain = [k for t, k in vocabulary.known.items() if t.isalpha() and t.isascii()]
    a, b = rng.choice(plain, (2, 3000))
    for x, y, good in zip(a.tolist(), b.tolist(), vocabulary.compatible(a, b).tolist()):
        joined = (vocabulary.bytes[x] + vocabulary.bytes[y]).decode()
        assert good == (library.encode(joined, add_special_tokens=False).ids == [x, y])


def test_both_merges_agree():
    rng = np.random.default_rng(3)
    found = ["".join(rng.choice(list("aabcethinrs"), rng.integers(1, 24))).encode() for _ in range(500)]
    vocabulary = OWN.vocabulary
    assert vocabulary.merged_together(found) == [vocabulary.merged(w) for w in found]
    assert vocabulary.merged_together([]) == []


def test_round_trip(spark):
    rows = bpe.round_trip(documents(spark, ODD_TEXTS), PATHS["byte_bpe_50k.json"]).collect()
    library = LIBRARY["byte_bpe_50k.json"]
    assert len(rows) == len(ODD_TEXTS)
    for row in rows:
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected
        assert row.decoded == library.decode(expected, skip_special_tokens=False)


def test_broken_bytes_and_nulls(spark):
    frame = spark.createDataFrame([(1, [50256, 94, 222]), (2, None), (3, [])], "k int, ids array<int>")
    rows = {r.k: r.t for r in frame.select("k", bpe.decode("ids", PATHS["byte_bpe_50k.json"]).alias("t")).collect()}
    library = LIBRARY["byte_bpe_50k.json"]
    assert rows == {1: library.decode([50256, 94, 222], skip_special_tokens=False), 2: None, 3: ""}


def test_empty_table(spark):
    done = bpe.round_trip(documents(spark, []), PATHS["byte_bpe_50k.json"])
    assert done.count() == 0 and {"ids", "decoded"} <= set(done.columns)


@pytest.mark.parametrize("size", [1, 50])
def test_bounded_memory_changes_nothing(size, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_HELD", size)
    small = bpe.Encoder(PATHS["byte_bpe_50k.json"])
    texts = [t or "" for _, t in ODD_TEXTS] * 2
    assert small.encode(texts) == OWN.encode(texts)
