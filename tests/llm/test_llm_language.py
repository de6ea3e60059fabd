import random
import zlib

import numpy as np
import pytest
from llm_help import DOC, ODD_TEXTS, SMALL, documents, empty

import __spark_entry__ as entry
from urlguard.llm import language


def plain_phrases(text, codes):
    """Greedy cutting by substring search, phrases ending with a block."""
    n = 0
    for start in range(0, len(codes), language.BLOCK):
        block, at = codes[start : start + language.BLOCK], 0
        while at < len(block):
            end = at + 1
            while end < len(block) and block[at : end + 1] in text:
                end += 1
            n, at = n + 1, end
    return n


def test_phrases_equal_brute_force():
    draw = random.Random(4)
    samples = {name: ["".join(draw.choice(letters) for _ in range(300))] for name, letters in (("x", "abc "), ("y", "bcd "), ("z", "xyz "))}
    model = language.parser(samples, 250)
    texts = ["".join(draw.choice("abcdxyz Q1") for _ in range(draw.choice([0, 1, 30, 2000]))) for _ in range(30)]
    counts, sizes = language.phrases(model, texts)
    clean = lambda t: "".join(map(chr, language.cleaned(t)))
    known = {n: (clean(s[0]) + " ")[:250] for n, s in samples.items()}
    for row, size, text in zip(counts.tolist(), sizes.tolist(), texts):
        assert size == len(clean(text))
        assert row == [plain_phrases(known[n], clean(text)) for n in model.languages]


def plain_judgement(samples, sample_chars, text):
    """Language and score by definition: phrases times the logarithm of the sample's length, the least wins."""
    clean = "".join(map(chr, language.cleaned(text)))
    if not clean:
        return language.UNKNOWN, 0.0
    entropies = []
    for name in sorted(samples):
        known = "".join("".join(map(chr, language.cleaned(t))) + " " for t in samples[name])[:sample_chars]
        entropies.append((plain_phrases(known, clean) * np.log(len(known)), name))
    best = min(entropies)
    return best[1], 1 - best[0] / sorted(entropies)[1][0]


def test_judgement_equals_brute_force():
    draw = random.Random(9)
    words = {"en": ["the", "cat", "and", "dog"], "de": ["der", "hund", "und", "katze"], "fr": ["le", "chat", "et", "chien"]}
    prose = lambda name, n: " ".join(draw.choice(words[name]) for _ in range(n))
    samples = {"en": [prose("en", 60) for _ in range(5)], "de": [prose("de", 6)], "fr": [prose("fr", 30)] * 2}  # one has little text
    model = language.parser(samples, 800)
    texts = [prose(name, n) for name in words for n in (3, 8, 40)] + ["", "12 !", "zzz qqq xyz"]
    names, scores = language.judged(model, texts)
    for text, name, score in zip(texts, names, scores):
        want = plain_judgement(samples, 800, text)
        assert name == want[0] and abs(score - want[1]) < 1e-12
    assert names[:9] == ["en"] * 3 + ["de"] * 3 + ["fr"] * 3


def test_language_with_thousands_of_letters():
    draw = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(5000)]
    samples = {"zh": ["".join(draw.choice(letters) for _ in range(40_000))], "en": ["the cat and the dog " * 500]}
    model = language.parser(samples, 40_000)
    assert sum(t.nbytes for t in model.tables) <= 2 * 2 * 40_000 * (language.LETTERS + 2) * 4
    assert language.judged(model, ["the dog and the cat", samples["zh"][0][:200]])[0] == ["en", "zh"]


def test_a_long_text_is_not_the_whole_sample(spark):
    rows = [(k, f"word{k % 10} common text of this language {k}") for k in range(30)] + [(50, "zzyzx " * 20_000)]
    frame = documents(spark, rows).selectExpr("text", "'en' AS lang")
    model = language.learn(frame, sample_rows=200, sample_chars=3100).value
    assert language.judged(model, ["common text of this language"])[0] == ["en"]
    assert language.phrases(model, ["common text of this language"])[0][0, 0] <= 2
    assert 31 * 20 < len(model.tables[0]) // model.widths[0] < 2 * 3100


def test_too_many_languages_are_refused(monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 10_000)
    with pytest.raises(ValueError):
        language.parser({f"l{k}": ["some text of it " * 20] for k in range(20)}, 1000)


def test_cleaned():
    assert "".join(map(chr, language.cleaned("  A--b\n\n1 É! "))) == "a b é"
    assert len(language.cleaned(" 12 -")) == 0


def test_odd_texts(spark):
    rows = [(k, f"the cat and the dog {k}") for k in range(40)] + [(k, f"der hund und die katze {k}") for k in range(40, 80)]
    frame = documents(spark, rows + ODD_TEXTS).selectExpr("*", "CASE WHEN doc_id < 40 THEN 'en' WHEN doc_id < 80 THEN 'de' END AS lang")
    found = language.identify(frame).collect()
    assert len(found) == len(rows + ODD_TEXTS)
    for row in found:
        assert row.lang_pred in ("en", "de", "und") and 0 <= row.score <= 1
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in row.text or ""))
        held = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2
        assert row.held_out == held
    assert {r.lang_pred for r in found if r.text and "katze" in r.text} == {"de"}


def test_nothing_to_learn(spark):
    frame = documents(spark, [(1, "some words")]).selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert [(r.lang_pred, r.score) for r in language.identify(frame).collect()] == [("und", 0.0)]
    assert language.identify(empty(spark, DOC)).count() == 0


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in entry.queries()["op7_language_id"](spark, folder).collect() if r.held_out and docs[r.doc_id]]
    right = np.mean([r.lang_pred == docs[r.doc_id] for r in rows])
    assert len(rows) > 150 and right >= 0.95, right
    for lang in {docs[r.doc_id] for r in rows}:  # each language by itself
        own = [r.lang_pred == lang for r in rows if docs[r.doc_id] == lang]
        assert np.mean(own) >= 0.9, (lang, np.mean(own))


def test_predictions_do_not_use_the_label(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = frame.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    first, second = (sorted(tuple(r) for r in language.identify(f).select("doc_id", "lang_pred", "score").collect()) for f in (frame, other))
    assert first == second
