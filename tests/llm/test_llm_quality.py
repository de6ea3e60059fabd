from collections import Counter

from llm_help import ODD_TEXTS, documents, words

from urlguard.llm import quality


def counts(text):
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    return {
        "n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


REPEATS = [
    (20, "a b c d e x a b c d e"), (21, "a a a a a a a a"), (22, "a b c d e a b c d e a b c d e f g h"),
    (23, "one line of words\none line of words\n \n \nother line"), (24, "p q r s t\n" * 7), (25, "w1 w2 w3 w4"),
    (26, "### *** $$$ word & word | word < word > word % word and more of the words in a row"),
]


def test_measures_equal_brute_force(spark):
    rows = quality.judged(documents(spark, ODD_TEXTS + REPEATS)).collect()
    assert len(rows) == len(ODD_TEXTS + REPEATS)
    for row in rows:
        expected = counts(row.text)
        assert {k: row.quality[k] for k in expected} == expected
        n, repeats = expected["n_words"], expected["n_repeat_words"]
        assert row.quality.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert row.quality.kept == (not row.quality.base_failed and not row.quality.failed_rules)


def test_rules(spark):
    good = "The words of this text are in order and it is long enough to be kept by the rules."
    bad = {
        "symbols": good.replace(" ", " # "), "shouting": good.replace(" ", "!! "), "capitals": good.upper(),
        "repeated_lines": "\n".join([f"line {k} of the words is good" for k in range(3)] + ["x y"] * 9 + ["z"] * 9),
        "word_length": " ".join(f"{k}{'x' * 40}" for k in range(30)), "stop_words_few": " ".join(f"word{k}" for k in range(60)),
        "ellipses": "\n".join(f"the line {k} ends ..." for k in range(9)), "bullets": "\n".join(f"- the point {k}" for k in range(9)),
    }
    rows = [(0, good), *((k, t) for k, t in enumerate(bad.values(), 1))]
    found = {r.doc_id: r.quality for r in quality.judged(documents(spark, rows)).collect()}
    assert found[0].kept and not found[0].failed_rules
    for k, name in enumerate(bad, 1):
        assert name in found[k].failed_rules and not found[k].kept, name
    frame = documents(spark, rows)
    kept = quality.passing(frame)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [0]


def test_no_python(spark):
    plan = quality.judged(documents(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality.judged(documents(spark, [])).count() == 0 and quality.passing(documents(spark, [])).count() == 0
