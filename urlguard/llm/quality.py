"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Null text has no words, so it fails the base rule.
A ratio over nothing passes its rule. Rows that repeat pass or fail alike; other columns pass
unchanged (but for one named quality, which is replaced), and an empty table stays empty. Long texts cost n log n at most.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.llm.common import others, private, text_or_empty

# --- fixed values: frequent words of the four languages of the corpus ----------------------
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "was", "on", "he", "as",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "est", "pour", "dans", "au", "en", "sur",
    "der", "die", "das", "und", "zu", "den", "mit", "von", "ist", "für", "auf", "ein", "eine", "dem", "nicht", "des",
    "el", "los", "las", "y", "del", "por", "con", "para", "una", "se", "su", "al", "no", "es",
)
WINDOW = 5
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_marks", "n_capitals", "n_stop_words", "n_bullets", "n_ellipses",
)


class Rule(NamedTuple):
    """A text fails when ``part / whole`` is outside low..high and the text has enough words."""

    name: str
    part: str
    whole: str
    low: float
    high: float
    least_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("shouting", "n_marks", "n_words", 0.0, 0.3),
    Rule("capitals", "n_capitals", "word_chars", 0.0, 0.5),
    Rule("stop_words_few", "n_stop_words", "n_words", 0.01, 1.0, 50),
    Rule("stop_words_many", "n_stop_words", "n_words", 0.0, 0.9, 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("bullets", "n_bullets", "n_lines", 0.0, 0.9, 20),
    Rule("ellipses", "n_ellipses", "n_lines", 0.0, 0.5, 20),
)


def _removed(text: Column, pattern: str) -> Column:
    """Characters of a text that match a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _counted(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda held, x: held + x)


def measured(documents: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Documents with a struct of MEASURES; returns also the struct's name.

    Each select names arrays that the next one uses several times, so that they are made once.
    """
    names = [F.col(c) for c in documents.columns]
    body, words, lines, hashes, windows, placed, found, out = private(
        "body", "words", "lines", "hashes", "windows", "placed", "found", "measures"
    )
    frame = documents.select("*", text_or_empty(text).alias(body)).select(
        "*",
        F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias(words),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    frame = frame.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias(hashes))
    # The hash of each window of WINDOW words, at the place of its first word.
    heads = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    window = F.transform(heads, lambda h, i: F.xxhash64(h, *[F.get(F.col(hashes), i + k) for k in range(1, WINDOW)]))
    frame = frame.select("*", window.alias(windows))
    # Sorted by hash and place, where any window repeats: equal hashes are neighbours.
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    frame = frame.select("*", F.when(repeats, pairs).alias(placed))

    def neighbour(x: Column, j: Column) -> Column:
        return (x["h"] == F.get(F.col(placed), j - 1)["h"]) | (x["h"] == F.get(F.col(placed), j + 1)["h"])

    starts = F.sort_array(F.transform(F.filter(placed, neighbour), lambda x: x["i"]))
    frame = frame.select("*", starts.alias(found))
    # A window covers the words up to the next one found, and at most WINDOW.
    covered = F.transform(
        found, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(found), j + 1) - p, F.lit(WINDOW))).cast("long")
    )
    text_of, lines_of, words_of = F.col(body), F.col(lines), F.col(words)
    measures = {
        "n_words": F.size(words_of).cast("long"),
        "word_chars": F.length(F.array_join(words_of, "")).cast("long"),
        "n_symbols": _removed(text_of, "[#*$%&|<>]"),
        "n_dup_lines": (F.size(lines_of) - F.size(F.array_distinct(lines_of))).cast("long"),
        "n_repeat_words": F.coalesce(_total(covered), F.lit(0).cast("long")),
        "n_lines": F.size(lines_of).cast("long"),
        "n_marks": _removed(text_of, "[!?]"),
        "n_capitals": _removed(text_of, r"\p{Lu}"),
        "n_stop_words": _counted(words_of, lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS)))),
        "n_bullets": _counted(lines_of, lambda line: line.rlike(r"^[\x20\t]*[-*\u2022]")),
        "n_ellipses": _counted(lines_of, lambda line: line.rlike(r"(\.\.\.|\u2026)[\x20\t\r]*$")),
    }
    return frame.select(*names, F.struct(*[measures[m].alias(m) for m in MEASURES]).alias(out)), out


def passes(measures: str, rule: Rule) -> Column:
    part, whole, n_words = (F.col(f"{measures}.{c}") for c in (rule.part, rule.whole, "n_words"))
    ratio = part.cast("double") / F.when(whole > 0, whole).cast("double")
    return F.coalesce(ratio.between(rule.low, rule.high), F.lit(True)) | (n_words < rule.least_words)


def verdicts(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """Documents with a struct of the measures, base_failed, the failed rules' names and kept, and its name."""
    frame, name = measured(documents, text)
    n_words, n_repeat = F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")
    base_failed = (n_words < 10) | (n_repeat * 100 > n_words * 20)
    failed = F.array_compact(F.array(*[F.when(~passes(name, r), F.lit(r.name)) for r in rules]))
    kept = reduce(and_, [passes(name, r) for r in rules], ~base_failed)
    quality = F.struct(f"{name}.*", base_failed.alias("base_failed"), failed.alias("failed_rules"), kept.alias("kept"))
    return frame.select(*documents.columns, quality.alias(name)), name


def judged(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds struct ``quality``, see verdicts."""
    frame, name = verdicts(documents, text, rules)
    return frame.select(*others(documents, "quality"), F.col(name).alias("quality"))


def passing(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept."""
    frame, name = verdicts(documents, text, rules)
    (mark,) = private("mark")
    # A filter goes below projections of deterministic columns and would carry a copy of all
    # measures with it for each time it names one. The mark keeps it above them.
    marked = frame.withColumn(mark, F.monotonically_increasing_id())
    return marked.where(F.col(f"{name}.kept") & (F.col(mark) >= 0)).select(*documents.columns)


def rule_sql(rule: Rule) -> str:
    """The rule as a condition of DuckDB over the measures' names."""
    return (
        f"(coalesce({rule.part}::DOUBLE / nullif({rule.whole}, 0)::DOUBLE BETWEEN {rule.low} AND {rule.high}, true)"
        f" OR n_words < {rule.least_words})"
    )


def check_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB's version over the documents table."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM base)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM twice) GROUP BY doc_id),
measures AS (
  SELECT b.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '[!?]')) AS n_marks,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
         len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\t]*[-*\x{{2022}}]'))) AS n_bullets,
         len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|\x{{2026}})[\x20\t\r]*$'))) AS n_ellipses
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
checked AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rule_sql(r) for r in rules)} AS kept
FROM checked"""
