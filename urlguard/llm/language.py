"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of a text, the longest
run of characters that occurs in the language's text. Cutting a text greedily into such runs, the
language that needs the fewest phrases for its length wins.

The automata are learned from a bounded sample: of each language at most ``sample_rows`` distinct
labelled texts (those with the smallest hashes), each with an equal share of ``sample_chars``
characters, so that no long text is the whole sample. A text's letters are lower-cased; runs of other
characters count as one blank. Beyond the LETTERS most frequent letters of a language's sample its other
letters count as one; a letter that is not in the sample is a phrase by itself. A text is parsed whole, in blocks of BLOCK
characters side by side; a phrase ends with its block.

A language's entropy is its number of phrases times the logarithm of its sample's length: phrases are
longer in a longer sample, and a language with little labelled text is not at a loss. The table of a
language has at most 2 * ``sample_chars`` states of LETTERS + 2 numbers (some 10 MB for 40,000
characters of a Latin script, 42 MB at most); ``MODEL_BYTES`` bounds all of them, and more languages than
fit are refused.

Texts that are null or have no letter get ``und`` and score 0; so does every text if nothing could
be learned. Ties go to the language first in order. The score is one minus the best entropy over
the second best (over that of a phrase for each character, with one language). Rows that repeat
are predicted alike; other columns pass unchanged, those named like an added one are replaced.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlguard.llm.common import others, private, text_or_empty, text_slices

UNKNOWN = "und"
BLOCK = 512
RESTART = 1 << 30  # flag of a transition that starts a new phrase
MODEL_CHARS = 40_000
MODEL_ROWS = 200
LETTERS = 128  # symbols of a language that are told apart
MODEL_BYTES = 256 << 20  # of all tables
PARSED = 1_000_000  # bytes of text parsed together


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Parser(NamedTuple):
    """All languages' automata."""

    languages: list[str]
    weights: np.ndarray  # logarithm of each sample's length
    symbols: list[np.ndarray]  # of each language the symbol of each code point seen; rare ones share one, the last is for others
    tables: list[np.ndarray]  # of each language the next state by state * width + symbol, flagged where a phrase starts
    widths: list[int]


def cleaned(text: str) -> np.ndarray:
    """Code points in lower case, runs of non-letters as one blank, none at the ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, codes, 32)
    first, last = letter.argmax(), len(letter) - letter[::-1].argmax()
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return codes[first:last][keep[first:last]]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    edges, link, longest, last = [{}], [-1], [0], 0
    for c in symbols:
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        new, p, last = len(edges) - 1, last, len(edges) - 1
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = edges[p][c]
        if longest[q] == longest[p] + 1:
            link[new] = q
            continue
        edges.append(dict(edges[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        copy = len(edges) - 1
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return edges


def parser(samples: dict[str, list[str]], sample_chars: int) -> Parser:
    """Builds the automata from texts of each language."""
    found = Parser([], np.zeros(0), [], [], [])
    weights, held = [], 0
    for name, texts in sorted(samples.items()):
        codes = np.concatenate([np.append(cleaned(t), 32) for t in texts])[:sample_chars]
        seen, counts = np.unique(codes, return_counts=True)
        known = np.sort(seen[np.argsort(-counts, kind="stable")[:LETTERS]])
        rare, unseen = len(known), len(known) + 1
        width = unseen + 1
        symbols = np.full(int(seen.max()) + 1, unseen, np.int32)
        symbols[seen], symbols[known] = rare, np.arange(len(known))
        edges = automaton(symbols[codes].tolist())
        held += len(edges) * width * 4
        if held > MODEL_BYTES:
            raise ValueError(f"{len(samples)} languages need more than {MODEL_BYTES} bytes; take smaller samples")
        root = np.full(width, RESTART, np.int32)
        for c, to in edges[0].items():
            root[c] = to | RESTART
        table = np.tile(root, (len(edges), 1))
        rows = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        table[rows, [c for e in edges for c in e]] = [to for e in edges for to in e.values()]
        # The root itself starts a phrase with whatever comes.
        table[0] = root
        found.languages.append(name)
        found.symbols.append(symbols)
        found.tables.append(table.ravel())
        found.widths.append(width)
        weights.append(np.log(max(2, len(codes))))
    return found._replace(weights=np.array(weights))


def phrases(model: Parser, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of phrases of each text in each language, and the texts' lengths."""
    codes = [cleaned(t) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    blocks = -(-sizes // BLOCK)
    n_blocks = int(blocks.sum())
    if not n_blocks:
        return counts, sizes
    flat = np.concatenate(codes)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
    lengths = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
    order = np.argsort(-lengths, kind="stable")  # those still running stay in front
    owner, starts, lengths = owner[order], starts[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(BLOCK), "left")  # blocks longer than t
    for language, (known, table, width) in enumerate(zip(model.symbols, model.tables, model.widths)):
        symbols = np.full(len(flat), width - 1, np.int32)
        inside = flat < len(known)
        symbols[inside] = known[flat[inside]]
        state, total = np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
        for t in range(int(lengths[0])):
            n = running[t]
            step = table[state[:n] * width + symbols[starts[:n] + t]]
            total[:n] += step >= RESTART
            state[:n] = step & (RESTART - 1)
        np.add.at(counts[:, language], owner, total)
    return counts, sizes


def judged(model: Parser, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    counts, sizes = phrases(model, texts)
    entropy = counts * model.weights
    ordered = np.sort(entropy, 1)
    rival = ordered[:, 1] if entropy.shape[1] > 1 else sizes * model.weights[0]
    score = np.where(sizes > 0, 1 - ordered[:, 0] / np.maximum(rival, 1e-9), 0.0)
    best = zip(entropy.argmin(1).tolist(), sizes.tolist())
    return [model.languages[k] if n else UNKNOWN for k, n in best], np.clip(score, 0.0, 1.0).tolist()


def predict(text: Column | str, model) -> Column:
    """Struct(lang_pred, score) of a text; ``model`` is a broadcast Parser, or None."""

    @F.arrow_udf("lang_pred string, score double")
    def best(texts: pa.Array) -> pa.Array:
        languages, scores = [], []
        for _, part in text_slices(texts, PARSED):
            found = judged(model.value, part)
            languages += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return best(text_or_empty(text))


def learn(labelled: DataFrame, sample_rows: int = MODEL_ROWS, sample_chars: int = MODEL_CHARS):
    """A broadcast Parser from rows (text, lang), or None if no row has a language and a letter.

    The driver gets at most ``sample_rows`` texts of each language, together ``sample_chars`` characters.
    """
    spark = labelled.sparkSession
    useful = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    hashed = useful.withColumn("h", F.xxhash64("text"))
    # Copies count once, so that a large group of copies is not all of the sample.
    distinct = hashed.select("lang", "h").distinct()
    # Two levels, so that no task gets all rows of a language.
    chosen = distinct.withColumn("part", F.pmod("h", F.lit(8)))
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= sample_rows).drop("rank")
    share = F.ceil(F.lit(sample_chars) / F.count("*").over(Window.partitionBy("lang"))).cast("int")
    chosen = chosen.select("lang", "h", share.alias("share"))
    # At most sample_rows keys for each language; the texts stay where they are.
    cut = F.call_function("substring", "text", F.lit(1), "share")
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(cut).alias("text"))
    samples: dict[str, list[str]] = {}
    for row in texts.orderBy("lang", "h").collect():
        samples.setdefault(row.lang, []).append(row.text)
    return spark.sparkContext.broadcast(parser(samples, sample_chars)) if samples else None


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of a doc_id as text leaves 2 when divided by 4; never for a null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, sample_rows: int = MODEL_ROWS, sample_chars: int = MODEL_CHARS) -> DataFrame:
    """Adds held_out, lang_pred and score to documents (doc_id, text, lang).

    Learns from the rows that are not held out and have a doc_id and a language.
    """
    (out,) = private("language")
    learned = documents.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    model = learn(learned.select("text", "lang"), sample_rows, sample_chars)
    found = documents.withColumn(out, predict("text", model))
    added = ("held_out", "lang_pred", "score")
    return found.select(*others(documents, *added), held_out("doc_id").alias("held_out"), f"{out}.*")
