"""Small tables and brute-force versions the tests of the corpus operators share."""

import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def frame(spark, rows, schema):
    """Rows over several partitions."""
    return spark.createDataFrame(rows, schema).repartition(3)


def documents(spark, texts, extra=None):
    """Documents with columns that clash with what operators add."""
    names = ["kept", "quality", "lang_pred", "score", "ids", "decoded", "n_lines", "held_out", "n", "sig", "node", "key"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for name in names:
        schema.add(T.StructField(name, T.StringType()))
    rows = [(k, t, *["x"] * len(names)) for k, t in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "hello world"), (4, "hello world"), (5, "Hello  World\n\n\nagain\r\n"),
    (6, "one two three four five six"), (7, "one two three four five six"), (8, "ONE two three four five six"),
    (9, "<|endoftext|> a  <|endoftext|>"), (10, "héé ﷽ 漢字 😀 ​ x"), (None, "no id here"), (11, "aaaa" * 500),
    (12, " ".join(f"word{k % 977}" for k in range(40_000))), (13, "\x00 \x1c \x85 \xa0 "), (14, "12 345 6789"),
]
