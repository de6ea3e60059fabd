"""The corpus pipeline: documents to packed sequences, each stage written down and read again.

1. language ID drops documents without a language (null text, no letter);
2. quality rules drop documents that fail;
3. line dedup takes lines that at least ten documents share out of the texts;
4. near-dedup keeps one document of each group of near copies;
5. best-fit packing seats the remaining documents' pieces in sequences.

The first four return the columns of documents. Rows that repeat a doc_id count as one document in
stage 4 and stay together; of near copies that all lack a doc_id one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.llm import language, line_dedup, minhash, packing, quality
from urlguard.llm.common import private, read
from urlguard.session import configure, new_folder

PACKED_TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    (found,) = private("language")
    named = docs.where(F.col("doc_id").isNotNull() & ~language.held_out("doc_id"))
    model = language.learn(named.select("text", "lang"))
    told = docs.withColumn(found, language.predict("text", model))
    return told.where(F.col(f"{found}.lang_pred") != language.UNKNOWN).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality.passing(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut, out = line_dedup.cuts(docs)
    new = {"text": F.col(f"{out}.kept"), "n_chars": F.length(f"{out}.kept").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return minhash.without_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack(docs, public_tokenizers.path(PACKED_TOKENIZER), end_id=1, keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", shared_lines),
    ("minhash_near_dedup", near_copies),
    ("best_fit_packing", packed),
]
# Language models, near-duplicate groups and token ids are not SQL; tests hold brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
