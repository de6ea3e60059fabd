"""The registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.llm import bpe, chat, hard_negatives, language, line_dedup, minhash, packing, quality, shards, suffix_dedup, vector_search, warc, whitening
from urlguard.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    done = bpe.round_trip(documents, public_tokenizers.path(BYTE_BPE))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(documents).select("doc_id", *[f"quality.{c}" for c in base])


def op3_id_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    written = shards.write(documents, public_tokenizers.path(BYTE_BPE), end_id=0)
    return shards.read(spark, written).select(
        F.col("key").alias("doc_id"), F.col("place").alias("start"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


def op4_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(read(spark, folder, "pages").select("page_id", "url", "html"))
    records = warc.read_records(spark, warc.normalise(spark, archives))
    return records.select(
        warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


def op5_va_file_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector_search.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(documents, public_tokenizers.path(WORD_BPE), end_id=1, keep_ids=False)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.identify(documents).select("doc_id", "held_out", "lang_pred", "score")


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    # The SQL check has no part: all parts of a segment come with its number.
    return chat.render(read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")).drop("part")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(documents, threshold=10, least_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings").select("vec_id", "embedding"))


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(documents).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip, op2_quality_rules, op3_id_shards, op4_warc_normaliser, op5_va_file_search, op6_best_fit_packing, op7_language_id, op8_chat_formatting, op9_line_dedup, op10_minhash_near_dedup, op11_hard_negatives, op12_whitening, op13_suffix_dedup,
    )
}
SQL: dict[str, str] = {
    "op2_quality_rules": quality.check_sql(),
    "op4_warc_normaliser": warc.CHECK_SQL,
    "op5_va_file_search": vector_search.CHECK_SQL,
    "op8_chat_formatting": chat.CHECK_SQL,
    "op9_line_dedup": line_dedup.CHECK_SQL,
    "op10_minhash_near_dedup": minhash.CHECK_SQL,
    "op11_hard_negatives": hard_negatives.CHECK_SQL,
    "op13_suffix_dedup": suffix_dedup.CHECK_SQL,
}
