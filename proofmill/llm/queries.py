"""The registered queries: each operator with its production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import (
    chat, conversation_repair, decontamination, jaccard_join, language_id, mixing, sentence_pieces, sharding, token_counts, tokenizer_alignment,
    top_k, toxicity, warc,
)
from proofmill.llm.common import id_remainder, table, word_count
from proofmill.session import fresh_path, written_once


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    profiles = language_id.fit_profiles(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.identify(F.col("text"), profiles).alias("o"))
    return found.select("doc_id", "held_out", F.col("o.lang").alias("lang_pred"), "o.score", "o.margin")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", token_counts.token_counts(F.col("text"), token_counts.read_vocabulary()).alias("o"))
    return counted.select("doc_id", "o.n_words", "o.n_tokens")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), top_k.quantized(F.col("embedding")).alias("v"))
    vectors = vectors.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    return top_k.top_k(vectors, vectors.filter(F.col("id") % 100 == 0))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.interleave(rows, "source", "doc_id", ("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = written_once(warc.read_records(spark, path, payloads=False), "records")
    pages = warc.resolved(warc.reassemble(records, payloads=False))
    return pages.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), texts=False)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        byte_level = file.read()
    pieces = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    aligned = tokenizer_alignment.align(table(spark, sf_dir, "documents"), byte_level, pieces, texts=False)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = table(spark, sf_dir, "documents").select("doc_id", sentence_pieces.encode(F.col("text"), model).alias("ids"))
    decoded = encoded.withColumn("text", sentence_pieces.decode(F.col("ids"), model))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_top_k": op4_top_k,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_perspectives": op7_chat_perspectives,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_sentencepiece": op13_sentencepiece,
}
