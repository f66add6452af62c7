"""Queries of the operators over their whole tables, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import (alignment, bpe, byte_bpe, importance, phrases, pii, quality, quotes, repetition, secrets, simhash,
                           token_counts, warc)
from twinsieve.llm.rows import table
from twinsieve.plans.workspace import Workspace

#: Tokenizer files of the queries; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens beyond which a text is over the limit.
TOKEN_LIMIT = 2048


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{Workspace(spark).root}/archives"
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.reply_order(Workspace(spark), table(spark, sf, "conversations"))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", secrets.find_secrets("text").alias("s")).select("doc_id", "s.*")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(base), 256).alias("base_sha256"),
                        secrets.written("spans").alias("spans"))


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", bpe.round_trip("text", WORD_BPE).alias("r")).select("doc_id", "r.*")


def op5_repetition(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").select("doc_id", repetition.rules("text").alias("c")).select("doc_id", "c.*")
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         repetition.base_failed().alias("base_failed"), repetition.kept().alias("kept"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = phrases.find_passages(Workspace(spark), table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hits = F.col("n_hit")
    return found.withColumn("n_hit", phrases.n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        phrases.contaminated(hits, F.col("n_words")).alias("contaminated"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(Workspace(spark), table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.token_counts(Workspace(spark), table(spark, sf, "documents"), WORD_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit_on(docs, quality.grade_labels(table(spark, sf, "labels")))
    return docs.select("doc_id", quality.graded(model, "text").alias("g")).select("doc_id", "g.*")


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(Workspace(spark), table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < pii.BASE)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(pii.written(base), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = byte_bpe.encoded(Workspace(spark), table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance(spark: SparkSession, sf: str) -> DataFrame:
    found = importance.resample(Workspace(spark), table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.linked(Workspace(spark), table(spark, sf, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_quotes, op3_secrets, op4_bpe, op5_repetition, op6_decontaminate, op7_simhash, op8_token_counts,
    op9_quality, op10_pii, op11_byte_bpe, op12_importance, op13_alignment)}
