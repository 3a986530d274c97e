"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, mixing, secrets, simhash, suffix_dedup, telephony, token_count, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, character offsets and round trip of every document."""
    return bpe.encode(_documents(spark, sf_dir), keep_text=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return token_count.token_counts(_documents(spark, sf_dir))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents."""
    return secrets.scan(_documents(spark, sf_dir))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats across documents."""
    return suffix_dedup.repeated_passages(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity, by a network fitted on the labels."""
    net = toxicity.fitted(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_documents(spark, sf_dir), net)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document in a mix of sources and languages as large as the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mixing.mix_decisions(docs, mixing.source_and_language())


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a telephony payload, decoded and resampled to 16 kHz.

    The tables hold no audio. Any bytes are a valid payload of these codecs, so the bytes of each text stand
    for one; the codec goes by doc_id."""
    kinds = F.array(*map(F.lit, telephony.CODECS))
    media = _documents(spark, sf_dir).select("doc_id", F.element_at(kinds, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("codec"), F.encode("text", "utf-8").alias("payload"))
    return telephony.decode_audio(media)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a group of near duplicates, with the one that stays."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trees of the conversations."""
    return chat.prefix_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locally consistent parse of every document."""
    return fingerprint.fingerprints(_documents(spark, sf_dir))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_toxicity": op3_toxicity,
    "op4_source_mix": op4_source_mix,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_chat_prefix_tree": op7_chat_prefix_tree,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_token_counts": op10_token_counts,
}
ORACLE: dict[str, str] = {
    "op1_secret_scan": secrets.scan_sql(),
    "op2_repeated_passages": suffix_dedup.SQL,
}
