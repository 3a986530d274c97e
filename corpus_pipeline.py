"""The training-data pipeline: reject toxic documents, keep one of each group of near duplicates, blank out
secrets, mix sources and languages to target weights, and encode.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Each is written as Parquet and read again as the next one's docs, in the shared folder of the session; what a stage
wrote goes when the next one is done.

Defined results: columns of any other name are carried to the last stage, which puts ``_in`` behind those that bear
an output's name. A document whose text is null isn't toxic, is no near duplicate and has no secret; it has no
tokens, so the mix takes or leaves it with the document after it, and its ids are null. Empty texts are near
duplicates of one another: one stays. Rows of one doc_id with different texts are different documents; rows equal in
doc_id and text are copies of which one stays. Texts of any length go through whole. A document without a source
or a language counts for the other; one without either isn't in the mix. Without labels of both kinds no document
is toxic. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shirabe.llm import bpe, mixing, secrets, simhash, toxicity
from shirabe.llm.common import drop_table, keep_table, scratch, write_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled documents of ``sf_dir``, doesn't reject."""
    net = toxicity.fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return simhash.drop_near_duplicates(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blanked out and n_chars brought up to date."""
    return secrets.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, once for each copy; as large as what comes in."""
    return mixing.mix_rows(docs, mixing.source_and_language())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and character offsets of every document."""
    return bpe.encode(docs, keep_text=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the network nor the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
            keep_table(path)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
