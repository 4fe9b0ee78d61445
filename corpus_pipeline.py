"""The training-corpus pipeline: each stage works on all that its predecessor kept.

Documents judged toxic go; near-duplicate lines go, the earliest stays; one document
of each near-duplicate group stays; documents that hold a benchmark item go; what is
left is encoded and decoded.

Every stage but the last returns the columns of its documents; all take null and empty
texts, null ids, repeated rows and empty tables, with the results that the operators'
modules define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm import bpe_codec, decontaminate, line_dedup, shared, simhash_dedup, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches their language's threshold; null texts score as empty, repeated rows alike, null ids don't train."""
    return toxicity.reject(docs, shared.read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal or are near an earlier one by (id, place), and their lengths; null texts stay null, a null id counts as last, repeated rows as one document."""
    return line_dedup.deduplicate(docs, min_words=line_dedup.LEAST_WORDS).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id; rows that share it all stay, rows without an id only where their group has none."""
    return simhash_dedup.deduplicate(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; null texts hold none, repeated rows go or stay together."""
    return decontaminate.clean(docs, shared.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids, their number and the decoded text of each document; null texts count as empty, repeated rows give repeated results."""
    return bpe_codec.encode_documents(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe_encode_decode", encode),
]

#: No stage but the last could be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
