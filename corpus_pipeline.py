"""The corpus pipeline: documents that a model is trained on, from raw documents to token ids.

Each stage is (name, function of (spark, docs, sf_dir)), takes all that the one before kept and calls one
operator. All but the last return the columns of documents; `run` writes each stage's result to the shared
folder and rereads it, so that a lost executor costs no more than a part of one stage.

Defined results: every stage takes rows as they come, repeated ones and those without a doc_id included; an empty
table gives an empty result with the stage's columns; columns beyond doc_id and text pass through all stages
but the last whatever their names; empty and very long texts are texts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import byte_bpe, decontaminate, quality_classifier, secret_scan, simhash
from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

#: Fingerprints of word sets propose near copies that 4-word shingles miss; README has the figures.
NEAR_SEEDS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Bits in which two fingerprints of one seed may differ: with eight seeds three find as many pairs as four with five, for less.
NEAR_BITS = 3
#: Of the sets of five-word shingles of two texts, from which on they are near copies.
NEAR_JACCARD = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from `labels`. A null text is scored as an empty one."""
    return quality_classifier.accept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies; of repeated rows of a doc_id one, and all rows without one. Null and empty texts are copies of each other."""
    return simhash.keep_first(docs, NEAR_BITS, word_set_seeds=NEAR_SEEDS, least_jaccard=NEAR_JACCARD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of `benchmark`; null and empty texts overlap with none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; a null text stays null, and n_chars, where there is one, is that of the new text."""
    return secret_scan.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row; a null text has no ids."""
    tokens = byte_bpe.ids_as_arrays(byte_bpe.encode(docs.select("doc_id", "text"), chars_at_once=1 << 20, cache_words=150_000).select("doc_id", "token_ids"))
    return tokens.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("byte_bpe", tokenize),
]
#: Linear algebra, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
