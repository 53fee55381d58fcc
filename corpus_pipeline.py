"""A corpus pipeline of five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, folder) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm import block_names, bpe, decontamination, jaccard_join, language_id
from parlance.llm.common import configured, forget, kept, read, scratch


@configured
def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is told; what has no letter or too narrow a margin goes."""
    return language_id.without_rejected(docs)


@configured
def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One of each group of texts that are equal without white space: the longest as given, then the smallest doc_id."""
    return block_names.without_duplicates(docs)


@configured
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One of each component of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles: the smallest doc_id."""
    return jaccard_join.without_near_duplicates(docs, words=5, percent=80)


@configured
def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.without_contaminated(docs, read(spark, folder, "benchmark"))


@configured
def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they give back."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Compression, automata and similarity components can't be written in SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's result over the table documents. What a stage leaves in the shared folder goes when the next one is written."""
    docs, before = read(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = kept(stage(spark, docs, folder), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, folder)
