"""The queries of this package: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import block_names, bpe, chat_format, decontamination, jaccard_join, language_id, license_scan, periodic_runs, simhash, token_alignment, token_counts, token_files, url_filter
from parlance.llm.common import configured, read


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_table(read(spark, folder, "documents"))


#: Rules of the url filter: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages"), URL_RULES)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = read(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(more)))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(files)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_table(read(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op8_block_names(spark: SparkSession, folder: str) -> DataFrame:
    return block_names.duplicate_groups(read(spark, folder, "documents")).drop("uid")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.link_table(read(spark, folder, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(read(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_digests(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_table(read(spark, folder, "documents"))


_ALL = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_chat_format": op4_chat_format,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_block_names": op8_block_names,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash": op13_simhash,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: configured(query) for name, query in _ALL.items()}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op2_url_filter": url_filter.oracle(URL_RULES),
    "op8_block_names": block_names.ORACLE,
}
