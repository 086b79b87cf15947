"""The registered queries of this package and their comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sourcemark.llm import (
    alignment,
    chat,
    decontaminate,
    html_extract,
    mixing,
    near_dup,
    personal_data,
    quality_classifier,
    quality_rules,
    token_counts,
    token_files,
    vector_codes,
    warc,
)
from sourcemark.llm.common import read_table


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and draw of every document."""
    documents, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_classifier.classify(documents, labels)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    documents, benchmark = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.digest(decontaminate.scan(documents, benchmark))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as ORC files and read back."""
    return token_files.tokens_round_trip(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by merging."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, archived, normalised and read back."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted, written and read back."""
    return chat.round_trip(chat.with_probe(read_table(spark, sf_dir, "conversations")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizations of every document."""
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), *ALIGNED)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data.digest(personal_data.find_personal_data(read_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector."""
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_near_dup": op6_near_dup,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op6_near_dup": near_dup.oracle_sql(),
    "op7_warc": warc.oracle_sql(),
    "op8_chat": chat.oracle_sql(),
    "op9_mixing": mixing.oracle_sql(),
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
