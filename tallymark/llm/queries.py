"""The registered corpus queries opN_<name> and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, decontamination, fingerprint_index, language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, suffix_dedup, tiered_search, token_alignment, token_counts
from .tables import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.digest(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_source_mixing, op3_line_dedup, op4_fingerprint_index, op5_quality_classifier, op6_decontamination, op7_language_id, op8_token_counts, op9_quality_rules, op10_ngram_jaccard_join, op11_token_alignment, op12_bpe_tree, op13_tiered_search)}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op4_fingerprint_index": fingerprint_index.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_ngram_jaccard_join": ngram_join.ORACLE,
    "op13_tiered_search": tiered_search.ORACLE,
}
