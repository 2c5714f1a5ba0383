"""The queries of this subpackage, as __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, interactions, jaccard, licenses, line_rules, lm, oracles, packing, prefix_trie, repeats, secrets, toxicity
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_report(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_lm_scoring, op3_substring_dedup, op4_quality_rules, op5_benchmark_decontamination, op6_license_scans, op7_chat_formatting, op8_toxicity, op9_best_fit_packing, op10_ngram_jaccard_join, op11_filter_interaction_audit, op12_bpe_codec, op13_conversation_prefix_trie)}
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": oracles.OP3,
    "op4_quality_rules": oracles.OP4,
    "op5_benchmark_decontamination": oracles.OP5,
    "op6_license_scans": licenses.sql(),
    "op10_ngram_jaccard_join": oracles.OP10,
    "op11_filter_interaction_audit": oracles.OP11,
    "op13_conversation_prefix_trie": oracles.OP13,
}
