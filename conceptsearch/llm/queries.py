"""Registered queries of the training-data operators: each applies one
operator, with its production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conceptsearch.llm import (
    collocations,
    cuckoo_dedup,
    decontamination,
    hard_negatives,
    license_scan,
    mixing,
    near_dups,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    substrings,
    toxicity,
)
from conceptsearch.llm.tables import table


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"))


def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digests(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.slim_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_cuckoo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.groups(table(spark, sf_dir, "documents"))


def op12_hilbert_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_suffix_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_ledger, op2_sampled_splitters, op3_block_anchors, op4_order_minhash, op5_pivotal_mixing,
        op6_spaced_seeds, op7_host_rules, op8_sentence_rules, op9_site_quality, op10_factorization_machine,
        op11_cuckoo_index, op12_hilbert_blocks, op13_suffix_quicksort)
}
