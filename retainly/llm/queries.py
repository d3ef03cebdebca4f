"""One query per operator over the shared tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table
from . import (decontamination, embedding_dedup, fill_in_middle, jaccard_join, lm_scores, packing, quality_classifier, quality_rules,
               secret_scan, substring_dedup, token_counts, token_shards, whitening)


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine (the operators take the path as a parameter)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load_table(spark, sf_dir, "documents"), tokenizer())


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_digests(load_table(spark, sf_dir, "documents"), tokenizer())


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (lm_scores.lm_scores(load_table(spark, sf_dir, "documents"))
            .withColumn("score", F.round("score", 4)).withColumn("mean_score", F.round("mean_score", 4)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(load_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load_table(spark, sf_dir, "documents"), tokenizer())


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality_rules.quality_rules(load_table(spark, sf_dir, "documents"))
            .withColumn("host_rate", F.round("host_rate", 9)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(load_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digests(load_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_best_fit_packing, op3_token_shards, op4_lm_scores,
                                op5_substring_dedup, op6_quality_classifier, op7_token_counts,
                                op8_benchmark_decontamination, op9_quality_rules, op10_secret_scan, op11_embedding_dedup,
                                op12_fill_in_middle, op13_whitening)}
ORACLES = {"op4_lm_scores": lm_scores.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
