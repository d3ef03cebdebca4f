"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``: rules and benchmark leaks remove rows, the join leaves the document with the
smallest id of each group of near duplicates, the secret scan masks text.

Defined results: an empty table stays empty through all stages and packs to no sequences;
null texts have no words, so the first stage removes them; columns beyond those of
``documents`` pass through every stage but the last; repeated rows become one in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retainly.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from retainly.llm._store import stored
from retainly.llm.queries import tokenizer
from retainly.sources.tables import load_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer())


STAGES = [("quality_rules", rules), ("jaccard_join", near_duplicates), ("decontamination", decontaminate),
          ("secret_scan", mask_secrets), ("packing", pack)]

#: Tokenisation and the trained forest are beyond SQL; tests/llm compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
