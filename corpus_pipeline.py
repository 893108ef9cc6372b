"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

1. ``quality_classifier`` takes out documents whose perplexity under a Kneser-Ney model of trusted text is above their language's threshold.
2. ``quality_rules`` takes out documents that fail the counting rules or whose n-grams are unlike trusted ones.
3. ``exact_dedup`` keeps one document of each group of equal texts, the one with the largest id.
4. ``simhash_dedup`` keeps one document of each group of near-duplicates, the one with the smallest id.
5. ``packing`` packs what is left into sequences of 4096 tokens with the mixture of its sources.

All but the last return the columns of ``documents``. Empty tables, null texts and ids, repeated rows and further columns are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfloor.llm import digest_index, kneser_ney, packing, quality_rules, simhash
from tallyfloor.llm.common import read, settle, ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return kneser_ney.filtered(docs, read(spark, sf_dir, "labels"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.query(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", packed),
]

#: SQL can't express the model, the fingerprints or the tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
