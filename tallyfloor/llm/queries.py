"""Queries of the text operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, digest_index, interleave, kneser_ney, lexical, packing, ppm, quality_rules, simhash, spelling, superminhash, token_files, token_trie
from .common import read, ship


def _over(fn, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, *(read(spark, sf, t) for t in tables))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over(token_trie.query, "documents"),
    "op2_quality_rules": _over(quality_rules.query, "documents", "labels"),
    "op3_token_files": _over(token_files.query, "documents"),
    "op4_sharding": _over(interleave.query, "documents"),
    "op5_packing": _over(packing.query, "documents"),
    "op6_simhash": _over(simhash.query, "documents"),
    "op7_byte_bpe": _over(byte_bpe.query, "documents"),
    "op8_lm_scoring": _over(ppm.query, "documents"),
    "op9_quality_classifier": _over(kneser_ney.query, "documents", "labels"),
    "op10_exact_dedup": _over(digest_index.query, "documents"),
    "op11_spelling": _over(spelling.query, "documents"),
    "op12_lexical_search": _over(lexical.query, "documents", "benchmark"),
    "op13_superminhash": _over(superminhash.query, "documents"),
}

SQL: dict[str, str] = {"op10_exact_dedup": digest_index.SQL, "op12_lexical_search": lexical.SQL}
