"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import keyed_join, running_totals, settle


def interleave(docs: DataFrame, shards: int = 16, stratum: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (place in the shard, gapless from 0) to all rows.

    Rows of each stratum are ranked in a seeded shuffle (the hash of seed and key), all rows are sorted by their
    fractional rank (rank + 1/2) / size of the stratum, and the sequence is cut in equal lengths: every shard, and every
    prefix of one, holds the mixture of the whole to within a row for each stratum, and shards' counts differ by one at
    most. Columns of ``docs`` stay; pass only those that should travel, since the rows are sorted twice.

    A stratum of any size is spread over as many ranges as its rows need. Null strata form one of their own, null
    keys are shuffled like others, and repeated rows are each placed (a row tag tells them apart).
    Columns of docs may have any name but those that begin with an underscore."""
    columns = docs.columns
    tagged = settle(docs.select(
        *columns, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("_stratum"), F.xxhash64(F.lit(seed), F.col(key)).alias("_mix"),
        F.monotonically_increasing_id().alias("_tag"), F.lit(1).cast("long").alias("_one"),
    ))
    ranked = settle(running_totals(tagged, ["_stratum", "_mix", "_tag"], "_one", "_place"))
    strata = ranked.groupBy("_stratum").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    total = ranked.count()
    fraction = (2 * (F.col("_place") - F.col("_first")) + 1) / (2.0 * F.col("_size"))
    mixed = settle(keyed_join(ranked, settle(strata), "_stratum", "_size", total).select(*columns, "_mix", "_tag", "_one", fraction.alias("_fraction")))
    placed = running_totals(mixed, ["_fraction", "_mix", "_tag"], "_one", "_place")
    shard = F.expr(f"((_place + 1) * {shards} - 1) div {max(1, total)}")  # the largest s with floor(s * total / shards) <= place
    first = F.expr(f"(shard * {total}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_place") - first).cast("long")).select(*columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes the rows of each shard, in order, below ``path/shard=k``."""
    placed = interleave(docs, shards, **options)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def query(spark, docs: DataFrame) -> DataFrame:
    """The contract's rows; the digests are taken at the scan, so no text is shuffled."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(narrow, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
