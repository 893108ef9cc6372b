"""Targeted repair of stored tables (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfloor.functions.cleaning import remove_flag


def reclassify(df: DataFrame, ids: list[str], id_col: str, source: str, flags: str, flag: str, to: str) -> DataFrame:
    """Listed ids lose their non-public mark; everything else passes through unchanged."""
    hit = F.col(id_col).isin(*ids) & (F.col(source) == "non_public_node")
    return df.withColumns({
        "changed": hit,
        source: F.when(hit, F.lit(to)).otherwise(F.col(source)),
        flags: F.when(hit, remove_flag(F.col(flags), flag)).otherwise(F.col(flags)),
    })


def touched_partitions(df: DataFrame, ids: list[str], id_col: str, partition: list[str]) -> DataFrame:
    """Partitions that hold a listed id; only these need a rewrite."""
    return df.where(F.col(id_col).isin(*ids)).select(*partition).distinct()


def backfill(df: DataFrame, dictionary: DataFrame, key: str, order: str, lat: str, lon: str) -> DataFrame:
    """Missing coordinates take the earliest known ones of the same key."""
    first = dictionary.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), order).alias("__first")
    )
    gap = F.col(lat).isNull() | F.col(lon).isNull()
    return df.join(first, key, "left").withColumns({
        "filled": gap & F.col("__first").isNotNull(),
        lat: F.coalesce(F.when(~gap, F.col(lat)), F.col("__first.lat")),
        lon: F.coalesce(F.when(~gap, F.col(lon)), F.col("__first.lon")),
    }).drop("__first")


def apply_deltas(table: DataFrame, deltas: DataFrame, on: list[str], column: str) -> DataFrame:
    """Add the delta of each key to a counter."""
    d = deltas.groupBy(*on).agg(F.sum(column).alias("__d"))
    return table.join(d, on, "left").withColumn(column, F.col(column) + F.coalesce("__d", F.lit(0))).drop("__d")


def drop_resolved(exceptions: DataFrame, resolved: DataFrame, on: list[str]) -> DataFrame:
    return exceptions.join(resolved.select(*on).distinct(), on, "left_anti")
