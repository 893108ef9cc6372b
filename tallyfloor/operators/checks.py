"""Expectation tables and key relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def expect(df: DataFrame, rules: Mapping[str, tuple[Column, object]], keys: Sequence[str] = ()) -> DataFrame:
    """One row per check: observed aggregate beside what it should be. One pass over the data."""
    aggs, rows = [], []
    for name, (observed, expected) in rules.items():
        aggs.append(observed.cast("double").alias(f"__{name}"))
        want = expected if isinstance(expected, Column) else F.lit(expected)
        rows.append(
            F.struct(F.lit(name).alias("check"), want.cast("double").alias("expected"), F.col(f"__{name}").alias("observed"))
        )
    one = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    out = one.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    near = F.abs(F.col("observed") - F.col("expected")) <= 1e-9
    return out.withColumn("status", F.when(near, "PASS").otherwise("FAIL"))


def require(checks: DataFrame) -> DataFrame:
    """The table itself; any row that fails stops the job when it is read."""
    failed = F.raise_error(F.concat(F.lit("check failed: "), F.col("check")))
    return checks.withColumn("status", F.when(F.col("status") == "FAIL", failed).otherwise(F.col("status")))


def key_relation(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """How the keys of two tables match, from counts per key on both sides."""
    a = left.groupBy(*on).agg(F.count("*").alias("__a"))
    b = right.groupBy(*on).agg(F.count("*").alias("__b"))
    both = a.join(b, list(on), "full_outer").fillna(0, ["__a", "__b"])
    out = both.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("__b") == 0).alias("left_only"),
        F.count_if(F.col("__a") == 0).alias("right_only"),
        F.max("__a").alias("max_left"),
        F.max("__b").alias("max_right"),
    )
    one = lambda c: F.col(c) <= 1
    kind = F.when(one("max_left") & one("max_right"), "one_to_one").when(one("max_right"), "many_to_one").when(
        one("max_left"), "one_to_many").otherwise("many_to_many")
    return out.withColumns({"relation": kind, "full_match": (F.col("left_only") == 0) & (F.col("right_only") == 0)})


def panel_integrity(panel: DataFrame, unit: str, period: str, y: str, y1: str, start: str, end: str) -> DataFrame:
    """Row count, unique keys, equal length, date range, non-negative counts, lag identity.

    The lag identity uses totals: the lags of a unit add up to its counts less the last one.
    """
    per_unit = panel.groupBy(unit).agg(
        F.count("*").alias("days"), F.min(period).alias("lo"), F.max(period).alias("hi"),
        F.sum(y).alias("sy"), F.sum(y1).alias("sl"), F.max_by(y, period).alias("last"),
        F.min(y).alias("low"), F.count_if(F.col(y1).isNull()).alias("nulls"),
    )
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    bad = F.count_if
    wrong = (F.col("lo") != F.lit(start).cast("date")) | (F.col("hi") != F.lit(end).cast("date"))
    return expect(
        per_unit,
        {
            "rows_over_units": (F.sum("days") / F.count("*"), days),
            "unequal_length": (bad(F.col("days") != days), 0),
            "wrong_range": (bad(wrong), 0),
            "negative": (bad(F.col("low") < 0), 0),
            "lag_identity": (bad(F.col("sl") != F.col("sy") - F.col("last")), 0),
            "first_lag_null": (bad(F.col("nulls") != 1), 0),
        },
    )
