"""Discrete states of counts (B24-B30) and the split label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Labels of the count states and of the cut-point states.
COUNT_LABELS = ("zero", "one", "two", "three_plus")
COARSE_LABELS = ("zero", "one", "two_plus")
CUT_LABELS = ("zero", "low", "medium", "high")


def count_code(c: Column, top: int = 3) -> Column:
    """0..top with everything above collected in ``top``; null for null or negative input."""
    return F.when(c >= 0, F.least(F.floor(c), F.lit(top))).cast("int")


def count_label(c: Column, labels: Sequence[str] = COUNT_LABELS) -> Column:
    return F.get(F.array(*[F.lit(v) for v in labels]), count_code(c, len(labels) - 1))


def cut_code(c: Column, cuts: Column, k: int | None = None) -> Column:
    """0 for zero, then 1 + number of cut points strictly below the value; null if negative.
    Give the number of cut points ``k`` when ``cuts`` is a scalar subquery."""
    if k is None:
        below = F.size(F.filter(cuts, lambda cut: cut < c))
    else:
        below = sum(((cuts[i] < c).cast("int") for i in range(k)), F.lit(0))
    return F.when(c == 0, F.lit(0)).when(c > 0, below + 1).cast("int")


def cut_label(c: Column, cuts: Column, labels: Sequence[str] = CUT_LABELS, k: int | None = None) -> Column:
    return F.get(F.array(*[F.lit(v) for v in labels]), cut_code(c, cuts, k))


def class_binary(c: Column) -> Column:
    return (c > 0).cast("int")


def class_three(c: Column) -> Column:
    return F.when(c > 2, F.lit(2)).otherwise(c).cast("int")


def half_up(c: Column) -> Column:
    """Nonnegative integer nearest to the value, halves upward."""
    return F.floor(F.when(c < 0, F.lit(0.0)).otherwise(c) + F.lit(0.5))


def top_code(c: Column, cap) -> Column:
    top = cap if isinstance(cap, Column) else F.lit(cap)
    return F.when(c > top, top).otherwise(c)


def abs_measure(c: Column) -> Column:
    return F.abs(c)


def split_label(period: Column, train_end: str, validation_end: str) -> Column:
    return (
        F.when(period <= F.lit(train_end).cast("date"), "train")
        .when(period <= F.lit(validation_end).cast("date"), "validation")
        .otherwise("test")
    )


def per_area_time(mse: Column, area: Column, duration: Column) -> Column:
    """Squared error of a rate: MSE over (area x duration) squared."""
    return mse / (area * duration) / (area * duration)


def per_area_time_root(mse: Column, area: Column, duration: Column) -> Column:
    return F.sqrt(mse) / (area * duration)


def entropy_power_ratio(delta_bits: Column) -> Column:
    return F.pow(F.lit(2.0), -2.0 * delta_bits)
