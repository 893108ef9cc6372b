"""Dense unit x period panels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def period_counts(events: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Conditional counts per key. The partial aggregate runs before the shuffle, so a hot
    unit sends at most one row per period and task."""
    return events.groupBy(*keys).agg(
        *[F.coalesce(F.sum(m.cast("long")), F.lit(0)).alias(n) for n, m in measures.items()]
    )


def densify(
    counts: DataFrame,
    unit: Sequence[str],
    period: str,
    measures: Sequence[str],
    start: str,
    end: str,
    units: DataFrame | None = None,
) -> DataFrame:
    """One row per unit and day from ``start`` to ``end``, absent counts zero.

    Gaps are filled from each row up to the next one of the same unit, so the calendar is
    never crossed with the units. ``units`` adds units without any count. A unit holds at
    most one row per period here, however many events it had.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = counts.where(F.col(period).between(first, last)).select(*unit, period, *measures)
    if units is not None:
        rows = (
            rows.unionByName(
                units.select(*unit).distinct().select(
                    *unit, first.alias(period), *[F.lit(0).cast("long").alias(m) for m in measures]
                )
            )
            .groupBy(*unit, period)
            .agg(*[F.sum(m).alias(m) for m in measures])
        )
    w = W.partitionBy(*unit).orderBy(period)
    begin = F.when(F.lag(period).over(w).isNull(), first).otherwise(F.col(period))
    stop = F.coalesce(F.date_sub(F.lead(period).over(w), 1), last)
    spans = rows.withColumns({"__begin": begin, "__stop": stop})
    filled = spans.withColumn("__day", F.explode(F.sequence("__begin", "__stop")))
    own = F.col("__day") == F.col(period)
    return filled.select(
        *unit,
        F.col("__day").alias(period),
        *[F.when(own, F.col(m)).otherwise(F.lit(0)).cast("long").alias(m) for m in measures],
    )


def window_disposition(counts: DataFrame, period: str, measures: Sequence[str], start: str, end: str) -> DataFrame:
    """What a calendar from ``start`` to ``end`` takes in and leaves out: rows and sums by place (before, inside, after, or undated)."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    place = F.when(F.col(period).isNull(), "undated").when(F.col(period) < first, "before").when(F.col(period) > last, "after").otherwise("inside")
    return counts.groupBy(place.alias("place")).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def add_lags(df: DataFrame, unit: Sequence[str], period: str, lags: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Strict lags on a dense panel; the first ``k`` periods of each unit are null."""
    w = W.partitionBy(*unit).orderBy(period)
    return df.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in lags.items()})


def within_domain(df: DataFrame, domain: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key belongs to the domain."""
    return df.join(domain.select(*on).distinct(), list(on), "left_semi")


def flag_domain(df: DataFrame, domain: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """All rows, with a flag for membership."""
    member = domain.select(*on).distinct().withColumn("__in", F.lit(True))
    return df.join(member, list(on), "left").withColumn(
        name, F.coalesce("__in", F.lit(False))
    ).drop("__in")


def endpoint_flow(
    trips: DataFrame,
    start: tuple[str, Column],
    end: tuple[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """In, out, total and net (in minus out) per place and day, from one scan of the trips."""
    out = F.struct(F.col(start[0]).alias("place"), start[1].alias("period"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = F.struct(F.col(end[0]).alias("place"), end[1].alias("period"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = trips.select(*keys, F.explode(F.array(out, into)).alias("e")).select(*keys, "e.*")
    return (
        ends.where(F.col("place").isNotNull() & F.col("period").isNotNull())
        .groupBy(*keys, "place", "period")
        .agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"))
        .withColumns(
            {"total_flow": F.col("inflow") + F.col("outflow"), "net_flow": F.col("inflow") - F.col("outflow")}
        )
    )


def block_ids(df: DataFrame, period: str, length: int, origin: Column | str, name: str = "block_id") -> DataFrame:
    """Whole blocks of ``length`` days counted from ``origin``."""
    first = F.lit(origin).cast("date") if isinstance(origin, str) else origin
    return df.withColumn(name, F.floor(F.datediff(F.col(period), first) / length).cast("int"))


def first_period(df: DataFrame, period: str) -> Column:
    """Earliest period of the whole frame as a scalar."""
    return df.agg(F.min(period).alias("first")).scalar()


def coarsen(df: DataFrame, factor: int, x: str, y: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Integer-divide both grid indices and add up."""
    return (
        df.withColumns({x: F.floor(F.col(x) / factor), y: F.floor(F.col(y) / factor)})
        .groupBy(*keys, x, y)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def week_start(period: Column) -> Column:
    return F.trunc(period, "week")


def complete_week_bounds(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """First and last Monday of whole weeks inside the range, and the number of such weeks."""
    first = F.next_day(F.date_sub(start, 1), "MON")
    last = F.date_sub(F.next_day(F.date_sub(end, 6), "MON"), 7)
    last = F.when(F.date_add(last, 13) <= end, F.date_add(last, 7)).otherwise(last)
    return first, last, (F.datediff(last, first) / 7 + 1).cast("int")


def to_weekly(
    df: DataFrame,
    unit: Sequence[str],
    period: str,
    measures: Sequence[str],
    flags: Sequence[str] = (),
    complete_only: bool = True,
    split: Callable[[Column], Column] | None = None,
    split_by: str = "start",
) -> DataFrame:
    """Sums per unit and Monday week; ``period_end`` is the last day present. ``split`` labels each week by its
    start or, with ``split_by`` "end", by its end."""
    out = (
        df.withColumn("period_start", week_start(F.col(period)))
        .groupBy(*unit, "period_start")
        .agg(
            F.max(period).alias("period_end"),
            F.count("*").alias("days_in_period"),
            *[F.sum(m).alias(m) for m in measures],
            *[F.max(f).alias(f"contains_{f}") for f in flags],
        )
    )
    if split is not None:
        out = out.withColumn("split", split(F.col({"start": "period_start", "end": "period_end"}[split_by])))
    return out.where(F.col("days_in_period") == 7) if complete_only else out
