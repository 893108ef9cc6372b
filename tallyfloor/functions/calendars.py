"""Calendar columns (B21) and the holiday table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Month to season.
_SEASON = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}


def season(month: Column) -> Column:
    expr = F
    for name, months in _SEASON.items():
        expr = expr.when(month.isin(*months), name)
    return expr


def day_of_week(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def calendar_fields(df: DataFrame, period: str) -> DataFrame:
    d = F.col(period)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day_of_week": day_of_week(d),
            "day_of_year": F.dayofyear(d),
            "iso_week": F.weekofyear(d),
            "is_weekend": F.weekday(d) >= 5,
            "season": season(F.month(d)),
        }
    )


def _easter(y: Column) -> Column:
    """Western Easter Sunday by the anonymous Gregorian computus."""
    div = lambda p, q: F.floor(p / q)
    a, b, c = F.pmod(y, F.lit(19)), div(y, 100), F.pmod(y, F.lit(100))
    g = div(8 * b + 13, 25)
    h = F.pmod(19 * a + b - div(b, 4) - g + 15, F.lit(30))
    l = F.pmod(32 + 2 * F.pmod(b, F.lit(4)) + 2 * div(c, 4) - h - F.pmod(c, F.lit(4)), F.lit(7))
    m = div(a + 11 * h + 19 * l, 433)
    month = div(h + l - 7 * m + 90, 25)
    day = F.pmod(h + l - 7 * m + 33 * month + 19, F.lit(32))
    return F.make_date(y, month.cast("int"), day.cast("int"))


def _fixed(y, month, day):
    return F.make_date(y, F.lit(month), F.lit(day))


def _nth_weekday(y, month, weekday, nth):
    """nth (1-based) given weekday (e.g. 'MON') of a month."""
    return F.date_add(F.next_day(F.date_sub(_fixed(y, month, 1), 1), weekday), 7 * (nth - 1))


def _last_weekday(y, month, weekday):
    return F.next_day(F.date_sub(F.last_day(_fixed(y, month, 1)), 7), weekday)


def _us_observed(d: Column) -> Column:
    dow = F.weekday(d)
    return F.when(dow == 5, F.date_sub(d, 1)).when(dow == 6, F.date_add(d, 1)).otherwise(d)


def _next_working(d: Column) -> Column:
    dow = F.weekday(d)
    return F.when(dow == 5, F.date_add(d, 2)).when(dow == 6, F.date_add(d, 1)).otherwise(d)


def _us(y):
    fixed = {
        "new_year": _fixed(y, 1, 1),
        "juneteenth": F.when(y >= 2021, _fixed(y, 6, 19)),
        "independence_day": _fixed(y, 7, 4),
        "veterans_day": _fixed(y, 11, 11),
        "christmas": _fixed(y, 12, 25),
    }
    floating = {
        "martin_luther_king": _nth_weekday(y, 1, "MON", 3),
        "presidents_day": _nth_weekday(y, 2, "MON", 3),
        "memorial_day": _last_weekday(y, 5, "MON"),
        "labor_day": _nth_weekday(y, 9, "MON", 1),
        "columbus_day": _nth_weekday(y, 10, "MON", 2),
        "thanksgiving": _nth_weekday(y, 11, "THU", 4),
    }
    return [*fixed.values(), *[_us_observed(d) for d in fixed.values()], *floating.values()]


def _bc(y):
    christmas, boxing = _fixed(y, 12, 25), _fixed(y, 12, 26)
    christmas_observed = _next_working(christmas)
    boxing_observed = _next_working(boxing)
    boxing_observed = F.when(
        boxing_observed == christmas_observed, F.date_add(christmas_observed, 1)
    ).otherwise(boxing_observed)
    reconciliation = F.when(y >= 2021, _fixed(y, 9, 30))
    fixed = [_fixed(y, 1, 1), _fixed(y, 7, 1), reconciliation, _fixed(y, 11, 11), christmas]
    observed = [_next_working(d) for d in fixed]
    floating = [
        _nth_weekday(y, 2, "MON", 3),
        F.date_sub(_easter(y), 2),
        F.date_sub(F.next_day(_fixed(y, 5, 24), "MON"), 7),
        _nth_weekday(y, 8, "MON", 1),
        _nth_weekday(y, 9, "MON", 1),
        _nth_weekday(y, 10, "MON", 2),
    ]
    return [*fixed, *observed, boxing, boxing_observed, *floating]


def holidays(spark: SparkSession, region: str, start: str, end: str) -> DataFrame:
    """One row per holiday date of a region ("US" or "BC"), generated by rule from the years."""
    first, last = int(start[:4]) - 1, int(end[:4]) + 1
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    rules = {"US": _us, "BC": _bc}[region](F.col("y"))
    return (
        years.select(F.explode(F.array(*rules)).alias("holiday"))
        .where(F.col("holiday").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .distinct()
    )
