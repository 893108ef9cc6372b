"""Floors on the error of integer forecasts (G1-G8), as column expressions.

The maximum-entropy law on the integers with a given mean square is
``q(k) ~ exp(-lam * k^2)``. Its entropy ``H`` (bits) and mean square ``D`` both fall
with ``lam``; the floor for entropy ``h`` is ``D`` at the ``lam`` where ``H = h``.
Both lattice sums are taken directly for ``lam >= 2`` and in their Poisson dual below,
so a handful of terms reaches double precision everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_LN2 = repr(math.log(2.0))
_PI2 = repr(math.pi**2)

# Search range for ln(lam): covers entropies from about 1e-40 up to 25 bits.
LOG_LOW, LOG_SPAN, STEPS = -32.0, 38.0, 58


def _direct(l: str, weight) -> str:
    return "(" + " + ".join(f"{weight(k)} * exp(-{float(k * k)}D * {l})" for k in range(1, 6)) + ")"


def _dual(l: str, weight) -> str:
    return "(" + " + ".join(
        f"{weight(m)} * exp(-{_PI2}D * {float(m * m)}D / {l})" for m in range(1, 4)
    ) + ")"


def mean_square_sql(l: str) -> str:
    """D as a function of ``lam``."""
    direct = f"({_direct(l, lambda k: f'{2.0 * k * k}D')} / (1D + {_direct(l, lambda k: '2D')}))"
    theta = f"(1D + {_dual(l, lambda m: '2D')})"
    moment = _dual(l, lambda m: f"{2.0 * m * m}D")
    dual = f"(0.5D / {l} - {_PI2}D / ({l} * {l}) * {moment} / {theta})"
    return f"(CASE WHEN {l} >= 2D THEN {direct} ELSE {dual} END)"


def entropy_sql(l: str) -> str:
    """H in bits as a function of ``lam``; ``log1p`` keeps tiny entropies exact."""
    tail = _direct(l, lambda k: "2D")
    direct = f"(log1p({tail}) + {l} * {_direct(l, lambda k: f'{2.0 * k * k}D')} / (1D + {tail}))"
    theta = f"(1D + {_dual(l, lambda m: '2D')})"
    moment = _dual(l, lambda m: f"{2.0 * m * m}D")
    dual = (
        f"(0.5D * ln(pi() / {l}) + ln({theta}) + 0.5D - {_PI2}D / {l} * {moment} / {theta})"
    )
    return f"(CASE WHEN {l} >= 2D THEN {direct} ELSE {dual} END) / {_LN2}D"


def _named(c: Column | str, name: str) -> str:
    if not isinstance(c, str):
        raise TypeError(f"{name} takes a column name; alias the expression first")
    return f"`{c}`"


def _solve(level: str, curve: str) -> str:
    """ln(lam) where a curve that falls in lam meets ``level``: bisection by halving steps."""
    inner = (
        f"element_at(transform(array(exp(acc.lo + acc.step)), lam -> {curve}), 1) >= {level}"
    )
    return (
        f"aggregate(sequence(1, {STEPS}), "
        f"named_struct('lo', {LOG_LOW}D, 'step', {LOG_SPAN / 2}D), "
        f"(acc, i) -> named_struct('lo', IF({inner}, acc.lo + acc.step, acc.lo), "
        f"'step', acc.step / 2D), acc -> exp(acc.lo))"
    )


def exact_floor(h: str) -> Column:
    """Smallest mean squared error of any integer forecast of a law with entropy column ``h``."""
    level = _named(h, "exact_floor")
    at = f"element_at(transform(array({_solve(level, entropy_sql('lam'))}), z -> {mean_square_sql('z')}), 1)"
    return F.expr(f"CASE WHEN {level} <= 0 THEN 0D WHEN {level} > 0 THEN {at} END")


def law_rate(d: str) -> Column:
    """lam of the maximum-entropy law with mean square column ``d``."""
    level = _named(d, "law_rate")
    return F.expr(f"CASE WHEN {level} > 0 THEN {_solve(level, mean_square_sql('lam'))} END")


def max_entropy(d: str) -> Column:
    """Largest entropy (bits) of an integer law with mean square column ``d``."""
    level = _named(d, "max_entropy")
    lam = _solve(level, mean_square_sql("lam"))
    at = f"element_at(transform(array({lam}), z -> {entropy_sql('z')}), 1)"
    return F.expr(f"CASE WHEN {level} <= 0 THEN 0D WHEN {level} > 0 THEN {at} END")


def closed_floor(h: Column) -> Column:
    """Entropy-power floor less the variance of the unit cell, not below zero."""
    value = F.pow(F.lit(2.0), 2.0 * h) / F.lit(2 * math.pi * math.e) - F.lit(1.0 / 12.0)
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def fano_floor(h: str, classes: int) -> Column:
    """Smallest error rate of a classifier over ``classes`` labels at conditional entropy ``h``."""
    col = _named(h, "fano_floor")
    top = 1.0 - 1.0 / classes
    extra = math.log2(classes - 1)
    p = "(acc.lo + acc.step)"
    phi = f"(-{p} * log2({p}) - (1D - {p}) * log2(1D - {p}) + {p} * {extra!r}D)"
    search = (
        f"aggregate(sequence(1, 60), named_struct('lo', 0D, 'step', {top / 2!r}D), "
        f"(acc, i) -> named_struct('lo', IF({phi} <= {col}, {p}, acc.lo), 'step', acc.step / 2D), "
        f"acc -> acc.lo)"
    )
    return F.expr(
        f"CASE WHEN {col} <= 0 THEN 0D WHEN {col} >= {math.log2(classes)!r}D THEN {top!r}D "
        f"WHEN {col} > 0 THEN {search} END"
    )


# --- interpolated floors ------------------------------------------------------------------
# Knots every 0.001 up to 0.1 bits, every 0.005 up to 4, every 0.01 above.


def floor_table(spark: SparkSession, max_h: float = 8.0) -> DataFrame:
    """Knots of ln(1 + floor) with monotone cubic slopes; its size is set by ``max_h`` alone."""
    top = int(math.floor(max_h * 100 + 0.5))
    if top < 400:
        raise ValueError("the table must reach 4 bits")
    size = 101 + 780 + (top - 400)
    i = F.col("id")
    h = (
        F.when(i <= 100, i / 1000.0)
        .when(i <= 880, 0.1 + (i - 100) * 5 / 1000.0)
        .otherwise(4.0 + (i - 880) / 100.0)
    )
    knots = (
        spark.range(0, size, 1, 8)
        .select(F.col("id").cast("int").alias("knot"), h.alias("h"))
        .withColumn("v", F.log1p(exact_floor("h")))
    )
    w = W.orderBy("knot")  # fixed size: a few thousand rows at most
    step, rise = F.lead("h").over(w) - F.col("h"), F.lead("v").over(w) - F.col("v")
    knots = knots.withColumns({"step": step, "secant": rise / step})
    knots = knots.withColumns(
        {"step_0": F.lag("step").over(w), "secant_0": F.lag("secant").over(w),
         "step_2": F.lead("step").over(w), "secant_2": F.lead("secant").over(w),
         "step_00": F.lag("step", 2).over(w), "secant_00": F.lag("secant", 2).over(w)}
    )
    c = F.col
    w1, w2 = 2 * c("step") + c("step_0"), c("step") + 2 * c("step_0")
    harmonic = (w1 + w2) / (w1 / c("secant_0") + w2 / c("secant"))
    interior = F.when(c("secant_0") * c("secant") > 0, harmonic).otherwise(0.0)

    def edge(h0, h1, m0, m1):
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return (
            F.when(F.signum(d) != F.signum(m0), F.lit(0.0))
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0)
            .otherwise(d)
        )

    slope = (
        F.when(c("secant_0").isNull(), edge(c("step"), c("step_2"), c("secant"), c("secant_2")))
        .when(c("secant").isNull(), edge(c("step_0"), c("step_00"), c("secant_0"), c("secant_00")))
        .otherwise(interior)
    )
    knots = knots.withColumn("slope", slope)
    return knots.select(
        "knot", "h", "v", "slope", "step",
        F.lead("v").over(w).alias("v_next"), F.lead("slope").over(w).alias("slope_next"),
    ).where(c("step").isNotNull())


def knot_index(h: Column, last: int) -> Column:
    """Index of the knot interval that holds ``h``."""
    fine = F.floor(h * 1000 + 1e-9)
    mid = 100 + F.floor((h - 0.1) * 200 + 1e-9)
    wide = 880 + F.floor((h - 4.0) * 100 + 1e-9)
    raw = F.when(h < 0.1, fine).when(h < 4.0, mid).otherwise(wide)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(last)).cast("int")


def interp_floor(df: DataFrame, h: str, table: DataFrame, out: str, max_h: float = 8.0) -> DataFrame:
    """Floor of ``h`` from the table. The table is broadcast: its row count follows from
    ``max_h`` (about 1300 rows for 8 bits) and not from the data."""
    last = 880 + int(math.floor(max_h * 100 + 0.5)) - 400 - 1
    x = F.when(F.col(h) < 0, F.lit(0.0)).otherwise(F.col(h))
    checked = F.when(x > max_h, F.raise_error(F.lit("entropy exceeds the floor table"))).otherwise(x)
    t = F.broadcast(
        table.select(*[F.col(n).alias(f"__{n}") for n in table.columns])
    )
    keyed = df.withColumn("__x", checked).withColumn("__key", knot_index(F.col("__x"), last))
    u = (F.col("__x") - F.col("__h")) / F.col("__step")
    cubic = (
        (2 * u * u * u - 3 * u * u + 1) * F.col("__v")
        + (u * u * u - 2 * u * u + u) * F.col("__step") * F.col("__slope")
        + (3 * u * u - 2 * u * u * u) * F.col("__v_next")
        + (u * u * u - u * u) * F.col("__step") * F.col("__slope_next")
    )
    return (
        keyed.join(t, F.col("__key") == F.col("__knot"), "left")
        .withColumn(out, F.expm1(cubic))
        .drop("__x", "__key", *[f"__{n}" for n in table.columns])
    )


def attach_floors(df: DataFrame, h0: str, hb: str, table: DataFrame | None = None,
                  max_h: float = 8.0) -> DataFrame:
    """Project the entropy pair to ``0 <= hb <= h0`` and add both floors and their difference.
    The raw entropies stay as they are. With a table the floors are interpolated."""
    known = F.col(h0).isNotNull() & F.col(hb).isNotNull()
    out = df.withColumn("h0_bound", F.when(known, F.greatest(F.col(h0), F.lit(0.0)))).withColumn(
        "hb_bound", F.when(known, F.least(F.greatest(F.col(hb), F.lit(0.0)), F.col("h0_bound")))
    )
    if table is None:
        out = out.withColumns({"l0": exact_floor("h0_bound"), "lb": exact_floor("hb_bound")})
    else:
        out = interp_floor(out, "h0_bound", table, "l0", max_h)
        out = interp_floor(out, "hb_bound", table, "lb", max_h)
    return out.withColumns(
        {
            "delta_l": F.col("l0") - F.col("lb"),
            "relative_delta_l": F.when(F.col("l0") > 0, (F.col("l0") - F.col("lb")) / F.col("l0")),
            "closed_l0": closed_floor(F.col("h0_bound")),
            "closed_lb": closed_floor(F.col("hb_bound")),
            "projected": (F.col("h0_bound") != F.col(h0)) | (F.col("hb_bound") != F.col(hb)),
        }
    )


def gap_metrics(df: DataFrame, mse0: str, mseb: str, l0: str, lb: str,
                eps: float = 2.220446049250313e-16) -> DataFrame:
    """Distance of both forecast errors from their floors, and how they move together."""
    m0, mb, a, b = (F.col(n) for n in (mse0, mseb, l0, lb))
    dl, dm = a - b, m0 - mb
    return df.withColumns(
        {
            "gap_base": m0 - a,
            "gap_side": mb - b,
            "efficiency_base": a / m0,
            "efficiency_side": b / mb,
            "delta_mse": dm,
            "delta_l": dl,
            "gap_narrowing": (m0 - a) - (mb - b),
            "realization_ratio": F.when(F.abs(dl) > eps, dm / dl),
        }
    )


def by_estimator(df: DataFrame, keys: list[str], columns: dict[str, dict[str, str]]) -> DataFrame:
    """One row per estimator from one column per estimator."""
    rows = [
        F.struct(F.lit(est).alias("estimator"), *[F.col(src).alias(dst) for dst, src in cols.items()])
        for est, cols in columns.items()
    ]
    return df.select(*keys, F.explode(F.array(*rows)).alias("__e")).select(*keys, "__e.*")
