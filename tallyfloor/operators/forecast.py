"""Forecasts from categorical states and their comparison.

All features are categories, so training data are first compressed to cells: one row per
combination with its row count ``cell_n`` and target total ``cell_sum``. The likelihoods depend on nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyfloor.functions.states import half_up
from tallyfloor.operators.settle import settle


def cells(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, *features).agg(F.count("*").alias("cell_n"), F.sum(y).cast("double").alias("cell_sum"))


def state_mean(train: DataFrame, rows: DataFrame, unit: str, states: Sequence[str], smoothing, out: str = "prediction",
               keys: Sequence[str] = ()) -> DataFrame:
    """Smoothed mean of a state; an unseen state takes its unit's mean, an unseen unit the
    overall mean. ``train`` is a cell table; ``smoothing`` a number or a column of ``rows``. Cells and units may be many
    and pack into small files, so their tables are never broadcast."""
    keys, full = list(keys), [*keys, unit, *states]
    k = smoothing if isinstance(smoothing, Column) else F.lit(float(smoothing))
    cell = train.groupBy(*full).agg(F.sum("cell_n").alias("__n"), F.sum("cell_sum").alias("__s"))
    units = cell.groupBy(*keys, unit).agg((F.sum("__s") / F.sum("__n")).alias("__unit"))
    total = cell.groupBy(*keys).agg((F.sum("__s") / F.sum("__n")).alias("__all"))
    j = rows.join(cell.hint("merge"), full, "left").join(units.hint("merge"), [*keys, unit], "left")
    j = j.join(total, keys, "left") if keys else j.withColumn("__all", total.scalar())
    prior = F.coalesce("__unit", "__all")
    mean = (F.col("__s") + k * prior) / (F.col("__n") + k)
    return j.withColumn(out, F.greatest(F.coalesce(mean, prior), F.lit(0.0))).drop("__n", "__s", "__unit", "__all")


def score(df: DataFrame, y: str, prediction: str, suffix: str = "") -> DataFrame:
    """Integer forecast and the errors of both."""
    p, k = F.col(prediction), f"integer{suffix}"
    return df.withColumn(k, half_up(p)).withColumns({
        f"squared_error_integer{suffix}": (F.col(y) - F.col(k)) ** 2,
        f"absolute_error_integer{suffix}": F.abs(F.col(y) - F.col(k)).cast("double"),
        f"squared_error_continuous{suffix}": (F.col(y) - p) ** 2,
    })


def tune_state_mean(train: DataFrame, validation: DataFrame, unit: str, states: Sequence[str], y: str,
                    candidates: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Every candidate's validation errors with the winner marked: integer error, then
    continuous error, then the earlier candidate. Validation rows are compressed to cells by
    target value, so the candidates multiply cells and not rows."""
    v = validation.groupBy(*keys, unit, *states, y).agg(F.count("*").alias("m"))
    options = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(float(c)).alias("smoothing")) for i, c in enumerate(candidates)])
    v = v.withColumn("__o", F.explode(options)).select("*", "__o.*").drop("__o")
    p = score(state_mean(cells(train, [unit, *states], y, keys), v, unit, states, F.col("smoothing"), "p", keys), y, "p")
    m = F.col("m")
    errors = p.groupBy(*keys, "candidate", "smoothing").agg(
        (F.sum(m * F.col("squared_error_integer")) / F.sum(m)).alias("mse_integer"),
        (F.sum(m * F.col("squared_error_continuous")) / F.sum(m)).alias("mse_continuous"),
    )
    order = F.struct(F.round("mse_integer", 12), F.round("mse_continuous", 12), "candidate")
    best = errors.groupBy(*keys).agg(F.min_by("candidate", order).alias("__best"))
    j = errors.join(best, list(keys)) if keys else errors.withColumn("__best", best.scalar())
    return j.withColumn("selected", F.col("candidate") == F.col("__best")).drop("__best")


def seasonal_lag(df: DataFrame, unit: Sequence[str], period: str, y: str, lag: int = 7, out: str = "prediction") -> DataFrame:
    """The value ``lag`` periods ago."""
    return df.withColumn(out, F.lag(y, lag).over(W.partitionBy(*unit).orderBy(period)).cast("double"))


SMALL_LEVELS = 100_000  # levels of a feature, times settings, whose coefficients may be broadcast
CLIP = 20.0  # bound of the linear predictor of NB2 models


def _sized(table: DataFrame, rows: int) -> DataFrame:
    """A coefficient table for a join: broadcast if it is small, else never. Without a hint the planner would go by
    file sizes, and long tables of like numbers pack well enough to be put together in the driver at every step."""
    return F.broadcast(table) if rows <= SMALL_LEVELS else table.hint("merge")


class LogLinear:
    """A fitted model: the intercept and one table of coefficients per feature."""

    def __init__(self, features: Sequence[str], intercept: float, tables: dict[str, DataFrame], sizes: dict[str, int], clip: float | None = None):
        self.features, self.intercept, self.tables, self.sizes, self.clip = list(features), intercept, tables, sizes, clip
        self.sweeps = 0

    def attach(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with ``b_<feature>`` and ``eta``. A table is broadcast only if its counted size
        allows; a level unseen in training adds nothing."""
        for f in self.features:
            t = self.tables[f]
            rows = rows.join(_sized(t, self.sizes[f]), f, how)
        eta = sum((F.coalesce(F.col(f"b_{f}"), F.lit(0.0)) for f in self.features), F.lit(self.intercept))
        return rows.withColumn("eta", eta if self.clip is None else F.greatest(F.least(eta, F.lit(self.clip)), F.lit(-self.clip)))

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        done = self.attach(rows, "left").withColumn(out, F.exp("eta"))
        return done.drop("eta", *[f"b_{f}" for f in self.features])


@dataclass(frozen=True)
class Ridge:
    """Setting of a log-linear model: the ridge, and the dispersion of NB2 (None: Poisson)."""

    l2: float
    dispersion: float | None = None


def fit_log_linear(cell: DataFrame, features: Sequence[str], l2: float, dispersion: float | None = None, tolerance: float = 1e-8, most_sweeps: int = 500) -> LogLinear:
    """One model of :func:`fit_log_linear_grid`."""
    return fit_log_linear_grid(cell, features, [Ridge(l2, dispersion)], tolerance, most_sweeps)[0]


def fit_log_linear_grid(cell: DataFrame, features: Sequence[str], settings: Sequence[Ridge], tolerance: float = 1e-8, most_sweeps: int = 500) -> list[LogLinear]:
    """Log-link count models on one-hot features with a ridge on everything but the intercept, one for each setting, fitted side by side.

    The levels of one feature split the cells, so the scoring step of a whole feature is one
    group-by over the cells, whatever the number of levels; no design matrix is built. The setting is a key of that group-by, so a
    grid takes as many steps as its slowest model. Each new table of coefficients is written, so the plan of a step never grows. Sweeps over the features go on until
    no gradient of the mean loss exceeds ``tolerance``; a model that has come so far drops out, one that has not after ``most_sweeps`` fails.
    """
    cell = settle(cell)
    total = cell.agg(F.sum("cell_n").alias("cell_n"), F.sum("cell_sum").alias("cell_sum")).first()
    size = float(total["cell_n"])
    start = math.log(max(float(total["cell_sum"]) / size, 1e-6))
    intercepts, active, done = [start] * len(settings), list(range(len(settings))), {}
    every = F.explode(F.array(*[F.lit(k) for k in active])).alias("setting")
    tables = {f: settle(cell.select(f).distinct().select(f, every, F.lit(0.0).alias(f"b_{f}"))) for f in features}
    sizes = {f: t.count() for f, t in tables.items()}

    def by_setting(values, kind: str = "double") -> Column:
        """A value for each setting that is still active."""
        held = F.create_map(*[v for k in active for v in (F.lit(k), F.lit(values(k)).cast(kind))])
        return F.element_at(held, F.col("setting"))

    n, s, mu = F.col("cell_n"), F.col("cell_sum"), F.exp("eta")
    r, l2 = F.col("__r"), F.col("__l2")
    g = F.when(r.isNull(), s - n * mu).otherwise(r * (s - n * mu) / (r + mu))
    h = F.when(r.isNull(), n * mu).otherwise(n * r * mu / (r + mu))
    G, H = F.col("__g"), F.col("__h")
    for sweep in range(1, most_sweeps + 1):
        worst = dict.fromkeys(active, 0.0)
        for f in features:
            # One Newton step for the levels of f together with the intercept: the levels are
            # independent given the intercept's move, so it is eliminated by two sums over levels.
            rows = cell.withColumn("setting", F.explode(F.array(*[F.lit(k) for k in active])))
            for other in features:
                t = tables[other]
                rows = rows.join(_sized(t, sizes[other]), [other, "setting"])
            eta = sum((F.col(f"b_{o}") for o in features), by_setting(lambda k: intercepts[k]))
            clipped = F.when(r.isNull(), eta).otherwise(F.greatest(F.least(eta, F.lit(CLIP)), F.lit(-CLIP)))
            rows = rows.withColumns({
                "__l2": by_setting(lambda k: settings[k].l2),
                "__r": by_setting(lambda k: None if settings[k].dispersion is None else 1.0 / settings[k].dispersion),
            }).withColumn("eta", clipped)
            b = F.first(f"b_{f}")
            level = settle(rows.groupBy("setting", f).agg(
                b.alias("__b"), F.first("__l2").alias("__l2"), (F.sum(g) / size - F.first("__l2") * b).alias("__g"),
                (F.sum(h) / size).alias("__h"), (F.sum(g) / size).alias("__raw")))
            sums = level.groupBy("setting").agg(
                F.sum(F.col("__raw")) - F.sum(H * G / (H + l2)), F.sum(H * l2 / (H + l2)), F.max(F.abs(G)), F.abs(F.sum("__raw"))).collect()
            moves = {}
            for k, top, bottom, steep, tilt in sums:
                worst[k] = max(worst[k], steep, tilt)
                moves[k] = max(-2.0, min(2.0, top / bottom))
                intercepts[k] += moves[k]
            step = (G - H * by_setting(lambda k: moves[k])) / (H + l2)
            tables[f] = level.select(f, "setting", (F.col("__b") + F.greatest(F.least(step, F.lit(2.0)), F.lit(-2.0))).alias(f"b_{f}"))
        for k in [k for k in active if worst[k] <= tolerance]:
            own = {f: tables[f].where(F.col("setting") == k).drop("setting") for f in features}
            done[k] = LogLinear(features, intercepts[k], own, sizes, None if settings[k].dispersion is None else CLIP)
            done[k].sweeps = sweep
        active = [k for k in active if k not in done]
        if not active:
            return [done[k] for k in range(len(settings))]
    raise RuntimeError(f"not converged after {most_sweeps} sweeps: the largest gradients are {worst}")


# --- families side by side ----------------------------------------------------------------


def tune(fitted: Mapping[str, Sequence[Callable[[DataFrame], DataFrame]]], validation: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Validation errors of every candidate of every family (K6): family, candidate, n, mse_integer, mse_continuous, mae_integer and whether it is the one to
    take: least integer error, then least continuous error, then the earlier candidate.

    ``fitted`` holds for each family the candidates' predictors, functions that add ``prediction`` to rows. Validation rows are
    compressed to cells by target value first, so candidates multiply cells and not rows."""
    v = settle(validation.groupBy(*features, y).agg(F.count("*").alias("m")))
    m, parts = F.col("m"), []
    for name, predictors in fitted.items():
        for k, predict in enumerate(predictors):
            p = score(predict(v), y, "prediction")
            parts.append(p.agg(
                F.lit(name).alias("family"), F.lit(k).alias("candidate"), F.sum(m).alias("n"),
                (F.sum(m * F.col("squared_error_integer")) / F.sum(m)).alias("mse_integer"),
                (F.sum(m * F.col("squared_error_continuous")) / F.sum(m)).alias("mse_continuous"),
                (F.sum(m * F.col("absolute_error_integer")) / F.sum(m)).alias("mae_integer"),
            ))
    errors = settle(reduce(DataFrame.unionByName, parts))
    order = F.struct(F.round("mse_integer", 12), F.round("mse_continuous", 12), "candidate")
    best = errors.groupBy("family").agg(F.min_by("candidate", order).alias("__best"))
    return errors.join(best, "family").withColumn("selected", F.col("candidate") == F.col("__best")).drop("__best")


def rolling_state_mean(df: DataFrame, unit: str, states: Sequence[str], period: str, y: str, smoothing: float) -> DataFrame:
    """Forecast errors by month, each month forecast from all months before it.

    Cells are tallied by month; what a month may use is the running sum of earlier months, so
    one pass serves every origin.
    """
    t = df.withColumn("month", F.date_format(period, "yyyy-MM")).groupBy(unit, *states, "month").agg(
        F.count("*").alias("n"), F.sum(y).cast("double").alias("s"), F.sum(F.col(y) * F.col(y)).cast("double").alias("ss"))

    def prior(frame: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        m = frame.groupBy(*keys, "month").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
        return m.select(*keys, "month", F.sum("n").over(w).alias(f"__n{tag}"), F.sum("s").over(w).alias(f"__s{tag}"))

    j = t.join(prior(t, [unit, *states], "c"), [unit, *states, "month"])
    j = j.join(prior(t, [unit], "u"), [unit, "month"]).join(F.broadcast(prior(t, [], "a")), "month")  # one row per month
    base = F.coalesce(F.col("__su") / F.col("__nu"), F.col("__sa") / F.col("__na"))
    p = F.coalesce((F.col("__sc") + smoothing * base) / (F.col("__nc") + smoothing), base)
    j = j.withColumn("p", p).where(F.col("p").isNotNull()).withColumn("k", half_up(F.col("p")))
    sse = lambda q: F.sum(F.col("ss") - 2 * F.col(q) * F.col("s") + F.col("n") * F.col(q) * F.col(q))
    return j.groupBy("month").agg(F.sum("n").alias("n"), (sse("p") / F.sum("n")).alias("mse_continuous"), (sse("k") / F.sum("n")).alias("mse_integer"))
