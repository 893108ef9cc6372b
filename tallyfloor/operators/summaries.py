"""Tables computed from panels, estimates and replicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyfloor.functions.draws import draw_below
from tallyfloor.operators import information as info, ordering
from tallyfloor.operators.settle import settle, spread


def against_reference(df: DataFrame, keys: Sequence[str], level: str, at: float, metric: str, out: str, eps: float = 1e-12) -> DataFrame:
    """Relative distance of each row from the row of the same key at the reference level."""
    ref = df.where(F.col(level) == at).select(*keys, F.col(metric).alias("__ref"))
    dist = F.abs(F.col(metric) - F.col("__ref")) / F.greatest(F.abs("__ref"), F.lit(eps))
    return df.join(ref, list(keys)).withColumn(out, dist).drop("__ref")


def category_differences(df: DataFrame, category: str, rep: str, metric: str) -> DataFrame:
    """Differences between categories within a replicate. Categories are a short fixed list."""
    a = df.select(F.col(category).alias("category_a"), rep, F.col(metric).alias("__a"))
    b = df.select(F.col(category).alias("category_b"), rep, F.col(metric).alias("__b"))
    return a.join(b, rep).where("category_a < category_b").select(
        "category_a", "category_b", rep, (F.col("__a") - F.col("__b")).alias("difference")
    )


def spearman_bootstrap(df: DataFrame, unit: str, x: str, y: str, reps: int, label: str) -> DataFrame:
    """Rank correlation per replicate over units drawn with replacement. Draws become weights,
    and weighted ranks are taken over ranges of values. Units times replicates are dealt to tasks of bounded size."""
    df = settle(df)
    drawings = df.count() * reps
    order = ordering.cumulative_counts(df, unit).select(unit, F.col("n_below").alias("__k"), "total")
    units = df.join(order, unit)
    total = df.agg(F.count("*")).scalar()
    each = spread(units.select(F.col("__k").alias("__j"), "total"), drawings, "__j").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    hits = each.select("rep", draw_below(F.col("total"), label, F.col("rep"), F.col("__j")).alias("__k"))
    drawn = spread(hits, drawings, "__k").groupBy("rep", "__k").agg(F.count("*").alias("w"))
    s = settle(drawn.join(units.select("__k", x, y), "__k"))
    rank = lambda col, out: ordering.cumulative_counts(s, col, ["rep"], "w").select(
        "rep", col, (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(out))
    j = s.join(rank(x, "rx"), ["rep", x]).join(rank(y, "ry"), ["rep", y])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    m = j.groupBy("rep").agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"),
    )
    c = F.col
    den = F.sqrt((c("n") * c("sxx") - c("sx") ** 2) * (c("n") * c("syy") - c("sy") ** 2))
    return m.select("rep", F.when(den > 0, (c("n") * c("sxy") - c("sx") * c("sy")) / den).alias("rho"))


def spearman_interval(df: DataFrame, unit: str, x: str, y: str, reps: int, label: str, level: float = 0.95) -> DataFrame:
    """One row: units, rho, its two-sided p by the t law, percentile limits and standard error over units drawn with replacement, and how many
    replicates are finite. Rows without both values are left out; fewer than three of them, or fewer finite replicates than nine tenths
    (100 at least), is an error."""
    from tallyfloor.functions.special import t_tail_two_sided

    both = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(unit, x, y))
    point = ordering.spearman(both, x, y).select(F.col("n").alias("units"), F.when(F.abs("rho") <= 1, F.col("rho")).otherwise(F.signum("rho")).alias("rho"))
    a, least = 1 - level, max(100, int(0.9 * reps))
    drawn = spearman_bootstrap(both, unit, x, y, reps, label).where("rho IS NOT NULL").agg(
        F.count("*").alias("finite_replicates"), F.stddev_samp("rho").alias("se"),
        F.expr(f"percentile(rho, {a / 2!r}D)").alias("ci_low"), F.expr(f"percentile(rho, {1 - a / 2!r}D)").alias("ci_high"))
    out = point.crossJoin(drawn)  # one row each
    few = (F.col("units") < 3) | (F.col("finite_replicates") < least)
    checked = F.when(few, F.raise_error(F.lit("too few units or finite replicates")).cast("double")).otherwise(F.col("rho"))
    out = out.withColumn("rho", checked).withColumn("__df", (F.col("units") - 2).cast("int"))
    out = out.withColumn("__t", F.col("rho") * F.sqrt(F.col("__df") / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300))))
    return out.withColumn("p", t_tail_two_sided("__t", "__df")).drop("__t", "__df")


def constant_keyed(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Repeat a small frame once per value of a fixed list."""
    return df.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))


# --- panel descriptives -------------------------------------------------------------------


def describe_counts(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Sum, mean, spread, tail quantiles and zero share of a count column, from its tally."""
    t = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    out = t.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum(v * n).alias("total"), F.sum(v * v * n).alias("__ss"),
        *[F.expr(f"percentile(v, {p}D, n)").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)],
        F.sum(F.when(v == 0, n).otherwise(0)).alias("__zero"), F.max("v").alias("maximum"),
    )
    mean = F.col("total") / F.col("rows")
    return out.withColumns({
        "mean": mean,
        "sd": F.sqrt(F.greatest(F.lit(0.0), (F.col("__ss") - F.col("rows") * mean * mean) / (F.col("rows") - 1))),
        "zero_share": F.col("__zero") / F.col("rows"),
    }).drop("__ss", "__zero")


def weekday_index(df: DataFrame, value: str, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean by weekday, as 100 x its ratio to the mean of the weekday means."""
    m = df.groupBy(*keys, day).agg(F.avg(value).alias("mean"))
    base = F.avg("mean").over(W.partitionBy(*keys)) if keys else m.agg(F.avg("mean")).scalar()
    return m.withColumn("index", 100 * F.col("mean") / base)


def peaks(df: DataFrame, value: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Labels of the largest and smallest totals; the smaller label wins a tie."""
    t = df.groupBy(*keys, label).agg(F.sum(value).alias("v"))
    return t.groupBy(*keys).agg(
        F.min_by(label, F.struct(-F.col("v"), F.col(label))).alias("peak"), F.min_by(label, F.struct("v", label)).alias("trough"))


def weekend_ratio(df: DataFrame, value: str, weekend: Column, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(F.when(weekend, F.col(value))) / F.avg(F.when(~weekend, F.col(value)))).alias("weekend_ratio"))


# --- forecasts against counts -------------------------------------------------------------


def forecast_metrics(df: DataFrame, y: str, continuous: str, integer: str, keys: Sequence[str]) -> DataFrame:
    e, c = F.col(y) - F.col(integer), F.col(y) - F.col(continuous)
    mu = F.greatest(F.col(continuous), F.lit(1e-12))
    dev = 2 * (F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / mu)).otherwise(0.0) - (F.col(y) - mu))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse_integer"), F.sqrt(F.avg(e * e)).alias("rmse_integer"),
        F.avg(F.abs(e)).alias("mae_integer"), F.avg(c * c).alias("mse_continuous"), F.avg(dev).alias("poisson_deviance"),
        F.avg((e == 0).cast("double")).alias("exact_share"), (F.sum(continuous) / F.sum(y)).alias("total_ratio"),
    )


def forecast_gain(df: DataFrame, base: str, side: str, keys: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(base).alias("mse_base"), F.avg(side).alias("mse_side"))
    gain = F.col("mse_base") - F.col("mse_side")
    return out.withColumns({"gain": gain, "relative_gain": F.when(F.col("mse_base") > 0, gain / F.col("mse_base"))})


def composition(df: DataFrame, category: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Events of each category with share of the key's total, mean and zero share."""
    t = df.groupBy(*keys, category).agg(F.sum(value).alias("events"), F.avg(value).alias("mean"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"))
    total = t.groupBy(*keys).agg(F.sum("events").alias("__t")) if keys else None
    j = t.join(total, list(keys)) if keys else t.withColumn("__t", t.agg(F.sum("events")).scalar())
    return j.withColumn("share", F.col("events") / F.col("__t")).drop("__t")


def modal_error(train: DataFrame, test: DataFrame, states: Sequence[str], label: str, weight: str | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Error of predicting each state's most frequent label (smallest on ties), on the training rows themselves and on the test rows; a state
    unseen in training takes the overall mode. Both sides enter as tallies."""
    w = F.count("*") if weight is None else F.sum(weight)
    keys, cells = list(keys), [*keys, *states]
    a = train.groupBy(*cells, label).agg(w.alias("n")).where("n > 0")
    best = lambda: F.min_by(label, F.struct(-F.col("n"), F.col(label)))
    mode = a.groupBy(*cells).agg(best().alias("__mode"))
    overall = a.groupBy(*keys, label).agg(F.sum("n").alias("n")).groupBy(*keys).agg(best().alias("__all"))
    b = test.groupBy(*cells, label).agg(w.alias("n")).where("n > 0").join(mode, cells, "left")
    b = b.join(overall, keys) if keys else b.withColumn("__all", overall.scalar())
    guess = F.coalesce("__mode", "__all")
    fitted = a.groupBy(*cells).agg(F.max("n").alias("hit"), F.sum("n").alias("n")).groupBy(*keys).agg((1 - F.sum("hit") / F.sum("n")).alias("train_error"))
    out = b.groupBy(*keys).agg(
        F.sum("n").alias("test_rows"), (F.sum(F.when(guess != F.col(label), F.col("n")).otherwise(0)) / F.sum("n")).alias("test_error"),
        F.sum(F.when(F.col("__mode").isNull(), F.col("n")).otherwise(0)).alias("unseen"),
    ).withColumn("unseen_share", F.col("unseen") / F.col("test_rows"))
    return out.join(fitted, keys) if keys else out.withColumn("train_error", fitted.scalar())


def error_slack(df: DataFrame, error: str, forecast: str, keys: Sequence[str] = ()) -> DataFrame:
    """Where the squared error of an integer forecast lies above its floor: entropy of the error
    given the forecast, information between both, and distance of the error law from the
    lattice law with the same mean square."""
    from tallyfloor.functions.bounds import max_entropy

    t = df.groupBy(*keys, F.col(error).alias("e"), F.col(forecast).alias("f")).agg(F.count("*").alias("n"))
    nln = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    joint = t.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(nln("n")).alias("ef"), F.sum(F.col("n") * F.col("e") * F.col("e")).alias("ss"))
    e = t.groupBy(*keys, "e").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(nln("n")).alias("ee"))
    f = t.groupBy(*keys, "f").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(nln("n")).alias("ff"))
    if keys:
        j = joint.join(e, list(keys)).join(f, list(keys))
    else:
        j = joint.withColumns({"ee": e.scalar(), "ff": f.scalar()})
    n, ln2 = F.col("n"), info.LN2
    bits = lambda c: (n * F.log(n.cast("double")) - F.col(c)) / (n * ln2)
    j = j.withColumns({"mean_square": F.col("ss") / n, "h_error": bits("ee"), "h_joint": bits("ef"), "h_forecast": bits("ff")})
    j = j.withColumns({
        "information": F.col("h_error") + F.col("h_forecast") - F.col("h_joint"),
        "h_max": max_entropy("mean_square"),
    })
    j = j.withColumn("law_distance", F.col("h_max") - F.col("h_error"))
    return j.select(*keys, "n", "mean_square", "h_error", "h_joint", "h_forecast", "information", "h_max", "law_distance")


def sign_count(df: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("specs"), F.count_if(F.col(metric) > 0).alias("positive"), F.min(metric).alias("lowest"), F.max(metric).alias("highest"))


def wide_ratio(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    """One column per value and the ratio of each to the first."""
    p = df.groupBy(*keys).pivot(column, list(values)).agg(F.first(metric))
    return p.withColumns({f"{v}_over_{values[0]}": F.when(F.col(values[0]) != 0, F.col(v) / F.col(values[0])) for v in values[1:]})


def equal_rank_strata(df: DataFrame, value: str, tie: str, k: int, out: str) -> DataFrame:
    """k strata with interpolated edges on the rank, the lower edge closed only for the first."""
    ranked = ordering.row_ranks(df, value, tie, "__r", total="__t")
    edges = [1 + (F.col("__t") - 1) * i / k for i in range(1, k)]
    code = sum(((F.col("__r") > e).cast("int") for e in edges), F.lit(0))
    return ranked.withColumn(out, code).drop("__r", "__t")


def spread_units(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """k units at evenly spaced ranks."""
    ranked = ordering.row_ranks(df, value, tie, "rank", total="__t")
    spots = F.array(*[F.floor((F.col("__t") - 1) * i / max(1, k - 1) + 0.5) + 1 for i in range(k)])
    return ranked.where(F.array_contains(spots, F.col("rank"))).drop("__t")


def replay(df: DataFrame, order: str, length: int, keys: Sequence[str] = ()) -> DataFrame:
    """Periods repeated to a longer series: row i takes source row i mod n in cycle i div n.
    Each source row makes its own copies, so nothing is joined."""
    w = W.partitionBy(*keys).orderBy(order)
    n = F.count("*").over(W.partitionBy(*keys))
    r = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    last = F.floor((F.lit(length - 1) - F.col("__i")) / F.col("__n")).cast("int")
    r = r.where(F.col("__i") < length).withColumn("cycle", F.explode(F.sequence(F.lit(0), last)))
    return r.withColumn("replay_row", F.col("cycle") * F.col("__n") + F.col("__i")).drop("__i", "__n")


def subtract_selected(panel: DataFrame, selected: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Take selected endpoints out of a panel measure; a negative result is an error."""
    s = selected.groupBy(*on).agg(F.count("*").alias("__s"))
    left = F.col(column) - F.coalesce("__s", F.lit(0))
    ok = F.when(left < 0, F.raise_error(F.lit("more selected than counted"))).otherwise(left)
    return panel.join(s, list(on), "left").withColumn(f"{column}_adjusted", ok).drop("__s")


def coverage_mixture(parts: DataFrame, key: str, inside: str, n: str, cmi: str) -> DataFrame:
    """Share-weighted information of the two parts of a domain."""
    total = parts.agg(F.sum(n)).scalar()
    return parts.agg(
        F.max(F.when(F.col(key) == inside, F.col(n) / total)).alias("inside_share"),
        F.sum(F.col(n) / total * F.col(cmi)).alias("mixture_cmi"),
    )


def expanding_information(df: DataFrame, period: str, fractions: Sequence[float], base: Sequence[str], lag: str, side_lag: str, target: str) -> DataFrame:
    """Information on the first share of the calendar, with cut points fitted again inside each.

    Rows are tallied by period rank once; a fraction only filters that tally, so the panel is
    read a single time. The calendar is one row per period.
    """
    days = df.select(period).distinct().withColumn("__k", F.row_number().over(W.orderBy(period)))
    total = days.agg(F.count("*")).scalar()
    size = lambda f: total if f == 1 else F.greatest(F.lit(1), F.bround(total * f, 0))
    marks = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), size(f).cast("long").alias("k")) for f in fractions])
    tally = df.join(days, period).groupBy("__k", *base, side_lag, target).agg(F.count("*").alias("n"))
    t = tally.withColumn("__m", F.explode(marks)).where(F.col("__k") <= F.col("__m.k")).withColumn("fraction", F.col("__m.fraction"))
    pos = t.where(F.col(side_lag) > 0).groupBy("fraction", F.col(side_lag).alias("v")).agg(F.sum("n").alias("n"))
    cuts = pos.groupBy("fraction").agg(F.expr("percentile(v, array(1D/3, 2D/3), n)").alias("cuts"))
    from tallyfloor.functions.states import cut_code

    coded = t.join(F.broadcast(cuts), "fraction").withColumn("b", cut_code(F.col(side_lag), F.col("cuts")))  # one row per fraction
    counts = coded.groupBy("fraction", *base, "b", target).agg(F.sum("n").alias("n"))
    return info.conditional_information(counts, base, "b", target, ["fraction"])
