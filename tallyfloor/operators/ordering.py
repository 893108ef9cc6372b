"""Exact ranks and quantiles without ordering a large group in one task.

Values are tallied first, so ties collapse, and the tally is written once. Where every group
has few distinct values a window per group does. Beyond that the distinct values of a group
are cut into ranges at a sample of themselves; ranks run inside a range, and the totals of
the ranges before it are added. The sample is chosen by hash, so retries cut at the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyfloor.operators.settle import settle

SMALL = 200_000  # distinct values of a group that one task may order
_CUTS = 256  # about this many ranges per larger group


def _tally(df: DataFrame, value: str, keys: Sequence[str], weight: str | None, unique: bool = False) -> tuple[DataFrame, int]:
    """Counts per value, written once, and the number of distinct values of the largest group.
    Values known to be distinct already are written as they are."""
    n = F.count("*") if weight is None else F.sum(weight)
    group = list(keys) or ["__all"]
    src = df if keys else df.withColumn("__all", F.lit(0))
    src = src.where(F.col(value).isNotNull())
    if unique:
        tally = settle(src.select(*group, value, F.lit(1).cast("long").alias("n")))
    else:
        tally = settle(src.groupBy(*group, value).agg(n.alias("n")))
    return tally, tally.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None,
                      small: int | None = None, unique: bool = False) -> DataFrame:
    """(keys, value) -> n, n_below, total: how many rows hold the value, lie below it, exist."""
    group = list(keys) or ["__all"]
    tally, largest = _tally(df, value, keys, weight, unique)
    if largest <= (SMALL if small is None else small):
        w = W.partitionBy(*group)
        before = F.sum("n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        ranked = tally.withColumns({"n_below": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(w)})
        return ranked.select(*keys, value, "n", "n_below", "total")
    # Without keys the per-group tables below hold one row, so they are broadcast.
    one = (lambda t: t) if keys else F.broadcast
    sizes = tally.groupBy(*group).agg(F.count("*").alias("__k"), F.sum("n").alias("total"))
    step = F.greatest(F.lit(1), F.floor(F.col("__k") / _CUTS)).cast("long")
    chosen = F.pmod(F.xxhash64(F.col(value).cast("string")), step) == 0
    bounds = tally.join(one(sizes), group).groupBy(*group).agg(
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(chosen & (F.col("__k") > _CUTS), F.col(value)))).alias("__bounds"),
    )
    placed = tally.join(one(bounds), group).withColumn(
        "__range", F.size(F.filter("__bounds", lambda b: b <= F.col(value)))
    ).drop("__bounds")
    ranges = placed.groupBy(*group, "__range").agg(F.sum("n").alias("__rn"))
    w_before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__rn").over(w_before), F.lit(0))).drop("__rn")
    w_in = W.partitionBy(*group, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.join(ranges, [*group, "__range"]).withColumn(
        "n_below", F.col("__before") + F.coalesce(F.sum("n").over(w_in), F.lit(0))
    )
    return ranked.select(*keys, value, "n", "n_below", "total")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), small: int | None = None,
              rows: str | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles, one column per name, and the row count as ``rows``.
    The built-in aggregate takes the tally where every group has few distinct values; larger
    groups are ranked over ranges and the two neighbours of each position picked out."""
    src = df.select(*keys, F.col(value).alias("__val"))
    limit = SMALL if small is None else small
    tally, largest = _tally(src, "__val", keys, None)
    extra = [] if rows is None else [rows]
    if largest <= limit:
        agg = [F.expr(f"percentile(__val, {float(p)!r}D, n)").alias(name) for name, p in probs.items()]
        return tally.groupBy(*(keys or ["__all"])).agg(*agg, F.sum("n").alias(rows or "__rows")).select(*keys, *probs, *extra)
    c = cumulative_counts(src, "__val", keys, small=limit)
    lo_hi = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n"))
            lo_hi.append(F.max(F.when(hit, F.col("__val"))).alias(f"__{name}_{tag}"))
        lo_hi.append(F.max(pos - F.floor(pos)).alias(f"__{name}_f"))
    agg = c.groupBy(*keys).agg(*lo_hi, F.max("total").alias(rows or "__rows"))
    return agg.select(
        *keys,
        *[
            (F.col(f"__{n}_lo") + F.col(f"__{n}_f") * (F.col(f"__{n}_hi") - F.col(f"__{n}_lo"))).alias(n)
            for n in probs
        ],
        *extra,
    )


def average_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with the mean rank of their tie group (1-based)."""
    c = cumulative_counts(df.select(*keys, F.col(value).alias("__val")), "__val", keys).select(
        *keys, F.col("__val").alias(value), (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(out)
    )
    return df.join(c, [*keys, value])


def row_ranks(df: DataFrame, value: str, tie: str, out: str, keys: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Rows with a distinct 1-based rank by (value, tie); ``tie`` must tell the rows of a key
    apart. The whole row is ranked as one value, so a large group of ties is spread over
    ranges like any other values and nothing is joined back."""
    rest = [c for c in df.columns if c not in {*keys, value, tie}]
    row = df.select(*keys, F.struct(value, tie, *rest).alias("__row"))
    c = cumulative_counts(row, "__row", keys, unique=True)
    extra = [] if total is None else [F.col("total").alias(total)]
    return c.select(*keys, "__row.*", (F.col("n_below") + 1).alias(out), *extra)


def bh_adjust(df: DataFrame, p: str, out: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p-values inside each family; null stays null.

    Equal p-values share one adjusted value, so the running minimum goes over distinct values:
    first inside ranges of p, then over the minima of the ranges above.
    """
    family = list(family)
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    keyed = settle(df.withColumn("__p", F.when(F.col(p).isNotNull() & ~F.isnan(p), clipped)))
    c = cumulative_counts(keyed, "__p", family)
    c = c.withColumn("__q", F.col("__p") * F.col("total") / (F.col("n_below") + F.col("n")))
    c = c.withColumn("__slot", F.floor(F.col("__p") * 1024))
    w_in = W.partitionBy(*family, "__slot").orderBy("__p").rowsBetween(0, W.unboundedFollowing)
    w_over = W.partitionBy(*(family or [F.lit(0)])).orderBy("__slot").rowsBetween(1, W.unboundedFollowing)
    slots = c.groupBy(*family, "__slot").agg(F.min("__q").alias("__m")).withColumn(
        "__later", F.min("__m").over(w_over)
    )
    c = c.join(slots.drop("__m"), [*family, "__slot"]).withColumn(
        "__adj", F.least(F.min("__q").over(w_in), F.coalesce("__later", F.lit(1.0)), F.lit(1.0))
    )
    renamed = c.select(*[F.col(k).alias(f"__f_{k}") for k in family], F.col("__p").alias("__pp"), F.col("__adj").alias(out))
    cond = F.col("__p") == F.col("__pp")
    for k in family:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__f_{k}"))
    return keyed.join(renamed, cond, "left").drop("__p", "__pp", *[f"__f_{k}" for k in family])


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with mean ranks for ties; null where one side does not vary."""
    both = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y))
    ranked = average_ranks(average_ranks(both, x, "__rx", keys), y, "__ry", keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), (F.covar_pop("__rx", "__ry") / F.nullif(F.stddev_pop("__rx") * F.stddev_pop("__ry"), F.lit(0.0))).alias("rho"))


def median_classes(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Four classes by two medians; a value equal to its median counts as low."""
    keys, df = list(keys), settle(df)
    if keys:
        meds = quantiles(df, a, {"__ma": 0.5}, keys).join(quantiles(df, b, {"__mb": 0.5}, keys), keys)
        out = df.join(meds, keys)
    else:
        out = df.withColumns(
            {"__ma": quantiles(df, a, {"m": 0.5}).scalar(), "__mb": quantiles(df, b, {"m": 0.5}).scalar()}
        )
    ha, hb = F.col(a) > F.col("__ma"), F.col(b) > F.col("__mb")
    label = lambda hi, what: F.when(hi, F.lit(f"high_{what}")).otherwise(F.lit(f"low_{what}"))
    return out.withColumn(
        "median_class", F.concat_ws("__", label(ha, "theory"), label(hb, "empirical"))
    ).drop("__ma", "__mb")


def longest_run(df: DataFrame, unit: Sequence[str], order: str, condition: Column, out: str) -> DataFrame:
    """Longest stretch of consecutive rows of a unit for which the condition holds."""
    w = W.partitionBy(*unit).orderBy(order)
    w_hit = W.partitionBy(*unit, "__hit").orderBy(order)
    marked = df.select(*unit, order, condition.alias("__hit")).withColumn("__i", F.row_number().over(w))
    island = marked.withColumn("__island", F.col("__i") - F.row_number().over(w_hit))
    runs = island.groupBy(*unit, "__hit", "__island").agg(F.count("*").alias("__len"))
    return runs.groupBy(*unit).agg(
        F.coalesce(F.max(F.when(F.col("__hit"), F.col("__len"))), F.lit(0)).alias(out)
    )


def best_candidate(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that sorts first in each key, by aggregation and not by sorting."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def top_share(df: DataFrame, value: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """Part of the total held by the top ``ceil(share * n)`` rows. Rows tied at the edge are
    equal, so the sum needs counts of values only and no order among them."""
    c = cumulative_counts(df.select(*keys, F.col(value).alias("__val")), "__val", keys)
    above = F.col("total") - F.col("n_below") - F.col("n")
    room = F.greatest(F.lit(0), F.ceil(F.col("total") * F.lit(share)) - above)
    taken = F.least(F.col("n"), room)
    return c.groupBy(*keys).agg(
        F.max("total").alias("units"),
        (F.sum(taken * F.col("__val")) / F.sum(F.col("n") * F.col("__val"))).alias("top_share"),
    )
