"""Block weights, bootstraps, subsamples and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyfloor.functions.draws import draw, draw_below
from tallyfloor.functions.special import normal_tail
from tallyfloor.operators import information as info
from tallyfloor.operators.settle import settle, spread

BROADCAST_ROWS = 2_000_000  # rows of (rep, block, w), 24 bytes each


def block_weights(spark: SparkSession, blocks: int, reps: int, label: str, first: int = 0) -> DataFrame:
    """How often each block is drawn per replicate: ``blocks`` draws with replacement. The
    table is shared by every unit and category that uses the same label."""
    return (
        spark.range(1, reps + 1, 1, max(1, min(64, reps // 64)))
        .select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
        .select("rep", (draw_below(blocks, label, F.col("rep"), F.col("j")) + first).cast("int").alias("block"))
        .groupBy("rep", "block")
        .agg(F.count("*").alias("w"))
    )


def _attach(counts: DataFrame, weights: DataFrame, rows: int | None) -> DataFrame:
    """Join on block. ``rows`` is the proven size of the weights; only a table within the
    bound is broadcast, otherwise the planner picks a shuffled join."""
    side = F.broadcast(weights) if rows is not None and rows <= BROADCAST_ROWS else weights
    return counts.join(side, "block")


def bootstrap_information(
    block_counts: DataFrame, weights: DataFrame, base: Sequence[str], side: str, target: str,
    keys: Sequence[str] = (), rows: int | None = None, rep: Sequence[str] = ("rep",),
) -> DataFrame:
    """Information per replicate from counts by block.

    The block counts are written, and partitioned once on (keys, base state) into as many tasks as the replicated rows need.
    Joining the weights multiplies rows inside the tasks, where they are folded at once: replicated rows are never shuffled.
    """
    block_counts = settle(block_counts)
    drawn = weights.groupBy("block").agg(F.count("*").alias("__m"))
    replicated = 2 * (_attach(block_counts.select("block"), drawn, rows).agg(F.sum("__m")).first()[0] or 0)
    long = info.by_information_set(block_counts, keys, base, side, target, "n", ["block"])
    z = [c for c in long.columns if c.startswith("z") and c[1:].isdigit()]
    part = spread(long, replicated, *keys, *z).groupBy(*keys, *z, "fam", "b", "y", "block").agg(F.sum("n").alias("n"))
    weighted = _attach(part, weights, rows).withColumn("n", F.col("n") * F.col("w"))
    out_keys = [*keys, *rep]
    return info.information_from_sums(info.entropy_sums(weighted, out_keys), out_keys)


def loss_blocks(losses: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of losses and row counts per block."""
    return losses.groupBy(*keys, "block").agg(
        F.count("*").alias("rows"), *[F.sum(src).alias(dst) for dst, src in columns.items()]
    )


def bootstrap_losses(blocks: DataFrame, weights: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                     rows: int | None = None) -> DataFrame:
    """Mean losses per replicate as ratios of weighted sums."""
    j = _attach(blocks, weights, rows)
    return j.groupBy(*keys, "rep").agg(
        *[(F.sum(F.col(c) * F.col("w")) / F.sum(F.col("rows") * F.col("w"))).alias(c) for c in columns]
    )


def _finite(metric: str) -> Column:
    return F.abs(F.col(metric).cast("double")) < F.lit(float("inf"))


def normal_interval(point: DataFrame, reps: DataFrame, keys: Sequence[str], metric: str, level: float = 0.95,
                    low: float | None = None, high: float | None = None) -> DataFrame:
    """Point estimate with a normal interval centred on it, bias, percentiles and p-values. Replicates that are not finite
    don't count; with fewer than two that are, there is no standard error."""
    reps = reps.where(_finite(metric))
    zcrit, a = NormalDist().inv_cdf(0.5 + level / 2), 1 - level
    keys = list(keys)
    stats = [
        F.avg(metric).alias("boot_mean"), F.stddev_samp(metric).alias("se"),
        F.expr(f"percentile(`{metric}`, {a / 2!r}D)").alias("percentile_low"),
        F.expr(f"percentile(`{metric}`, {1 - a / 2!r}D)").alias("percentile_high"),
        F.avg((F.col(metric) <= 0).cast("double")).alias("nonpositive_share"),
        F.count("*").alias("replicates"),
    ]
    s = reps.groupBy(*keys).agg(*stats)
    p = point.select(*keys, F.col(metric).alias("point"))
    if keys:
        j = p.join(s, keys)
    else:
        j = p.withColumns({c: s.select(c).scalar() for c in s.columns})
    lo, hi = F.col("point") - zcrit * F.col("se"), F.col("point") + zcrit * F.col("se")
    lo = lo if low is None else F.greatest(F.lit(low), lo)
    hi = hi if high is None else F.least(F.lit(high), hi)
    j = j.withColumns({
        "bias": F.col("boot_mean") - F.col("point"), "ci_low": lo, "ci_high": hi,
        "z": F.when(F.col("se") > 0, F.col("point") / F.col("se")),
    })
    tail = normal_tail("z")
    flat1 = F.when(F.col("point") > 0, 0.0).otherwise(1.0)
    flat2 = F.when(F.col("point") != 0, 0.0).otherwise(1.0)
    j = j.withColumn("p_greater", F.when(F.col("se") > 0, tail).otherwise(flat1))
    return j.withColumn(
        "p_two_sided",
        F.when(F.col("se") > 0, F.least(F.lit(1.0), 2 * F.least(F.col("p_greater"), 1 - F.col("p_greater")))).otherwise(flat2),
    )


def centred_percentile_interval(point: DataFrame, reps: DataFrame, keys: Sequence[str], metric: str, level: float = 0.95) -> DataFrame:
    """Point plus the quantiles of (replicate - replicate mean). Replicates that are not finite don't count."""
    a = 1 - level
    s = reps.where(_finite(metric)).groupBy(*keys).agg(
        F.avg(metric).alias("m"),
        F.expr(f"percentile(`{metric}`, array({a / 2!r}D, {1 - a / 2!r}D))").alias("q"),
    )
    return point.select(*keys, F.col(metric).alias("point")).join(s, list(keys)).select(
        *keys, "point", (F.col("point") + F.col("q")[0] - F.col("m")).alias("ci_low"),
        (F.col("point") + F.col("q")[1] - F.col("m")).alias("ci_high"),
    )


def percentile_interval(reps: DataFrame, keys: Sequence[str], metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """Quantiles of each metric over its finite replicates; ``replicates`` counts all rows."""
    a = 1 - level
    aggs = []
    for m in metrics:
        for tag, p in (("low", a / 2), ("median", 0.5), ("high", 1 - a / 2)):
            aggs.append(F.expr(f"percentile(`__f_{m}`, {p!r}D)").alias(f"{m}_{tag}"))
    reps = reps.withColumns({f"__f_{m}": F.when(_finite(m), F.col(m)) for m in metrics})
    return reps.groupBy(*keys).agg(F.count("*").alias("replicates"), *aggs)


def evidence_label(point: Column, ci_low: Column, q: Column, floor_low: Column, alpha: float = 0.05) -> Column:
    sure = (q <= alpha) & (ci_low > 0) & (floor_low > 0)
    return (
        F.when(sure, "positive_after_fdr_and_interval_checks").when(point <= 0, "nonpositive_point_estimate")
        .when(ci_low > 0, "positive_interval_but_not_fdr_classified").otherwise("positive_but_interval_includes_zero")
    )


# --- sampling of blocks -------------------------------------------------------------------


def block_universe(periods: DataFrame, period: str, per_block: int, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """Blocks of consecutive periods with year and season of their midpoint, and the map of
    periods to blocks with the terminal remainder labelled. One row per calendar period."""
    from tallyfloor.functions.calendars import season

    w = W.orderBy(period)  # the calendar: one row per period
    numbered = periods.select(period).distinct().withColumn("__i", F.row_number().over(w) - 1)
    total = numbered.agg(F.count("*")).scalar()
    whole = F.floor(total / per_block) * per_block
    mapped = numbered.withColumn("__b", F.when(F.col("__i") < whole, F.floor(F.col("__i") / per_block).cast("int")))
    blocks = mapped.where(F.col("__b").isNotNull()).groupBy(F.col("__b").alias("block")).agg(
        F.min(period).alias("block_start"), F.date_add(F.max(period), days - 1).alias("block_end"),
        F.count("*").alias("periods_in_block"),
    )
    mid = F.date_add("block_start", F.floor(F.datediff("block_end", "block_start") / 2).cast("int"))
    blocks = blocks.withColumns({"stratum_year": F.year(mid), "stratum_season": season(F.month(mid))})
    residual = F.when(F.col("__b").isNull(), "incomplete_terminal_sampling_block").otherwise("")
    return blocks, mapped.select(period, F.col("__b").alias("block"), F.col("__b").isNotNull().alias("included"), residual.alias("residual_reason"))


def balanced_order(blocks: DataFrame, reps: int, label: str) -> DataFrame:
    """Random order per replicate in which every prefix keeps the year x season mix: shuffle in
    the stratum, then interleave by (rank - 1/2) / size. Ordering is over calendar blocks."""
    e = blocks.select("block", "stratum_year", "stratum_season", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    stratum = W.partitionBy("rep", "stratum_year", "stratum_season")
    shuffled = stratum.orderBy(draw(label, F.col("rep"), F.col("block")), "block")
    score = (F.row_number().over(shuffled) - 0.5) / F.count("*").over(stratum)
    scored = e.withColumn("balance_score", score)
    w = W.partitionBy("rep").orderBy(F.round("balance_score", 9), "stratum_year", "stratum_season", "block")
    return scored.withColumn("selection_rank", F.row_number().over(w))


def nested_prefixes(ordered: DataFrame, total: int, fractions: Sequence[float]) -> DataFrame:
    """Membership of each fraction: the first round(total x fraction) blocks of the order."""
    sizes = [(f, total if f == 1 else max(1, int(round(total * f)))) for f in fractions]
    rows = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(k).alias("k")) for f, k in sizes])
    return (
        ordered.withColumn("__f", F.explode(rows))
        .where(F.col("selection_rank") <= F.col("__f.k"))
        .select("rep", F.col("__f.fraction").alias("fraction"), "block", "selection_rank")
    )


def stratum_balance(membership: DataFrame, blocks: DataFrame) -> DataFrame:
    """Largest gap between a stratum's share in a prefix and its share overall."""
    strata = ["stratum_year", "stratum_season"]
    n = blocks.groupBy(*strata).agg(F.count("*").alias("all_n"))
    total = blocks.agg(F.count("*")).scalar()
    picked = membership.join(blocks.select("block", *strata), "block").groupBy("rep", "fraction", *strata).agg(F.count("*").alias("n"))
    size = membership.groupBy("rep", "fraction").agg(F.count("*").alias("size"))
    strata_list = n.agg(F.collect_list(F.struct(*strata, "all_n"))).scalar()  # a dozen strata
    grid = size.select("rep", "fraction", "size", F.explode(strata_list).alias("__s")).select("rep", "fraction", "size", "__s.*")
    full = grid.join(picked, ["rep", "fraction", *strata], "left").fillna(0, ["n"])
    gap = F.abs(F.col("n") / F.col("size") - F.col("all_n") / total)
    return full.groupBy("rep", "fraction").agg(F.max(gap).alias("max_share_deviation"))


def not_nested(membership: DataFrame, small: float, large: float) -> DataFrame:
    """Blocks of the smaller prefix that the larger one lacks; empty when nested."""
    a = membership.where(F.col("fraction") == small).select("rep", "block")
    return a.join(membership.where(F.col("fraction") == large).select("rep", "block"), ["rep", "block"], "left_anti")
