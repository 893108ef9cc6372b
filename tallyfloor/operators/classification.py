"""Classification of the target from states: entropies, error floors and modal errors under resampled train and test blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyfloor.functions import bounds
from tallyfloor.operators import information as info, resample as rs, summaries as sm
from tallyfloor.operators.settle import settle

METRICS = ("entropy", "floor", "test_error")


def weighted_counts(counts: DataFrame, weights: DataFrame, reps: int, states: Sequence[str], label: str) -> DataFrame:
    """Counts (rep, states.., label, n) of each replicate from counts by block: a block counts as often as it is drawn, and rows of no whole block
    (null) once in each replicate. Blocks multiply counts, never rows."""
    drawn = counts.where("block IS NOT NULL").join(weights, "block").select("rep", *states, label, (F.col("n") * F.col("w")).alias("n"))
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))).alias("rep")
    fixed = counts.where("block IS NULL").select(every, *states, label, "n")
    return drawn.unionByName(fixed).groupBy("rep", *states, label).agg(F.sum("n").alias("n"))


def _evaluate(train: DataFrame, test: DataFrame, base: Sequence[str], side: str, label: str, classes: int) -> DataFrame:
    """Rows (rep, information_set, estimator, entropy, floor, train_error, test_error, unseen, violation) from weighted counts. The most frequent
    class of a state is chosen anew under the weights of each replicate."""
    h = info.conditional_information(train, base, side, label, ["rep"])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("information_set"), F.lit(kind).alias("estimator"), F.col(column).alias("entropy"))
        for name, kind, column in (("baseline", "plugin", "h0_plugin"), ("baseline", "miller_madow", "h0"), ("side_aware", "plugin", "hb_plugin"), ("side_aware", "miller_madow", "hb"))
    ])).alias("e")
    entropies = h.select("rep", rows).select("rep", "e.*").withColumn("floor", bounds.fano_floor("entropy", classes))
    errors = None
    for name, states in (("baseline", [*base]), ("side_aware", [*base, side])):
        one = sm.modal_error(train, test, states, label, "n", ["rep"]).select("rep", F.lit(name).alias("information_set"), "train_error", "test_error", "unseen")
        errors = one if errors is None else errors.unionByName(one)
    out = entropies.join(errors, ["rep", "information_set"])
    return out.withColumn("violation", F.col("test_error") + 1e-12 < F.col("floor"))


def classification_bootstrap(train: DataFrame, test: DataFrame, train_weights: DataFrame, test_weights: DataFrame, reps: int,
                             base: Sequence[str], side: str, label: str, classes: int) -> DataFrame:
    """Entropies, error floors and errors of the modal classifier for each replicate, with and without the side state.

    ``train`` and ``test`` are counts by (block, base.., side, label) with ``n``; each has its own table of weights (rep, block, w), so that
    train and test blocks are drawn independently in the same replicate. Both are folded once."""
    states = [*base, side]
    a = settle(weighted_counts(train, train_weights, reps, states, label))
    b = settle(weighted_counts(test, test_weights, reps, states, label))
    return _evaluate(a, b, base, side, label, classes)


def classification_point(train: DataFrame, test: DataFrame, base: Sequence[str], side: str, label: str, classes: int) -> DataFrame:
    """The same from the counts as they are, as one replicate numbered 0."""
    once = lambda t: settle(t.groupBy(F.lit(0).cast("long").alias("rep"), *base, side, label).agg(F.sum("n").alias("n")))
    return _evaluate(once(train), once(test), base, side, label, classes)


def contrasts(rows: DataFrame) -> DataFrame:
    """Long rows (rep, estimator, metric, value): baseline less side-aware entropy, floor and test error."""
    value = lambda m, s: F.max(F.when(F.col("information_set") == s, F.col(m)))
    wide = rows.groupBy("rep", "estimator").agg(*[(value(m, "baseline") - value(m, "side_aware")).alias(m) for m in METRICS])
    return wide.select("rep", "estimator", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("e")).select("rep", "estimator", "e.*")


def contrast_intervals(point: DataFrame, replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """estimator, metric, point, ci_low, ci_high: contrasts with centred percentile intervals."""
    return rs.centred_percentile_interval(contrasts(point), settle(contrasts(replicates)), ["estimator", "metric"], "value", level)
