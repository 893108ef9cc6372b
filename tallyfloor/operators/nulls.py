"""Randomization references for the side signal.

A unit's series is at most as long as the calendar, however many events it had, so it is kept
as one array per unit. Every surrogate is built inside that row and folded into counts before
anything is shuffled: what moves is replicates x atoms and not replicates x rows. Where units are keys of the result, counts
are nearly as many as rows; ``rows``, the rows of all surrogates, then says over how many tasks they are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyfloor.functions.draws import draw, draw_below
from tallyfloor.operators import information as info, ordering
from tallyfloor.operators.settle import settle, spread


def unit_series(df: DataFrame, unit: Sequence[str], order: str, base: Sequence[str], side: str, target: str,
                extra: Sequence[str] = ()) -> DataFrame:
    cols = [F.col(order).alias("__o"), *[F.col(c) for c in base], F.col(side).alias("b"), F.col(target).alias("y"), *[F.col(c) for c in extra]]
    return df.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("s")).withColumn("t", F.size("s"))


def _reps(series: DataFrame, reps: int) -> DataFrame:
    return series.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def surrogate_rows(series: DataFrame, reps: int) -> int:
    """Rows of all surrogates of a design."""
    return reps * (series.agg(F.sum("t")).first()[0] or 0)


def _dealt(frame: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    return frame if rows is None else spread(frame, rows, *keys)


def _emit(frame: DataFrame, source, keys: Sequence[str], base: Sequence[str]) -> DataFrame:
    """Rows (keys, rep, base.., b, y): the side state at ``source(p)`` beside base and target at
    ``p``. The series is rebuilt as one array first, so exploding it does not drag it along."""
    rebuilt = F.transform(
        F.sequence(F.lit(0), F.col("t") - 1),
        lambda p: F.struct(
            *[F.col("s")[p][c].alias(c) for c in base],
            F.col("s")[source(p).cast("int")]["b"].alias("b"), F.col("s")[p]["y"].alias("y"),
        ),
    )
    return frame.select(*keys, "rep", F.explode(rebuilt).alias("e")).select(*keys, "rep", "e.*")


def temporal_blocks(series: DataFrame, unit: str, reps: int, length: int, label: str, keys: Sequence[str], base: Sequence[str],
                    rows: int | None = None) -> DataFrame:
    """Whole blocks of a unit change places; the remainder stays."""
    f = _reps(_dealt(series, rows, unit), reps).withColumn("nb", F.floor(F.col("t") / length).cast("int"))
    order = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda i: F.struct(draw(label, F.col("rep"), F.col(unit), i).alias("d"), i.alias("i")),
    ))
    f = f.withColumn("donor", order)
    return _emit(f, lambda p: F.when(
        p < F.col("nb") * length, F.col("donor")[F.floor(p / length).cast("int")]["i"] * length + p % length
    ).otherwise(p), keys, base)


def circular_shift(series: DataFrame, unit: str, reps: int, minimum: int, label: str, keys: Sequence[str], base: Sequence[str],
                   rows: int | None = None) -> DataFrame:
    """Every unit rotates by its own shift in [minimum, T - minimum]."""
    short = F.when(F.col("t") <= 2 * minimum, F.raise_error(F.lit("series too short for the shift"))).otherwise(F.col("t"))
    f = _reps(_dealt(series, rows, unit).withColumn("t", short.cast("int")), reps)
    f = f.withColumn("shift", (draw_below(F.col("t") - 2 * minimum + 1, label, F.col("rep"), F.col(unit)) + minimum).cast("int"))
    return _emit(f, lambda p: F.pmod(p + F.col("shift"), F.col("t")), keys, base)


def unit_permutation(units: DataFrame, unit: str, reps: int, label: str, group: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(rep, unit, donor): units matched by two ranks, one fixed and one random per replicate; ``carry`` are columns of the donor that come along.
    Ranks are taken over ranges of values, so no task sees all units."""
    group = list(group)
    base = units.select(*group, unit, *carry).distinct()
    to = ordering.cumulative_counts(base.select(*group, unit), unit, group).select(*group, F.col(unit), F.col("n_below").alias("__r"))
    f = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    f = f.withColumn("__d", draw(label, F.col("rep"), F.col(unit)))
    donors = ordering.row_ranks(f, "__d", unit, "__rank", ["rep", *group]).select(
        "rep", *group, F.col(unit).alias("donor"), *carry, (F.col("__rank") - 1).alias("__r")
    )
    return donors.join(to, [*group, "__r"]).select(*group, "rep", unit, "donor", *carry)


def series_permutation(series: DataFrame, unit: str, reps: int, label: str, keys: Sequence[str], base: Sequence[str], group: Sequence[str] = (),
                       rows: int | None = None) -> DataFrame:
    """Units of a group exchange whole side series. What travels with a replicate is the donor's series, packed as one array of
    single bytes (a code below 128 for each period); the receiver's own series joins last and once."""
    pairs = unit_permutation(series, unit, reps, label, group)
    packed = F.transform("s", lambda e: F.when(e["b"].between(-128, 127), e["b"].cast("byte")).otherwise(F.raise_error(F.lit("side states must fit a byte")).cast("byte")))
    b = series.select(F.col(unit).alias("donor"), *group, packed.alias("bs"))
    j = _dealt(pairs.join(b, ["donor", *group]).drop("donor"), rows, unit, *group).join(series.select(*{unit, *keys, *group}, "s"), [unit, *group])
    kind = next(f.dataType for f in series.schema["s"].dataType.elementType if f.name == "b")
    rebuilt = F.transform("s", lambda e, i: F.struct(*[e[c].alias(c) for c in base], F.col("bs")[i].cast(kind).alias("b"), e["y"].alias("y")))
    return j.select(*keys, "rep", F.explode(rebuilt).alias("e")).select(*keys, "rep", "e.*")


def block_strata(rows: DataFrame, unit: str, pos: str, date: str, lag_state: str, holiday: str, length: int, minimum: int = 5) -> DataFrame:
    """Movable blocks of each unit: grouped by year and season where at least ``minimum`` blocks
    share them, the rest by year, each group ordered by how busy the lag was."""
    t = rows.groupBy(unit).agg(F.count("*").alias("__t"))
    blocks = rows.join(t, unit).where(F.col(pos) < F.floor(F.col("__t") / length) * length)
    blocks = blocks.groupBy(unit, F.floor(F.col(pos) / length).cast("int").alias("block")).agg(
        F.min(date).alias("d"), (F.sum(lag_state) / length + 0.25 * F.sum(F.col(holiday).cast("int"))).alias("score")
    )
    blocks = blocks.withColumns({"year": F.year("d"), "season": F.floor(F.pmod(F.month("d"), F.lit(12)) / 3).cast("int")})
    fine = F.count("*").over(W.partitionBy(unit, "year", "season")) >= minimum
    blocks = blocks.withColumn("g", F.when(fine, F.col("season")).otherwise(F.lit(9)))
    w = W.partitionBy(unit, "year", "g")
    blocks = blocks.withColumn("n", F.count("*").over(w)).withColumn("n", F.when(F.col("n") >= minimum, F.col("n")).otherwise(0))
    rank = F.row_number().over(w.orderBy(F.round("score", 9), "block")) - 1
    return blocks.withColumn("rank", rank).select(unit, "block", "year", "g", "rank", "n", "score")


def matched_blocks(series: DataFrame, strata: DataFrame, unit: str, reps: int, length: int, label: str, keys: Sequence[str], base: Sequence[str]) -> DataFrame:
    """Blocks of a group rotate by a random step of at least one; other blocks stay."""
    plan = strata.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("block", "year", "g", "rank", "n"))).alias("blocks"))
    plan = plan.withColumn("ordered", F.transform(
        F.array_sort(F.transform("blocks", lambda e: F.struct(e["year"].alias("year"), e["g"].alias("g"), e["rank"].alias("rank"), e["block"].alias("block")))),
        lambda e: e["block"],
    ))
    starts = F.transform("blocks", lambda e: F.size(F.filter("blocks", lambda o: (o["year"] < e["year"]) | ((o["year"] == e["year"]) & (o["g"] < e["g"])))))
    plan = plan.withColumn("starts", starts)
    f = _reps(series.join(plan, unit), reps)
    donor = F.transform(
        "blocks",
        lambda e, i: F.when(
            e["n"] > 1,
            F.col("ordered")[(F.col("starts")[i] + F.pmod(
                e["rank"] - 1 - draw_below(e["n"] - 1, label, F.col("rep"), F.col(unit), e["year"], e["g"]), e["n"])).cast("int")],
        ).otherwise(e["block"]),
    )
    f = f.withColumn("donor", donor)
    return _emit(f, lambda p: F.when(
        p < F.size("donor") * length, F.col("donor")[F.floor(p / length).cast("int")] * length + p % length
    ).otherwise(p), keys, base)


BUCKET_BITS = 8  # leading bits of a draw that radix counts keep apart


def state_matched(rows: DataFrame, row_key: Sequence[str], reps: int, label: str, keys: Sequence[str], base: Sequence[str], side: str, target: str,
                  bits: int = BUCKET_BITS) -> DataFrame:
    """Side states change places inside each base state: counts (keys, rep, base.., b, y, n) of each replicate.

    Targets of a state are laid out in order, so the random rank of a donor says which target it meets, and only the ranks at which
    the target changes matter. Draws are counted by their leading bits first (partial sums; what moves is replicates x states x buckets).
    A bucket whose ranks all meet one target is done with its count. The few in which the target changes, one for each change at most, are
    looked at again: their rows, a 2**bits-th part for each change, are ranked inside the bucket. A state with a third of all rows is split like any other.
    """
    cell = [*keys, *base]
    layout = rows.groupBy(*cell, target).agg(F.count("*").alias("__n")).groupBy(*cell).agg(
        F.array_sort(F.collect_list(F.struct(F.col(target).alias("y"), F.col("__n").alias("n")))).alias("__l")
    )
    tops = F.transform("__l", lambda e, i: F.struct(
        e["y"].alias("y"), F.aggregate(F.slice("__l", 1, i + 1), F.lit(0).cast("long"), lambda acc, o: acc + o["n"]).alias("top")))
    layout = layout.select(*cell, tops.alias("__tops"))
    meets = lambda rank: F.element_at(F.filter("__tops", lambda e: e["top"] >= rank), 1)["y"]
    f = rows.select(*cell, F.col(side).alias("b"), *row_key, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    f = f.withColumn("__d", draw(label, F.col("rep"), *[F.col(k) for k in row_key]))
    f = f.withColumn("__bucket", F.shiftright("__d", 32 - bits).cast("int"))
    place = [*cell, "rep", "__bucket"]
    counted = settle(f.groupBy(*place, "b").agg(F.count("*").alias("n")))
    sums = counted.groupBy(*place).agg(F.sum("n").alias("__k"))
    below = F.sum("__k").over(W.partitionBy(*cell, "rep").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    ranked = sums.withColumn("__below", F.coalesce(below, F.lit(0))).join(layout, cell)
    ranked = settle(ranked.select(*place, "__below", meets(F.col("__below") + 1).alias("__low"), meets(F.col("__below") + F.col("__k")).alias("__high")))
    even = counted.join(ranked.where("__low = __high"), place).select(*keys, "rep", *base, "b", F.col("__low").alias("y"), "n")
    mixed = settle(ranked.where("__low <> __high").select(*place, "__below"))  # its written size tells the planner whether to broadcast it
    inside = F.row_number().over(W.partitionBy(*place).orderBy("__d", *row_key))
    looked = f.join(mixed, place).withColumn("__rank", F.col("__below") + inside).join(layout, cell)
    split = looked.groupBy(*keys, "rep", *base, "b", meets(F.col("__rank")).alias("y")).agg(F.count("*").alias("n"))
    return even.unionByName(split).groupBy(*keys, "rep", *base, "b", "y").agg(F.sum("n").alias("n"))


def null_information(surrogate: DataFrame, base: Sequence[str], keys: Sequence[str] = (), with_base: bool = False, counted: bool = False,
                     rows: int | None = None) -> DataFrame:
    """hb, support and (with ``with_base``) h0 per replicate. The base entropy does not change
    under any design, so by default only the augmented side is counted. ``counted`` marks a table of counts ``n``."""
    k = [*keys, "rep"]
    counts = surrogate if counted else surrogate.groupBy(*k, *base, "b", "y").agg(F.count("*").alias("n"))
    long = info.by_information_set(counts, k, base, "b", "y", "n", with_base=with_base)
    z = [c for c in long.columns if c.startswith("z") and c[1:].isdigit()]
    parted = long.repartition(*k, *z) if rows is None else spread(long, rows, *k, *z)
    out = info.information_from_sums(info.entropy_sums(parted, k), k)
    if with_base:
        return out
    return out.select(*k, "n", "hb_plugin", "hb", "side_states", "side_atoms", "singleton_atoms", "k_over_n", "singleton_share")


def with_observed(null: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cmi of each replicate, using the base entropy of the observed data."""
    if keys:
        return null.join(observed.select(*keys, F.col("h0").alias("__h0")), list(keys)).withColumn("cmi", F.col("__h0") - F.col("hb")).drop("__h0")
    return null.withColumn("cmi", observed.select("h0").scalar() - F.col("hb"))


TIE = 1e-12  # replicate and observed values this close count as equal


def null_summary(null: DataFrame, observed: DataFrame, keys: Sequence[str], metric: str = "cmi") -> DataFrame:
    """Mean, spread and 95 % range of the null, distance of the observed value, plus-one p. Replicates that are not finite don't count."""
    keys = list(keys)
    null = null.where(F.abs(F.col(metric).cast("double")) < F.lit(float("inf")))
    obs = observed.select(*keys, F.col(metric).alias("observed"))
    if keys:
        j = null.join(obs, keys)
    else:
        j = null.withColumn("observed", obs.scalar())
    s = j.groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.avg(metric).alias("null_mean"), F.stddev_samp(metric).alias("null_sd"),
        F.expr(f"percentile(`{metric}`, 0.025D)").alias("null_low"), F.expr(f"percentile(`{metric}`, 0.975D)").alias("null_high"),
        F.count("*").alias("replicates"), F.count_if(F.col(metric) >= F.col("observed") - TIE).alias("exceed"),
    )
    return s.withColumns({
        "difference": F.col("observed") - F.col("null_mean"),
        "z": F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")),
        "p": (1 + F.col("exceed")) / (1 + F.col("replicates")),
    })


def joint_screen(tests: DataFrame, unit: Sequence[str], q: str, alpha: float = 0.05) -> DataFrame:
    """Units that pass under every design."""
    return tests.groupBy(*unit).agg(F.bool_and(F.coalesce(F.col(q) <= alpha, F.lit(False))).alias("passes_all"), F.count("*").alias("designs"))


def standardised_difference(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Difference of means over the root mean of both population variances; 0 without spread."""
    s = df.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    den = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select(*keys, F.when(den > 0, (F.col("ma") - F.col("mb")) / den).otherwise(0.0).alias("smd"))


def replicate_summary(df: DataFrame, keys: Sequence[str], estimate: str, truth: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Bias, error, share of positive estimates and rejection rate of a table of replicates."""
    e = F.col(estimate) - F.col(truth)
    return df.groupBy(*keys).agg(
        F.count("*").alias("replicates"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((F.col(estimate) > 0).cast("double")).alias("positive_share"),
        F.count_if(F.col(p) <= alpha).alias("rejections"),
        F.avg((F.col(p) <= alpha).cast("double")).alias("rejection_rate"),
    )


def minimum_effect(power: DataFrame, keys: Sequence[str], effect: str, rate: str, target: float = 0.8) -> DataFrame:
    """Smallest effect whose running-maximum power reaches the target, and the linear crossing.
    A key holds one row per effect size of the study design."""
    w = W.partitionBy(*keys).orderBy(effect)
    c = power.withColumn("__r", F.max(rate).over(w.rowsBetween(W.unboundedPreceding, 0)))
    c = c.withColumns({"__pr": F.lag("__r").over(w), "__pe": F.lag(effect).over(w)})
    hit = F.col("__r") >= target
    cross = F.when(F.col("__pr").isNull() | (F.col("__r") == F.col("__pr")), F.col(effect)).otherwise(
        F.col("__pe") + (target - F.col("__pr")) * (F.col(effect) - F.col("__pe")) / (F.col("__r") - F.col("__pr")))
    out = c.groupBy(*keys).agg(
        F.min(F.when(hit, F.col(effect))).alias("discrete_effect"),
        F.min_by(F.when(hit, cross), F.when(hit, F.col(effect))).alias("interpolated_effect"),
        F.max("__r").alias("max_power"),
    )
    return out.withColumn("status", F.when(F.col("discrete_effect").isNull(), "not_reached").otherwise("reached"))
