"""Joint counts and the information read off them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyfloor.functions.special import digamma

LN2 = math.log(2.0)


def fit_cuts(df: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear quantiles of the positive values, as one array per key.

    Counts repeat, so values are tallied first; the exact quantile then holds one entry per
    distinct value and never the rows themselves.
    """
    tally = df.where(F.col(column) > 0).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    wanted = "array(" + ",".join(f"{p!r}D" for p in probs) + ")"
    return tally.groupBy(*keys).agg(F.expr(f"percentile(__v, {wanted}, __n)").alias("cuts"))


def scalar_cuts(df: DataFrame, column: str, probs: Sequence[float]) -> Column:
    """The same for the whole frame, as a scalar usable in any column expression."""
    return fit_cuts(df, column, probs).select("cuts").scalar()


def joint_counts(
    df: DataFrame, base: Sequence[str], side: str, target: str,
    keys: Sequence[str] = (), block: str | None = None, weight: str | None = None,
) -> DataFrame:
    """Frequency table (keys, base states, side state, target[, block]) -> n. Rows leave the
    picture here: partial sums run before the one shuffle."""
    extra = [] if block is None else [block]
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys, *base, side, target, *extra).agg(n.alias("n"))


def by_information_set(counts: DataFrame, keys: Sequence[str], base: Sequence[str], side: str,
                       target: str, n: str = "n", extra: Sequence[str] = (),
                       with_base: bool = True) -> DataFrame:
    """Every count once without (``fam`` 0) and once with (``fam`` 1) the side state."""
    side_type = counts.schema[side].dataType
    rows = [F.struct(F.lit(1).alias("fam"), F.col(side).alias("b"))]
    if with_base:
        rows.insert(0, F.struct(F.lit(0).alias("fam"), F.lit(None).cast(side_type).alias("b")))
    z = [F.col(c).alias(f"z{i}") for i, c in enumerate(base)]
    if not z:
        z = [F.lit(0).alias("z0")]
    return (
        counts.select(*keys, *extra, *z, F.col(target).alias("y"), F.col(n).alias("n"), F.explode(F.array(*rows)).alias("r"))
        .select(*keys, *extra, *[f"z{i}" for i in range(max(1, len(base)))], "r.fam", "r.b", "y", "n")
    )


def entropy_sums(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold a long atom table (keys, z.., fam, b, y, n) into sums per key.

    Three nested group-bys whose keys all contain (keys, z): once the input is partitioned
    on those, none of the inner levels shuffles, and the last one moves a single partial row
    per key and task.
    """
    z = [c for c in long.columns if c.startswith("z") and c[1:].isdigit()]
    nln = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    atoms = long.groupBy(*keys, *z, "fam", "b", "y").agg(F.sum("n").alias("n")).where("n > 0")
    states = atoms.groupBy(*keys, *z, "fam", "b").agg(
        F.sum("n").alias("ns"), F.sum(nln("n")).alias("f"), F.count("*").alias("k"),
        F.count_if(F.col("n") == 1).alias("ones"),
    )
    is0, is1 = F.col("fam") == 0, F.col("fam") == 1
    pick = lambda cond, c: F.sum(F.when(cond, c))
    per_z = states.groupBy(*keys, *z).agg(
        *[a.alias(f"{name}{i}") for i, cond in ((0, is0), (1, is1)) for name, a in (
            ("n", pick(cond, F.col("ns"))), ("fs", pick(cond, nln("ns"))), ("fa", pick(cond, F.col("f"))),
            ("s", F.count_if(cond)), ("a", pick(cond, F.col("k"))), ("o", pick(cond, F.col("ones"))))]
    )
    nu = (F.col("s1") - 1) * (F.col("a0") - 1)
    return per_z.groupBy(*keys).agg(
        *[F.sum(f"{name}{i}").alias(f"{name}{i}") for i in (0, 1) for name in ("n", "fs", "fa", "s", "a", "o")],
        F.sum(nu).alias("nu"),
    )


def information_from_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plug-in and bias-corrected conditional entropies (bits), their difference and the support."""
    c = F.col
    n = c("n1")
    plug = lambda i: (c(f"fs{i}") - c(f"fa{i}")) / (n * LN2)
    corr = lambda i: (c(f"a{i}") - c(f"s{i}")) / (2.0 * n * LN2)
    out = sums.select(
        *keys, n.alias("n"), plug(0).alias("h0_plugin"), plug(1).alias("hb_plugin"),
        (plug(0) + corr(0)).alias("h0"), (plug(1) + corr(1)).alias("hb"),
        c("s0").alias("base_states"), c("s1").alias("side_states"),
        c("a0").alias("base_atoms"), c("a1").alias("side_atoms"),
        c("o1").alias("singleton_atoms"), c("nu").alias("nu"),
    )
    return out.withColumns(
        {
            "cmi_plugin": c("h0_plugin") - c("hb_plugin"),
            "cmi": c("h0") - c("hb"),
            "k_over_n": c("side_atoms") / c("n"),
            "singleton_share": c("singleton_atoms") / c("n"),
            "nu_over_n": c("nu") / c("n"),
        }
    )


def conditional_information(
    counts: DataFrame, base: Sequence[str], side: str, target: str, keys: Sequence[str] = (), n: str = "n",
) -> DataFrame:
    """One row per key from a joint-count table."""
    long = by_information_set(counts, keys, base, side, target, n)
    z = [c for c in long.columns if c.startswith("z") and c[1:].isdigit()]
    return information_from_sums(entropy_sums(long.repartition(*keys, *z), keys), keys)


def marginal_entropy(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Plug-in and bias-corrected entropy of the target without states."""
    tally = df.groupBy(*keys, target).agg(F.count("*").alias("c"))
    out = tally.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count("*").alias("support"),
        F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("f"),
    )
    plug = (F.col("n") * F.log(F.col("n").cast("double")) - F.col("f")) / (F.col("n") * LN2)
    return out.select(
        *keys, "n", "support", plug.alias("h_plugin"),
        (plug + (F.col("support") - 1) / (2.0 * F.col("n") * LN2)).alias("h"),
    )


def jeffreys_information(counts: DataFrame, base: Sequence[str], side: str, target: str,
                         keys: Sequence[str] = (), alpha: float = 0.5, n: str = "n") -> DataFrame:
    """Posterior-mean entropies under one symmetric prior on the observed joint atoms; coarser
    tables inherit the sum of the prior mass of the atoms they pool."""
    z = list(base)
    dig = lambda a: a * digamma(a + 1.0)
    atoms = counts.select(*keys, *z, F.col(side).alias("__b"), F.col(target).alias("__y"), F.col(n).alias("n"))
    atoms = atoms.groupBy(*keys, *z, "__b", "__y").agg((F.sum("n") + alpha).alias("a")).repartition(*keys, *z)
    zb = atoms.groupBy(*keys, *z, "__b").agg(F.sum("a").alias("a"), F.sum(dig(F.col("a"))).alias("g"))
    side_part = zb.groupBy(*keys).agg(
        F.sum("a").alias("total"), F.sum("g").alias("g_zby"), F.sum(dig(F.col("a"))).alias("g_zb")
    )
    zy = atoms.groupBy(*keys, *z, "__y").agg(F.sum("a").alias("a"))
    per_z = zy.groupBy(*keys, *z).agg(F.sum("a").alias("a"), F.sum(dig(F.col("a"))).alias("g"))
    base_part = per_z.groupBy(*keys).agg(F.sum("g").alias("g_zy"), F.sum(dig(F.col("a"))).alias("g_z"))
    joined = side_part.join(base_part, list(keys)) if keys else side_part.withColumns(
        {"g_zy": base_part.select("g_zy").scalar(), "g_z": base_part.select("g_z").scalar()}
    )
    t = F.col("total")
    return joined.select(
        *keys,
        ((F.col("g_z") - F.col("g_zy")) / (t * LN2)).alias("h0"),
        ((F.col("g_zb") - F.col("g_zby")) / (t * LN2)).alias("hb"),
    ).withColumn("cmi", F.col("h0") - F.col("hb"))


def state_sparsity(counts: DataFrame, states: Sequence[str], keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Occupancy of the states: how many, median size, share seen once."""
    sizes = counts.groupBy(*keys, *states).agg(F.sum(n).alias("size")).groupBy(*keys, "size").agg(F.count("*").alias("m"))
    return sizes.groupBy(*keys).agg(
        F.sum("m").alias("states"),
        F.expr("percentile(size, 0.5D, m)").alias("median_per_state"),
        (F.sum(F.when(F.col("size") == 1, F.col("m")).otherwise(0)) / F.sum("m")).alias("singleton_state_share"),
        (F.sum(F.when(F.col("size") == 1, F.col("m")).otherwise(0)) / F.sum(F.col("size") * F.col("m"))).alias(
            "singleton_observation_share"),
    )


def prepare_states(df: DataFrame, target: str, lag: str, side_lag: str, cuts: Column, k: int | None = 2,
                   lag_state: str = "lag_state", side_state: str = "side_state") -> DataFrame:
    """Drop rows without lags, map both states, and fail on a target that is not a count."""
    from tallyfloor.functions.states import count_code, cut_code

    bad = F.col(target).isNull() | (F.col(target) < 0) | (F.col(target) != F.floor(target))
    checked = F.when(bad, F.raise_error(F.lit("target must be a nonnegative integer"))).otherwise(F.col(target))
    return (
        df.where(F.col(lag).isNotNull() & F.col(side_lag).isNotNull())
        .withColumns({target: checked, lag_state: count_code(F.col(lag)), side_state: cut_code(F.col(side_lag), cuts, k)})
        .where(F.col(lag_state).isNotNull() & F.col(side_state).isNotNull())
    )
