"""Least squares with group effects (K11, K12) and matrices of specifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyfloor.functions.special import normal_tail, t_tail_two_sided
from tallyfloor.operators.settle import settle


def ols_group_effects(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Slope with one effect per group and leverage-adjusted (HC3) standard error.

    Group effects are taken out by group means, which gives the same slope and leverages
    as dummies and works for any number of groups. Two reads of the rows: one for the moments of each
    group, whose sums give the slope, and one for the errors.
    """
    n = F.count("*")
    groups = settle(df.groupBy(group).agg(
        n.alias("__g"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), (n * F.var_pop(x)).alias("__xx"),
        (n * F.covar_pop(x, y)).alias("__xy"), (n * F.var_pop(y)).alias("__yy")))
    size = F.col("__g")
    t = groups.agg(
        F.sum(size).alias("n"), n.alias("groups"), F.sum("__xx").alias("xx"), F.sum("__xy").alias("xy"), F.sum("__yy").alias("yy"),
        (F.sum(size * F.col("__my")) / F.sum(size)).alias("grand")).first()
    if not t["n"] or not t["xx"]:
        raise ValueError("the predictor does not vary inside any group")
    slope, sxx = t["xy"] / t["xx"], t["xx"]
    between = groups.agg(F.sum(size * (F.col("__my") - t["grand"]) ** 2)).first()[0]
    u, v = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    e, h = v - slope * u, 1 / size + u * u / sxx
    adj = e / F.greatest(1 - h, F.lit(2.220446049250313e-16))
    out = df.join(groups.select(group, "__g", "__mx", "__my"), group).agg(
        n.alias("observations"), F.lit(slope).alias("slope"), (F.sqrt(F.sum(u * u * adj * adj)) / sxx).alias("hc3_se"),
        (1 - F.sum(e * e) / (t["yy"] + between)).alias("r_squared"), F.lit(t["groups"]).cast("long").alias("groups"))
    out = out.withColumns({
        "df": (F.col("observations") - F.col("groups") - 1).cast("int"),
        "t": F.when(F.col("hc3_se") > 0, F.col("slope") / F.col("hc3_se")),
    })
    return out.withColumn("p", t_tail_two_sided("t", "df"))


def ols_clustered(df: DataFrame, y: str, predictors: Sequence[str], effects: Mapping[str, Sequence[str]], cluster: str) -> DataFrame:
    """Slopes with dummy effects of a few short lists of levels (first level left out) and
    cluster-robust errors. The design has a fixed number p of columns: the cluster passes the
    driver a p x p matrix twice and nothing else."""
    import numpy as np

    cols: dict[str, Column] = {"intercept": F.lit(1.0), **{p: F.col(p).cast("double") for p in predictors}}
    for name, levels in effects.items():
        for level in list(levels)[1:]:
            cols[f"{name}_{level}"] = (F.col(name) == level).cast("double")
    names = list(cols)
    x = df.select(F.col(y).cast("double").alias("__y"), F.col(cluster).alias("__cl"), *[c.alias(n) for n, c in cols.items()])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    prod = lambda a, b: F.sum(F.col(f"`{a}`") * F.col(f"`{b}`"))
    first = x.agg(
        F.count("*").alias("n"), F.sum(F.col("__y")).alias("sy"), F.sum(F.col("__y") ** 2).alias("syy"),
        *[prod(a, b).alias(f"m{i}") for i, (a, b) in enumerate(pairs)], *[prod(a, "__y").alias(f"v{i}") for i, a in enumerate(names)],
    ).first()

    def square(row, tag):
        m = np.zeros((len(names), len(names)))
        for i, (a, b) in enumerate(pairs):
            m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = row[f"{tag}{i}"]
        return m

    inverse = np.linalg.pinv(square(first, "m"))
    beta = inverse @ np.array([first[f"v{i}"] for i in range(len(names))])
    fitted = sum((F.lit(float(b)) * F.col(f"`{n}`") for b, n in zip(beta, names)), F.lit(0.0))
    res = x.withColumn("__e", F.col("__y") - fitted)
    scores = res.groupBy("__cl").agg(*[F.sum(F.col(f"`{n}`") * F.col("__e")).alias(n) for n in names], F.sum(F.col("__e") ** 2).alias("__sse"))
    second = scores.agg(F.count("*").alias("g"), F.sum("__sse").alias("sse"), *[prod(a, b).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]).first()
    n, g, k = first["n"], second["g"], len(names)
    cov = inverse @ square(second, "m") @ inverse * (g / (g - 1)) * ((n - 1) / (n - k))
    r2 = 1 - second["sse"] / (first["syy"] - first["sy"] ** 2 / n)
    rows = [(p, float(beta[names.index(p)]), float(np.sqrt(max(cov[names.index(p), names.index(p)], 0.0))), n, g, float(r2)) for p in predictors]
    out = df.sparkSession.createDataFrame(rows, "predictor string, coefficient double, clustered_se double, observations long, clusters long, r_squared double")
    out = out.withColumn("z", F.abs(F.col("coefficient") / F.col("clustered_se")))
    return out.withColumn("p", 2 * normal_tail("z")).drop("z")


def spec_counts(df: DataFrame, specs: Mapping[str, Mapping], key: str = "spec") -> DataFrame:
    """Joint counts of many specifications from one scan: a row is emitted once for every
    specification it belongs to and folded straight away. A specification gives ``base``
    (columns), ``side``, ``target`` and optionally ``where``."""
    rows = []
    for name, s in specs.items():
        state = F.concat_ws("|", *[F.col(c).cast("string") for c in s["base"]]) if s["base"] else F.lit("")
        entry = F.struct(F.lit(name).alias(key), state.alias("z"), F.col(s["side"]).cast("int").alias("b"), F.col(s["target"]).cast("long").alias("y"))
        keep = s.get("where")
        complete = F.col(s["side"]).isNotNull() & F.col(s["target"]).isNotNull()
        for c in s["base"]:
            complete = complete & F.col(c).isNotNull()
        rows.append(F.when(complete if keep is None else complete & keep, entry))
    e = df.select(F.explode(F.array(*rows)).alias("e")).where("e IS NOT NULL").select("e.*")
    return e.groupBy(key, "z", "b", "y").agg(F.count("*").alias("n"))


def run_specs(df: DataFrame, specs: Mapping[str, Mapping], key: str = "spec") -> DataFrame:
    """Plug-in, bias-corrected and prior-based estimates of every specification."""
    from tallyfloor.operators import information as info

    counts = spec_counts(df, specs, key)
    a = info.conditional_information(counts, ["z"], "b", "y", [key])
    j = info.jeffreys_information(counts, ["z"], "b", "y", [key]).select(key, F.col("cmi").alias("cmi_jeffreys"))
    return a.join(j, key)
