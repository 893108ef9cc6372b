"""Neighbours and spatial autocorrelation on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyfloor.operators import nulls
from tallyfloor.operators.settle import settle


def queen_edges(cells: DataFrame, unit: str, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(unit, neighbour) for the eight adjacent cells: eight shifted keys and one equi-join."""
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    a = cells.select(*keys, F.col(unit), F.col(x).cast("long").alias("__x"), F.col(y).cast("long").alias("__y"), F.explode(shifts).alias("d"))
    a = a.select(*keys, unit, (F.col("__x") + F.col("d.i")).alias("__x"), (F.col("__y") + F.col("d.j")).alias("__y"))
    b = cells.select(*keys, F.col(unit).alias("neighbour"), F.col(x).cast("long").alias("__x"), F.col(y).cast("long").alias("__y"))
    return a.join(b, [*keys, "__x", "__y"]).select(*keys, unit, "neighbour")


def standardise(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """z-score with the population spread; no spread is an error."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    j = df.join(s, list(keys)) if keys else df.withColumns({"__m": s.select("__m").scalar(), "__s": s.select("__s").scalar()})
    flat = F.when(F.col("__s") <= 0, F.raise_error(F.lit("no variance"))).otherwise(F.col("__s"))
    return j.withColumn("z", (F.col(value) - F.col("__m")) / flat).drop("__m", "__s")


def spatial_lag(z: DataFrame, edges: DataFrame, unit: str, value: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the neighbours; null and flagged for islands."""
    nb = edges.join(z.select(*keys, F.col(unit).alias("neighbour"), F.col(value).alias("__v")), [*keys, "neighbour"])
    lag = nb.groupBy(*keys, unit).agg(F.avg("__v").alias("lag"), F.count("*").alias("neighbour_count"))
    return z.join(lag, [*keys, unit], "left").withColumns(
        {"neighbour_count": F.coalesce("neighbour_count", F.lit(0)), "island": F.col("lag").isNull()}
    )


def _moran(lagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, s0 = F.count("*"), F.count_if(~F.col("island"))
    stat = n / s0 * F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))) / F.sum(F.col("z") * F.col("z"))
    return lagged.groupBy(*keys).agg(stat.alias("moran_i"), n.alias("units"), s0.alias("non_islands"))


def permuted(z: DataFrame, unit: str, reps: int, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each unit with ``zs``, the values dealt to it in all replicates, in their order."""
    pairs = nulls.unit_permutation(z.select(*keys, unit, "z"), unit, reps, label, keys, ["z"])
    own = F.transform(F.array_sort(F.collect_list(F.struct("rep", "z"))), lambda e: e["z"])
    return pairs.groupBy(*keys, unit).agg(own.alias("zs"))


def _products(z: DataFrame, edges: DataFrame, unit: str, reps: int, label: str, keys: Sequence[str]) -> DataFrame:
    """For each unit with neighbours ``products``: its dealt value times the mean of its neighbours' dealt values, in every replicate. Neighbours' arrays are
    averaged position by position, so an edge moves one row however many replicates there are."""
    p = settle(permuted(z, unit, reps, label, keys))
    near = edges.join(p.select(*keys, F.col(unit).alias("neighbour"), F.col("zs").alias("__v")), [*keys, "neighbour"])
    around = near.groupBy(*keys, unit).agg(F.collect_list("__v").alias("__a"))  # eight arrays at most on a grid
    total = F.aggregate("__a", F.array_repeat(F.lit(0.0), reps), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    lag = around.select(*keys, unit, total.alias("__t"), F.size("__a").alias("__n"))
    both = p.join(lag, [*keys, unit])
    return both.select(*keys, unit, F.zip_with("zs", "__t", lambda v, t: v * t / F.col("__n")).alias("products"))


def moran_global(cells: DataFrame, edges: DataFrame, unit: str, value: str, reps: int, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row-standardised statistic and its two-sided permutation p about -1/(n-1). Without any neighbours in a group there is no statistic.

    Dealing values out anew changes neither their sum of squares nor who is an island, so only the sum of products is taken for each replicate."""
    keys = list(keys)
    z = settle(standardise(cells, value, keys).select(*keys, unit, "z"))
    obs = _moran(spatial_lag(z, edges, unit, "z", keys), keys)
    squares = z.groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("__ss"))
    sums = _products(z, edges, unit, reps, label, keys).select(*keys, F.posexplode("products").alias("rep", "__p")).groupBy(*keys, "rep").agg(F.sum("__p").alias("__sum"))
    if keys:
        j = sums.join(obs, keys).join(squares, keys)
    else:
        j = sums.withColumns({**{c: obs.select(c).scalar() for c in ("moran_i", "units", "non_islands")}, "__ss": squares.scalar()})
    j = j.withColumn("__sim", F.col("units") / F.col("non_islands") * F.col("__sum") / F.col("__ss"))
    e = -1.0 / (F.col("units") - 1)
    hit = F.abs(F.col("__sim") - e) >= F.abs(F.col("moran_i") - e) - nulls.TIE
    out = j.groupBy(*keys).agg(
        F.max("moran_i").alias("moran_i"), F.max("units").alias("units"), F.max("non_islands").alias("non_islands"),
        F.avg("__sim").alias("permutation_mean"), F.stddev_samp("__sim").alias("permutation_sd"),
        F.count("*").alias("permutations"), F.count_if(hit).alias("__hits"),
    )
    return out.withColumns({
        "expected_i": -1.0 / (F.col("units") - 1), "p": (1 + F.col("__hits")) / (1 + F.col("permutations")),
    }).drop("__hits")


def moran_local(cells: DataFrame, edges: DataFrame, unit: str, value: str, reps: int, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Local statistic, p about the unit's own permutation mean, and cluster label. All replicates of a unit are in its row."""
    keys = list(keys)
    z = settle(standardise(cells, value, keys).select(*keys, unit, "z"))
    obs = spatial_lag(z, edges, unit, "z", keys).withColumn("local_i", F.col("z") * F.col("lag"))
    sim = _products(z, edges, unit, reps, label, keys)
    sim = sim.withColumn("permutation_mean", F.aggregate("products", F.lit(0.0), lambda a, v: a + v) / reps)
    m = F.col("permutation_mean")
    hits = F.size(F.filter("products", lambda v: F.abs(v - m) >= F.abs(F.col("local_i") - m) - nulls.TIE))
    hi_z, hi_l = F.col("z") >= 0, F.col("lag") >= 0
    cluster = (
        F.when(F.col("island"), "island").when(hi_z & hi_l, "high_high").when(~hi_z & ~hi_l, "low_low")
        .when(hi_z & ~hi_l, "high_low").otherwise("low_high")
    )
    return obs.join(sim, [*keys, unit], "left").withColumns(
        {"p": F.when(~F.col("island"), (1 + hits) / (1 + F.lit(reps))), "cluster": cluster}
    ).drop("products")


def nested_hierarchy(cells: DataFrame, x: str, y: str, children: int = 2, grandchildren: int = 4) -> DataFrame:
    """Parents all of whose children are present, with every grandchild index below them."""
    parents = cells.select(
        F.floor(F.col(x) / children).alias("parent_x"), F.floor(F.col(y) / children).alias("parent_y"), x, y
    ).distinct().groupBy("parent_x", "parent_y").agg(F.count("*").alias("k")).where(F.col("k") == children * children)
    steps = F.sequence(F.lit(0), F.lit(grandchildren - 1))
    out = parents.select("parent_x", "parent_y", F.explode(steps).alias("i"))
    out = out.select("parent_x", "parent_y", "i", F.explode(steps).alias("j"))
    half = grandchildren // children
    gx, gy = F.col("parent_x") * grandchildren + F.col("i"), F.col("parent_y") * grandchildren + F.col("j")
    return out.select("parent_x", "parent_y", F.floor(gx / half).alias("child_x"), F.floor(gy / half).alias("child_y"), gx.alias("x"), gy.alias("y"))
