"""Station dictionary and tiered coordinate resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyfloor.functions.geo import haversine
from tallyfloor.operators import ordering
from tallyfloor.operators.ordering import cumulative_counts, quantiles
from tallyfloor.operators.settle import TASK_ROWS

_BUCKETS = 65_536  # hash classes whose sizes bound those of the stations in them


def prepass(obs: DataFrame, keys: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Median place and count per station. Sizes of hash classes of stations, one narrow pass, bound the size of any station. If no
    station can be large, rows move once and each station orders its own; else both coordinates go
    through one tally and medians come from ranges of values, never from one task per station."""
    classes = obs.select(F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).alias("__c")).groupBy("__c").agg(F.count("*").alias("__n"))
    most, rows = classes.agg(F.max("__n"), F.sum("__n")).first()
    if (most or 0) <= ordering.SMALL:
        return _medians_of_small(obs, keys, lat, lon, rows or 0)
    both = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("v")) for i, c in enumerate((lat, lon))])
    long = obs.select(*keys, F.explode(both).alias("e")).select(*keys, "e.axis", "e.v")
    q = quantiles(long, "v", {"m": 0.5}, [*keys, "axis"], rows="rows")
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    return q.groupBy(*keys).agg(pick(0, "rows").alias("observations"), pick(0, "m").alias(lat), pick(1, "m").alias(lon))


def _medians_of_small(obs: DataFrame, keys: list[str], lat: str, lon: str, rows: int) -> DataFrame:
    """Both medians from the two middle rows of each order, all inside one partitioning."""
    x, y = F.col("__x"), F.col("__y")
    held = obs.select(*keys, F.col(lat).cast("double").alias("__x"), F.col(lon).cast("double").alias("__y"))
    held = held.where(x.isNotNull() | y.isNotNull())
    held = held.repartition(max(held.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
    for c, tag in ((x, "x"), (y, "y")):
        order = W.partitionBy(*keys).orderBy(c.asc_nulls_last())
        whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        held = held.withColumns({f"__i{tag}": F.row_number().over(order), f"__n{tag}": F.count(c).over(whole)})

    def middle(c: Column, tag: str) -> Column:
        at, n = F.col(f"__i{tag}"), F.col(f"__n{tag}")
        inner = F.when((2 * at >= n) & (2 * at <= n + 2) & c.isNotNull(), c)  # one row, or two if n is even
        return F.min(inner) * 0.5 + F.max(inner) * 0.5

    return held.groupBy(*keys).agg(
        F.nullif(F.count(x), F.lit(0)).alias("observations"), middle(x, "x").alias(lat), middle(y, "y").alias(lon))


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """First value whose cumulative weight reaches half of the total."""
    c = cumulative_counts(df, value, keys, weight)
    hit = (F.col("n_below") + F.col("n")) >= F.col("total") / 2
    return c.where(hit).groupBy(*keys).agg(F.min(value).alias(value))


def most_common(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """Mode per key; the smallest value wins a tie. Counted by value before values compete."""
    n = F.count("*") if weight is None else F.sum(weight)
    tally = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("__n"))
    return tally.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def unique_alias(dictionary: DataFrame, city: str, name: str, key: str) -> DataFrame:
    """Names that stand for exactly one station key."""
    return (
        dictionary.where(F.col(name).isNotNull())
        .groupBy(city, name)
        .agg(F.min(key).alias("alias_key"), F.max(key).alias("__hi"))
        .where(F.col("alias_key") == F.col("__hi"))
        .drop("__hi")
    )


def movement_episodes(dictionary: DataFrame, keys: list[str], month: str, lat: str, lon: str, threshold: float = 100.0) -> DataFrame:
    """A move of more than ``threshold`` metres between months starts a new episode. A station
    has one row per month, so its window is as long as the calendar."""
    w = W.partitionBy(*keys).orderBy(month)
    moved = haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return dictionary.withColumn("movement_from_previous_m", moved).withColumn(
        "episode_id",
        F.lit(1) + F.sum(F.when(F.col("movement_from_previous_m") > threshold, 1).otherwise(0)).over(w),
    )


def _month_number(c: Column) -> Column:
    return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")


def resolve_by_month(wanted: DataFrame, dictionary: DataFrame, city: str, month: str, key: str) -> DataFrame:
    """Place of each (city, month, key): the same month, else the nearest one, the earlier of
    two equally near. ``wanted`` holds distinct keys, so the join is as small as the dictionary."""
    d = dictionary.select(F.col(city), F.col(key), F.col(month).alias("__m"), "latitude", "longitude")
    gap = F.abs(_month_number(F.col("__m")) - _month_number(F.col(month)))
    best = wanted.join(d, [city, key]).groupBy(city, month, key).agg(
        F.min_by(F.struct("latitude", "longitude", gap.alias("gap")), F.struct(gap, "__m")).alias("b")
    )
    tier = F.when(F.col("b.gap") == 0, "historical_same_month").otherwise("historical_nearest_month")
    return best.select(city, month, key, F.col("b.latitude").alias("latitude"), F.col("b.longitude").alias("longitude"), tier.alias("tier"))


def resolve_stations(rows: DataFrame, dictionary: DataFrame, city: str = "city", month: str = "month") -> DataFrame:
    """Rows with (station_id, name, source_lat, source_lon, non_public) gain place and tier.

    Tiers: source coordinate, key in the same month, key in the nearest month, then the key
    that the name alone stands for. Keys are made distinct before anything is looked up.
    """
    from tallyfloor.functions.cleaning import station_key, valid_coordinate

    ok = valid_coordinate(F.col("source_lat"), F.col("source_lon"))
    rows = rows.withColumn("__open", ~ok & ~F.col("non_public"))
    wanted = rows.where("__open").select(city, month, "station_id", "name").distinct()
    alias = unique_alias(dictionary, city, "name", "station_key")
    keyed = wanted.join(alias, [city, "name"], "left").withColumn(
        "first_key",
        F.coalesce(
            station_key(F.col("station_id"), F.lit(None).cast("string")),
            F.when(F.col("station_id").isNull(), F.coalesce("alias_key", station_key(F.lit(None).cast("string"), F.col("name")))),
        ),
    )
    tries = keyed.select(
        city, month, "station_id", "name",
        F.posexplode(F.array("first_key", "alias_key")).alias("__try", "station_key"),
    ).where(F.col("station_key").isNotNull())
    places = resolve_by_month(tries.select(city, month, "station_key").distinct(), dictionary, city, month, "station_key")
    found = tries.join(places, [city, month, "station_key"]).groupBy(city, month, "station_id", "name").agg(
        F.min_by(F.struct("latitude", "longitude", "tier"), "__try").alias("__p")
    )
    same = lambda a, b: a.eqNullSafe(b)
    f = found.select(*[F.col(c).alias(f"__{c}") for c in (city, month, "station_id", "name")], "__p")
    cond = (
        F.col("__open") & same(F.col(city), F.col(f"__{city}")) & same(F.col(month), F.col(f"__{month}"))
        & same(F.col("station_id"), F.col("__station_id")) & same(F.col("name"), F.col("__name"))
    )
    tier = (
        F.when(F.col("non_public"), "non_public_node").when(~F.col("__open"), "source")
        .otherwise(F.coalesce("__p.tier", F.lit("unresolved")))
    )
    return rows.join(f, cond, "left").withColumns({
        "latitude": F.when(ok, F.col("source_lat")).otherwise(F.col("__p.latitude")),
        "longitude": F.when(ok, F.col("source_lon")).otherwise(F.col("__p.longitude")),
        "coordinate_source": tier,
    }).drop("__open", "__p", *[f"__{c}" for c in (city, month, "station_id", "name")])


def resolve_snapshots(rows: DataFrame, current: DataFrame, archived: DataFrame) -> DataFrame:
    """For a city known by snapshots: current id, current name, archived id, archived name.
    An id that a snapshot repeats takes its least place; a name counts only if it belongs to one station."""
    out = rows
    picks = []
    for label, table in (("current", current), ("archived", archived)):
        tier = f"{label}_snapshot"
        by_id = table.groupBy("station_id").agg(F.min(F.struct("latitude", "longitude", F.lit(tier).alias("tier"))).alias(f"__{label}_id"))
        names = table.where(F.col("name").isNotNull()).groupBy("name").agg(
            F.count_distinct("station_id").alias("__c"), F.min(F.struct("latitude", "longitude", F.lit(tier).alias("tier"))).alias(f"__{label}_name")
        ).where("__c = 1").drop("__c")
        out = out.join(by_id, "station_id", "left").join(names, "name", "left")
        picks += [f"__{label}_id", f"__{label}_name"]
    best = F.coalesce(*picks)
    return out.withColumns({
        "latitude": best["latitude"], "longitude": best["longitude"],
        "coordinate_source": F.coalesce(best["tier"], F.lit("unresolved")),
    }).drop(*picks)
