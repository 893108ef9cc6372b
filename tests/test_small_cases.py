"""Small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfloor.functions import bounds, calendars, cleaning as cl, geo, states
from tallyfloor.operators import information as info, nulls, ordering, panel as pn, resample as rs, spatial as sp, stations as st, summaries as sm


def col(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def take(df, name):
    return [r[name] for r in df.collect()]


def test_count_states(spark):
    d = col(spark, [0, 1, 2, 3, 9, -1, None], "int").select("i", states.count_label(F.col("v")).alias("s")).orderBy("i")
    assert take(d, "s") == ["zero", "one", "two", "three_plus", "three_plus", None, None]


def test_cuts_and_states(spark):
    cuts = info.fit_cuts(col(spark, [float(v) for v in range(7)]), "v", [1 / 3, 2 / 3]).first()["cuts"]
    assert cuts == pytest.approx([2.6667, 4.3333], abs=1e-4)
    arr = F.array(*[F.lit(c) for c in cuts])
    d = col(spark, [0.0, 1.0, 3.0, 5.0, None]).select("i", states.cut_label(F.col("v"), arr).alias("s")).orderBy("i")
    assert take(d, "s") == ["zero", "low", "medium", "high", None]


def test_null_stays_null(spark):
    d = col(spark, [None, -3.0, 2.5]).select(
        "i", states.half_up(F.col("v")).alias("h"), states.class_three(F.col("v")).alias("c"),
        states.top_code(F.col("v"), 2).alias("t"), bounds.closed_floor(F.col("v")).alias("f")).orderBy("i")
    first, low, high = d.collect()
    assert (first.h, first.c, first.t, first.f) == (None, None, None, None)
    assert (low.h, high.h, high.c, high.t) == (0, 3, 2, 2.0)


@pytest.mark.parametrize("informative,cmi", [(True, 1.0), (False, 0.0)])
def test_information_extremes(spark, informative, cmi):
    rows = [(0, i % 2 if informative else 7, i % 2) for i in range(200)]
    counts = info.joint_counts(spark.createDataFrame(rows, "z int, b int, y int"), ["z"], "b", "y")
    r = info.conditional_information(counts, ["z"], "b", "y").first()
    assert (r.h0_plugin, r.cmi_plugin) == pytest.approx((1.0, cmi), abs=1e-12)


def test_support_hand_case(spark):
    rows = [("a", 0, 0), ("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1)]
    counts = info.joint_counts(spark.createDataFrame(rows, "z string, b int, y int"), ["z"], "b", "y")
    r = info.conditional_information(counts, ["z"], "b", "y").first()
    assert (r.side_atoms, r.singleton_atoms, r.nu) == (5, 4, 2)
    assert r.singleton_share == pytest.approx(4 / 6)


def test_panel_and_lags(spark):
    d = dt.date
    rows = [("u", d(2020, 1, 1), 1), ("u", d(2020, 1, 3), 2), ("v", d(2020, 1, 2), 3)]
    dense = pn.densify(spark.createDataFrame(rows, "unit string, period date, y long"), ["unit"], "period", ["y"], "2020-01-01", "2020-01-03")
    out = pn.add_lags(dense, ["unit"], "period", {"y1": ("y", 1)}).orderBy("unit", "period").collect()
    assert [(r.y, r.y1) for r in out] == [(1, None), (0, 1), (2, 0), (0, None), (3, 0), (0, 3)]


def test_unit_without_events(spark):
    d = dt.date
    counts = spark.createDataFrame([("u", d(2020, 1, 2), 4)], "unit string, period date, y long")
    units = spark.createDataFrame([("u",), ("w",)], "unit string")
    dense = pn.densify(counts, ["unit"], "period", ["y"], "2020-01-01", "2020-01-03", units)
    assert sorted((r.unit, r.y) for r in dense.collect()) == [("u", 0), ("u", 0), ("u", 4), ("w", 0), ("w", 0), ("w", 0)]


def test_holidays(spark):
    us = set(take(calendars.holidays(spark, "US", "2020-01-01", "2022-12-31"), "holiday"))
    bc = set(take(calendars.holidays(spark, "BC", "2020-01-01", "2022-12-31"), "holiday"))
    d = dt.date
    assert {d(2021, 7, 4), d(2021, 7, 5), d(2021, 12, 31), d(2022, 6, 20), d(2021, 6, 18)} <= us
    assert d(2020, 6, 19) not in us
    assert {d(2022, 2, 21), d(2022, 7, 1), d(2021, 4, 2), d(2021, 12, 27), d(2021, 12, 28), d(2022, 5, 23)} <= bc
    assert d(2020, 9, 30) not in bc and d(2022, 9, 30) in bc


def test_week_bounds(spark):
    f, l, w = pn.complete_week_bounds(F.lit("2020-01-01").cast("date"), F.lit("2022-12-31").cast("date"))
    r = spark.range(1).select(f.alias("f"), l.alias("l"), w.alias("w")).first()
    assert (str(r.f), str(r.l), r.w) == ("2020-01-06", "2022-12-19", 155)


def test_block_universe(spark):
    days = spark.sql("select explode(sequence(date'2020-01-02', date'2022-12-31')) as period")
    blocks, pmap = rs.block_universe(days, "period", 7)
    assert blocks.count() == 156 and pmap.where("block is null").count() == 1095 - 156 * 7


def test_grid_cells_are_half_open(spark):
    d = col(spark, [0.10, 0.99, 1.00]).select("i", F.floor("v").alias("x")).orderBy("i")
    assert take(d.select("i", geo.grid_key(F.col("x"), F.col("x")).alias("k")), "k") == [0, 0, 10_000_001]


def test_utm_round_trip_and_known_point(spark):
    d = spark.createDataFrame([(-77.0365, 38.8977), (-75.0, 0.0), (-74.0, 40.7)], "lon double, lat double")
    e, n = geo.utm(F.col("lon"), F.col("lat"), 18)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), 18)
    out = d.withColumns({"e": e, "n": n}).withColumns({"lo": lon, "la": lat}).collect()
    for r in out:
        assert (r.lo, r.la) == pytest.approx((r.lon, r.lat), abs=1e-9)
    assert (out[1].e, out[1].n) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert out[0].e == pytest.approx(323394, abs=2) and out[0].n == pytest.approx(4307396, abs=2)


def test_longest_run(spark):
    d = spark.createDataFrame([("u", i, v) for i, v in enumerate([False, True, True, False, True])], "u string, i int, v boolean")
    assert ordering.longest_run(d, ["u"], "i", F.col("v"), "n").first()["n"] == 2


def test_benjamini_hochberg(spark):
    d = ordering.bh_adjust(col(spark, [0.01, 0.04, 0.03, None]), "v", "q").orderBy("i")
    assert take(d, "q") == pytest.approx([0.03, 0.04, 0.04, None])


def test_queen_edges(spark):
    cells = spark.createDataFrame([(i, i, 0) for i in range(3)], "u int, x int, y int")
    assert sorted((r.u, r.neighbour) for r in sp.queen_edges(cells, "u", "x", "y").collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_nested_hierarchy(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)], "x int, y int")
    assert sp.nested_hierarchy(cells, "x", "y").count() == 16


def test_plus_one_p(spark):
    null = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.1)], "rep int, cmi double")
    for value, p in ((0.4, 0.2), (0.2, 0.6)):
        obs = spark.createDataFrame([(value,)], "cmi double")
        assert nulls.null_summary(null, obs, []).first()["p"] == pytest.approx(p)


def test_minimum_effect(spark):
    d = spark.createDataFrame([("a", 0.0, 0.05), ("a", 0.03, 0.5), ("a", 0.06, 0.9)], "k string, e double, r double")
    out = nulls.minimum_effect(d, ["k"], "e", "r").first()
    assert (out.discrete_effect, out.interpolated_effect) == pytest.approx((0.06, 0.0525))


def test_flags(spark):
    d = spark.createDataFrame([(True, True), (False, True), (True, False)], "a boolean, b boolean")
    assert take(d.select(cl.combine_flags({"first": F.col("a"), "second": F.col("b")}).alias("f")), "f") == ["first|second", "second", "first"]


def test_modal_error(spark):
    train = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "s int, y int")
    test = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (0, 0)], "s int, y int")
    r = sm.modal_error(train, test, ["s"], "y").first()
    assert (r.test_error, r.unseen) == (0.25, 1)


def test_station_tiers(spark):
    d = spark.createDataFrame(
        [("c", "2020-01", "I:1", "one", 1.0, 1.0), ("c", "2020-05", "I:1", "one", 5.0, 5.0), ("c", "2020-03", "N:two", "two", 3.0, 3.0)],
        "city string, month string, station_key string, name string, latitude double, longitude double")
    rows = spark.createDataFrame(
        [(1, "c", "2020-01", "1", None, None, None, False), (2, "c", "2020-03", "1", None, None, None, False),
         (3, "c", "2020-04", "1", None, None, None, False), (4, "c", "2020-04", None, "two", None, None, False),
         (5, "c", "2020-04", "9", None, None, None, False), (6, "c", "2020-04", "1", None, 8.0, 8.0, False),
         (7, "c", "2020-04", "SYS1", None, None, None, True), (8, "c", "2020-01", "9", "one", None, None, False)],
        "i int, city string, month string, station_id string, name string, source_lat double, source_lon double, non_public boolean")
    out = {r.i: (r.latitude, r.coordinate_source) for r in st.resolve_stations(rows, d).collect()}
    assert out[1] == (1.0, "historical_same_month")
    assert out[2] == (1.0, "historical_nearest_month")  # both two months away: the earlier one
    assert out[3] == (5.0, "historical_nearest_month")
    assert out[4] == (3.0, "historical_nearest_month")
    assert out[5] == (None, "unresolved") and out[6] == (8.0, "source") and out[7] == (None, "non_public_node")
    assert out[8] == (1.0, "historical_same_month")  # unknown id, but the name stands for one key


def test_snapshot_tiers(spark):
    cur = spark.createDataFrame([("1", "a", 1.0, 1.0), ("2", "b", 2.0, 2.0), ("3", "b", 3.0, 3.0)], "station_id string, name string, latitude double, longitude double")
    old = spark.createDataFrame([("4", "c", 4.0, 4.0)], "station_id string, name string, latitude double, longitude double")
    rows = spark.createDataFrame([("1", "x"), (None, "a"), (None, "b"), ("4", "x"), (None, "c")], "station_id string, name string")
    out = {(r.station_id, r.name): (r.latitude, r.coordinate_source) for r in st.resolve_snapshots(rows, cur, old).collect()}
    assert out[("1", "x")] == (1.0, "current_snapshot") and out[(None, "a")] == (1.0, "current_snapshot")
    assert out[(None, "b")] == (None, "unresolved")
    assert out[("4", "x")] == (4.0, "archived_snapshot") and out[(None, "c")] == (4.0, "archived_snapshot")


def test_names_fold_to_plain_text(spark):
    d = spark.createDataFrame([("Ｃafé  “X”",), ("Plain—Name",), (None,), ("Straße",)], "t string")
    assert take(cl.norm_names(d, "t", "n"), "n") and set(take(cl.norm_names(d, "t", "n"), "n")) == {'café "x"', "plain-name", None, "strasse"}


def test_shared_token_columns(spark):
    from tallyfloor.operators.audit import shared_token_columns

    a, b = spark.range(1).selectExpr("1 as start_lat", "2 as z", "3 as Member_Type"), spark.range(1).selectExpr("1 as start_lat", "3 as Member_Type", "4 as lat2")
    assert shared_token_columns([a, b], ["LAT", "type"]) == ["Member_Type", "start_lat"]
