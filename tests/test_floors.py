"""Floors against published pairs and their own identities."""

import math

import pytest
from pyspark.sql import functions as F

from tallyfloor.functions import bounds, special

# Published (h0, hb, l0, lb) of fourteen specifications.
GOLDEN = [
    (0.7721618382038633, 0.7301647642273128, 0.15349067569914757, 0.1416102460780021),
    (0.6635849437114615, 0.5996926434813296, 0.12367875115014211, 0.10745807538601623),
    (0.6338824458392028, 0.5704866967655446, 0.11602102628796812, 0.10035180827300118),
    (0.7830853092698631, 0.7399280951282149, 0.1566560619911628, 0.1443318255408276),
    (0.7177316421868923, 0.6829491705256481, 0.13817915235876008, 0.1287830880580028),
    (0.2613919034467395, 0.24761918365488106, 0.036305037199123286, 0.033922445987203065),
    (1.293025649450262, 1.1616568735020727, 0.35028608496845137, 0.2898425247221993),
    (0.5730684985833185, 0.5170037907437454, 0.10097236827464436, 0.08782424370840891),
    (1.102594045561725, 0.9863676603752028, 0.2655062593753919, 0.2218793514784166),
    (1.2226903109903482, 1.116267214700558, 0.3167582909277374, 0.2710001130449533),
    (1.5633931730585495, 1.4210637223829337, 0.5113413333194373, 0.41943543558775204),
    (1.331471410576573, 1.1078396750567003, 0.36987526448509583, 0.26760429157122506),
    (1.2254318263483095, 1.0537640535346315, 0.3180127820401734, 0.24653181203106958),
    (1.2250203955238717, 1.056045491524883, 0.31782425585412905, 0.2473966691283038),
]


def test_golden_pairs(spark):
    d = spark.createDataFrame(GOLDEN, "h0 double, hb double, l0 double, lb double")
    worst = d.select(
        F.max(F.abs(bounds.exact_floor("h0") - F.col("l0"))).alias("a"), F.max(F.abs(bounds.exact_floor("hb") - F.col("lb"))).alias("b")).first()
    assert max(worst) < 1e-11


def test_round_trip_and_order(spark):
    d = spark.range(1, 60).select((F.col("id") / 10).alias("h")).withColumn("d", bounds.exact_floor("h"))
    d = d.withColumns({"back": bounds.max_entropy("d"), "closed": bounds.closed_floor(F.col("h"))})
    for r in d.collect():
        assert abs(r.back - r.h) < 2e-9 and r.d >= r.closed - 1e-12


def test_interpolation_error(spark):
    x = spark.range(1, 1500).select((F.col("id") / 200 + 0.0123).alias("h"))
    y = bounds.interp_floor(x, "h", bounds.floor_table(spark), "li").withColumn("le", bounds.exact_floor("h"))
    assert y.select(F.max(F.abs(F.col("li") - F.col("le")) / (1 + F.col("le")))).first()[0] < 1e-6


def test_table_overflow_fails(spark):
    x = spark.createDataFrame([(9.0,)], "h double")
    with pytest.raises(Exception, match="exceeds"):
        bounds.interp_floor(x, "h", bounds.floor_table(spark), "l").collect()


def test_projection_keeps_raw_values(spark):
    d = spark.createDataFrame([(0.5, 0.6), (-0.1, -0.2), (0.5, 0.4), (None, 0.3)], "h0 double, hb double")
    out = bounds.attach_floors(d, "h0", "hb").collect()
    assert out[0].h0_bound == out[0].hb_bound == 0.5 and out[0].hb == 0.6 and out[0].projected
    assert out[1].l0 == out[1].lb == 0 and not out[2].projected and out[3].l0 is None


def test_fano(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (0.4689955935892812,)], "h double").select(bounds.fano_floor("h", 2).alias("e"))
    assert [r.e for r in d.collect()] == pytest.approx([0.0, 0.5, 0.1], abs=1e-12)


def test_special_functions(spark):
    z = spark.createDataFrame([(v,) for v in (0.0, 0.3, 1.96, -2.5, 2.999, 3.0, 8.0)], "z double").select("z", special.normal_tail("z").alias("p"))
    for r in z.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-10)
    x = spark.createDataFrame([(1.0,), (0.5,), (10.0,)], "x double").select(special.digamma(F.col("x")).alias("d"), special.log_factorial(F.col("x")).alias("f")).collect()
    assert x[0].d == pytest.approx(-0.5772156649015329, abs=1e-12) and x[1].d == pytest.approx(-1.9635100260214235, abs=1e-11)
    assert x[2].f == pytest.approx(math.lgamma(11), abs=1e-10)
    t = spark.createDataFrame([(2.0, 1), (2.0, 5), (1.3, 30)], "t double, df int").select(special.t_tail_two_sided("t", "df").alias("p"))
    assert [r.p for r in t.collect()] == pytest.approx([0.29516723530, 0.10193947883, 0.2035009585], abs=1e-9)
    b = spark.createDataFrame([(3, 20), (0, 20), (20, 20)], "k int, n int").select(
        special.binomial_limit("k", "n", 0.05, "low").alias("l"), special.binomial_limit("k", "n", 0.05, "high").alias("h")).collect()
    assert (b[0].l, b[0].h) == pytest.approx((0.032070938, 0.378926810), abs=1e-6)
    assert b[1].l == 0 and b[2].h == 1 and b[1].h == pytest.approx(0.168433, abs=1e-5)
