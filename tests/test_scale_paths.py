"""The paths that only large groups take, forced on small fixtures and checked by brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfloor.operators import nulls, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest spread over many."""
    rng = random.Random(3)
    rows = [("a" if i % 5 else "b", 7.0 if i % 3 == 0 else round(rng.gauss(5, 4), 2), i) for i in range(4000)]
    return pd.DataFrame(rows, columns=["g", "v", "i"]), spark.createDataFrame(rows, "g string, v double, i int")


@pytest.mark.parametrize("small", [0, None])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_cumulative_counts(skewed, keys, small):
    pdf, df = skewed
    out = ordering.cumulative_counts(df, "v", keys, small=small).toPandas()
    group = pdf.assign(g="all") if not keys else pdf
    for _, r in out.iterrows():
        v = group[group.g == (r.g if keys else "all")].v
        assert (r.n, r.n_below, r.total) == ((v == r.v).sum(), (v < r.v).sum(), len(v))
    assert out.n.sum() == len(pdf)


@pytest.mark.parametrize("small", [0, None])
def test_quantiles(skewed, small):
    pdf, df = skewed
    out = ordering.quantiles(df, "v", {"p": 0.37, "m": 0.5}, ["g"], small=small).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g, "p"] == pytest.approx(np.quantile(part.v, 0.37))
        assert out.loc[g, "m"] == pytest.approx(np.median(part.v))


def test_row_ranks_split_ties(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(ordering, "SMALL", 0)
    out = ordering.row_ranks(df, "v", "i", "r", ["g"]).toPandas()
    for g, part in out.groupby("g"):
        want = pdf[pdf.g == g].sort_values(["v", "i"]).i.tolist()
        assert part.sort_values("r").i.tolist() == want and sorted(part.r.tolist()) == list(range(1, len(part) + 1))


@pytest.mark.parametrize("small", [0, 10**6])
def test_bh_by_family(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    rng = random.Random(5)
    rows = [(i % 3, i, rng.choice([1.0, round(rng.random() ** 3, 4)])) for i in range(900)]
    out = ordering.bh_adjust(spark.createDataFrame(rows, "f int, i int, p double"), "p", "q", ["f"]).toPandas()
    for _, part in out.groupby("f"):
        part = part.sort_values("p")
        raw = part.p.to_numpy() * len(part) / np.arange(1, len(part) + 1)
        want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
        assert part.q.to_numpy() == pytest.approx(want)


def test_median_classes_and_top_share(skewed):
    pdf, df = skewed
    out = ordering.median_classes(df.withColumn("w", F.col("i").cast("double")), "v", "w").toPandas()
    assert (out.median_class.str.startswith("high_theory") == (out.v > pdf.v.median())).all()
    pos = df.withColumn("n", F.abs("v"))
    top = np.sort(pdf.v.abs())[::-1]
    k = int(np.ceil(len(top) * 0.1))
    assert ordering.top_share(pos, "n", 0.1).first()["top_share"] == pytest.approx(top[:k].sum() / top.sum())


# --- surrogates keep what they must -------------------------------------------------------
@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(11)
    rows = [(u, t, rng.randint(0, 1), rng.choice([0, 0, 1, 2, 3]), rng.randint(0, 2)) for u in range(6) for t in range(38)]
    return spark.createDataFrame(rows, "unit int, t int, z int, b int, y int")


def _margins(df, cols):
    """Rows for each combination; a table of counts has them in ``n``."""
    n = F.sum("n") if "n" in df.columns else F.count("*")
    return {tuple(r[c] for c in cols): r["n"] for r in df.groupBy(*cols).agg(n.alias("n")).collect()}


@pytest.mark.parametrize("design", ["temporal", "circular", "series", "state"])
def test_margins_are_kept(spark, panel, design):
    series = nulls.unit_series(panel, ["unit"], "t", ["z"], "b", "y")
    if design == "temporal":
        out = nulls.temporal_blocks(series, "unit", 3, 7, "x", ["unit"], ["z"])
    elif design == "circular":
        out = nulls.circular_shift(series, "unit", 3, 4, "x", ["unit"], ["z"])
    elif design == "series":
        out = nulls.series_permutation(series, "unit", 3, "x", ["unit"], ["z"])
    else:
        out = nulls.state_matched(panel, ["unit", "t"], 3, "x", [], ["z"], "b", "y")
    for rep in (1, 2, 3):
        part = out.where(F.col("rep") == rep)
        assert sum(_margins(part, ["z"]).values()) == panel.count()
        assert _margins(part, ["z", "y"]) == _margins(panel, ["z", "y"])
        if design in ("temporal", "circular"):
            assert _margins(part, ["unit", "b"]) == _margins(panel, ["unit", "b"])
        if design == "state":
            assert _margins(part, ["z", "b"]) == _margins(panel, ["z", "b"])
        assert _margins(part, ["b"]) == _margins(panel, ["b"])


def test_state_matched_by_buckets(spark, panel):
    """One bucket for all draws, some, and more buckets than rows give the same counts."""
    one, some, many = (nulls.state_matched(panel, ["unit", "t"], 2, "x", [], ["z"], "b", "y", bits) for bits in (0, 3, 16))
    want = _margins(one, ["rep", "z", "b", "y"])
    assert want == _margins(some, ["rep", "z", "b", "y"]) == _margins(many, ["rep", "z", "b", "y"])


def test_short_series_is_an_error(spark, panel):
    series = nulls.unit_series(panel, ["unit"], "t", ["z"], "b", "y")
    with pytest.raises(Exception, match="too short"):
        nulls.circular_shift(series, "unit", 1, 19, "x", ["unit"], ["z"]).collect()


def test_temporal_remainder_stays(spark, panel):
    series = nulls.unit_series(panel, ["unit"], "t", ["z"], "b", "y", ["t"])
    out = nulls.temporal_blocks(series, "unit", 1, 7, "x", ["unit"], ["z", "t"])
    tail = out.where("t >= 35").join(panel.select("unit", "t", F.col("b").alias("own")), ["unit", "t"])
    assert tail.where("b <> own").count() == 0 and tail.count() == 18
    moved = out.where("t < 35").join(panel.select("unit", "t", F.col("b").alias("own")), ["unit", "t"])
    assert moved.where("b <> own").count() > 0


def test_replicated_rows_are_dealt_by_their_number(spark, monkeypatch):
    """A few rows that become many are dealt to as many tasks as the rows they become need, and are not put together again."""
    from tallyfloor.operators import resample, settle, summaries

    monkeypatch.setattr(settle, "TASK_ROWS", 500)
    counts = spark.createDataFrame([(u, z, b, y, k, 1 + (u * z + y) % 3) for u in range(5) for z in range(2) for b in range(2) for y in range(3) for k in range(4)],
                                   "unit int, z int, b int, y int, block int, n long")
    seen = []
    spread = settle.spread

    def watched(df, rows, *keys):
        out = spread(df, rows, *keys)
        seen.append((rows, out.rdd.getNumPartitions()))
        return out

    for module in (resample, summaries, nulls):
        monkeypatch.setattr(module, "spread", watched)
    weights = resample.block_weights(spark, 4, 30, "t")
    m = weights.groupBy("block").count().toPandas().set_index("block")["count"]
    want = 2 * sum(int(m.get(k, 0)) for k in range(4)) * 60
    out = resample.bootstrap_information(counts, weights, ["z"], "b", "y", ["unit"], 120).toPandas()
    assert seen == [(want, -(-want // 500))] and len(out) == 150
    seen.clear()
    units = spark.createDataFrame([(i, i % 7, i % 5) for i in range(40)], "unit int, x int, y int")
    assert summaries.spearman_bootstrap(units, "unit", "x", "y", 60, "t").count() == 60
    assert seen == [(2400, 5), (2400, 5)]
    seen.clear()
    series = spark.createDataFrame([(u, [{"zl": p % 2, "b": p % 3, "y": p % 4} for p in range(20)], 20) for u in range(6)],
                                   "unit int, s array<struct<zl:int,b:int,y:int>>, t int")
    rows = nulls.surrogate_rows(series, 10)
    dealt = nulls.temporal_blocks(series, "unit", 10, 7, "t", ["unit"], ["zl"], rows)
    once = nulls.temporal_blocks(series, "unit", 10, 7, "t", ["unit"], ["zl"])
    assert rows == 1200 and seen[0] == (1200, 3) and sorted(dealt.collect()) == sorted(once.collect())
    a, b = (nulls.series_permutation(series, "unit", 10, "t", ["unit"], ["zl"], rows=r) for r in (rows, None))
    assert seen[-1] == (1200, 3) and sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("small", [0, None])
def test_station_medians(spark, monkeypatch, small):
    """Both ways give the medians; small stations move once and nothing is tallied or written before."""
    from tallyfloor.operators import stations

    if small is not None:
        monkeypatch.setattr(ordering, "SMALL", small)
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.randrange(40), rng.choice([None, round(rng.gauss(0, 3), 1)]), rng.choice([None, round(rng.gauss(0, 9), 2), float(rng.randrange(3))])) for _ in range(700)]
    rows += [("d", 1, None, None), ("d", 2, None, 4.0), ("d", 2, None, 1.0)]
    out = stations.prepass(spark.createDataFrame(rows, "city string, k int, latitude double, longitude double"), ["city", "k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert small == 0 or plan.count("Exchange hashpartitioning") == 1
    got = {(r["city"], r["k"]): (r["observations"], r["latitude"], r["longitude"]) for r in out.collect()}
    want = {}
    for c, k, a, b in rows:
        if a is not None or b is not None:
            e = want.setdefault((c, k), ([], []))
            e[0].extend([a] * (a is not None))
            e[1].extend([b] * (b is not None))
    assert set(got) == set(want)
    for key, (a, b) in want.items():
        n, la, lo = got[key]
        assert n == (len(a) or None)
        assert la == (pytest.approx(float(np.median(a))) if a else None) and lo == (pytest.approx(float(np.median(b))) if b else None)


def test_names_are_read_once(spark):
    """Rows with and without non-ASCII letters come from one reading of their source."""
    from tallyfloor.functions import cleaning

    d = spark.createDataFrame([(1, "Ab  C"), (2, "Straße"), (3, "ﬁn “X”"), (4, ""), (5, None), (6, "café ")], "id int, t string")
    out = cleaning.norm_names(d, "t", "n")
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == ["id", "t", "n"]
    assert {r["id"]: r["n"] for r in out.collect()} == {1: "ab c", 2: "strasse", 3: 'fin "x"', 4: None, 5: None, 6: "café"}


def test_long_model_tables_stay_out_of_the_driver(spark, monkeypatch):
    """Coefficients, codes and cells of many units are joined by shuffles, however small their files are."""
    from tallyfloor.operators import boosting, forecast

    monkeypatch.setattr(forecast, "SMALL_LEVELS", 0)
    monkeypatch.setattr(boosting, "LONG", 0)
    rows = spark.createDataFrame([(u, z, 1 + (u + z * k) % 3) for u in range(12) for z in range(3) for k in range(4)], "unit int, zl int, y int")
    cell = forecast.settle(forecast.cells(rows, ["unit", "zl"], "y"))
    model = forecast.LogLinear(["unit"], 0.5, {"unit": forecast.settle(cell.select("unit").distinct().selectExpr("unit", "unit / 10D AS b_unit"))}, {"unit": 12})
    codes = boosting.code_tables(cell, ["unit"])
    for out in (model.predict(rows), forecast.state_mean(cell, rows, "unit", ["zl"], 5.0), boosting.encode(rows, codes)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert out.count() == 144
    assert model.predict(rows).where("unit = 7").first()["prediction"] == pytest.approx(np.exp(1.2))
