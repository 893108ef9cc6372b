"""Models and regressions against an independent fit in numpy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfloor.operators import boosting, forecast as fc, regression as rg


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(2)
    n = 1500
    u, d = rng.integers(0, 6, n), rng.integers(0, 3, n)
    mu = np.exp(-0.5 + 0.25 * u - 0.3 * d)
    pdf = pd.DataFrame({"u": u, "d": d, "y": rng.poisson(mu)})
    return pdf, spark.createDataFrame(pdf)


def _gradient(pdf, model, features, l2, dispersion):
    tables = {f: dict(model.tables[f].select(f, f"b_{f}").collect()) for f in features}
    eta = model.intercept + sum(pdf[f].map(tables[f]) for f in features)
    mu = np.exp(eta)
    score = (pdf.y - mu) if dispersion is None else (pdf.y - mu) / (1 + dispersion * mu)
    grads = [score.sum() / len(pdf)]
    for f in features:
        for level, b in tables[f].items():
            grads.append(score[pdf[f] == level].sum() / len(pdf) - l2 * b)
    return np.abs(grads).max()


@pytest.mark.parametrize("dispersion", [None, 0.5])
def test_log_linear_reaches_the_optimum(counts, dispersion):
    pdf, df = counts
    model = fc.fit_log_linear(fc.cells(df, ["u", "d"], "y"), ["u", "d"], 0.01, dispersion)
    assert _gradient(pdf, model, ["u", "d"], 0.01, dispersion) < 1e-7
    new = df.limit(1).withColumn("u", F.lit(99).cast("long"))
    assert model.predict(new).first()["prediction"] > 0


def test_grid_equals_single_fits(counts):
    pdf, df = counts
    settings = [fc.Ridge(0.01), fc.Ridge(1.0), fc.Ridge(0.01, 0.5)]
    models = fc.fit_log_linear_grid(fc.cells(df, ["u", "d"], "y"), ["u", "d"], settings)
    for s, model in zip(settings, models):
        assert _gradient(pdf, model, ["u", "d"], s.l2, s.dispersion) < 1e-7


def test_tuning_takes_the_best_candidate(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 2)], "u string, y long")
    constant = lambda v: lambda frame: frame.withColumn("prediction", F.lit(v))
    got = fc.tune({"x": [constant(1.0), constant(2.0), constant(2.2)], "y": [constant(0.0)]}, rows, ["u"], "y").collect()
    assert {(r["family"], r["candidate"]): (r["n"], r["mse_integer"], r["mae_integer"], r["selected"]) for r in got} == {
        ("x", 0): (4, 1.5, 1.0, False), ("x", 1): (4, 0.5, 0.5, True), ("x", 2): (4, 0.5, 0.5, False), ("y", 0): (4, 4.5, 2.0, True)}


def plain_trees(rows, features, learning_rate, leaves, l2, rounds, least_rows):
    """Boosted trees by their definition, row by row; gives the linear predictor of each row."""
    eta = [np.log(np.mean([r["y"] for r in rows]))] * len(rows)

    def sums(own):
        return sum(np.exp(eta[i]) - rows[i]["y"] for i in own), sum(np.exp(eta[i]) for i in own), len(own)

    def split(own):
        G, H, N = sums(own)
        best = None
        for f in features:
            levels = {v: sums([i for i in own if rows[i][f] == v]) for v in sorted({rows[i][f] for i in own})}
            used = sorted((v for v, (g, h, n) in levels.items() if h * N / H >= 10), key=lambda v: levels[v][0] / (levels[v][1] + 10))
            for run in (used, used[::-1]):
                for k in range(1, len(run) + 1):
                    g, h, n = (sum(levels[v][j] for v in run[:k]) for j in range(3))
                    if n < least_rows or N - n < least_rows:
                        continue
                    gain = g * g / (h + l2) + (G - g) ** 2 / (H - h + l2) - G * G / (H + l2)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-10):
                        best = (gain, f, set(run[:k]))
        return best

    for _ in range(rounds):
        open_leaves = [(list(range(len(rows))), split(list(range(len(rows)))))]
        while len(open_leaves) < leaves and any(s for _, s in open_leaves):
            k = max((i for i, (_, s) in enumerate(open_leaves) if s), key=lambda i: open_leaves[i][1][0])
            own, (_, f, left) = open_leaves.pop(k)
            for side in ([i for i in own if rows[i][f] in left], [i for i in own if rows[i][f] not in left]):
                open_leaves.append((side, split(side)))
        moves = {}
        for own, _ in open_leaves:
            g, h, _ = sums(own)
            moves.update(dict.fromkeys(own, -learning_rate * g / (h + l2)))
        eta = [e + moves[i] for i, e in enumerate(eta)]
    return eta


@pytest.fixture(scope="module")
def categories(spark):
    rng = np.random.default_rng(12)
    n = 700
    pdf = pd.DataFrame({"u": rng.integers(0, 9, n), "d": rng.integers(0, 4, n), "z": rng.integers(0, 3, n)})
    pdf["y"] = rng.poisson(np.exp(0.2 + 0.3 * ((pdf.u * 5) % 9 > 4) - 0.4 * (pdf.d == 2) * (pdf.z > 0) + 0.2 * pdf.z))
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("task_cells", [boosting.TASK_CELLS, 30])
def test_boosting_equals_its_definition(categories, task_cells):
    """Also with cells in several tasks, which exchange histograms."""
    pdf, df = categories
    features = ["u", "d", "z"]
    settings = [boosting.Setting(0.1, 6, 1.0), boosting.Setting(0.3, 4, 10.0)]
    model = boosting.fit(fc.cells(df, features, "y"), features, settings, 5, 20.0, task_cells)
    for k, s in enumerate(settings):
        want = np.exp(plain_trees(pdf.to_dict("records"), features, s.learning_rate, s.leaves, s.l2, 5, 20))
        got = model.predict(df, setting=k).select(*features, "prediction").toPandas()
        own = pdf.assign(want=want).groupby(features).want.first()
        assert np.allclose(got.set_index(features).prediction, own.loc[list(got[features].itertuples(index=False, name=None))], rtol=1e-9)
        assert all(len(r) <= 2 * s.leaves - 1 for r in model.trees[k].values())


def test_boosting_of_many_levels_and_unseen_ones(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CODES", 8)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"u": [f"u{i}" for i in rng.integers(0, 60, 3000)]})
    pdf["y"] = rng.poisson(np.exp(pdf.u.str[1:].astype(int) / 30))
    df = spark.createDataFrame(pdf)
    model = boosting.fit(fc.cells(df, ["u"], "y"), ["u"], [boosting.Setting(0.1, 15, 1.0)], 40)
    assert model.sizes[0] <= 8
    p = model.predict(df).toPandas()
    loss = lambda m: (m - p.y * np.log(m)).mean()
    assert loss(p.prediction) < loss(pd.Series(p.y.mean(), index=p.index)) - 0.1
    new = spark.createDataFrame([("never",), (None,)], "u string")
    assert all(r["prediction"] > 0 for r in model.predict(new).collect())


def test_boosting_of_nothing(spark):
    empty = spark.createDataFrame([], "u string, cell_n long, cell_sum double")
    model = boosting.fit(empty, ["u"], [boosting.Setting(0.1, 15, 1.0)], 3)
    assert model.predict(empty).count() == 0


def test_state_mean_backs_off(spark):
    train = spark.createDataFrame([("a", 0, 0), ("a", 0, 2), ("b", 0, 4)], "unit string, s int, y int")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 0)], "unit string, s int")
    out = fc.state_mean(fc.cells(train, ["unit", "s"], "y"), rows, "unit", ["s"], 0.0).collect()
    assert {(r.unit, r.s): r.prediction for r in out} == {("a", 1): 1.0, ("b", 1): 4.0, ("c", 1): 2.0, ("a", 0): 1.0}


def test_group_effects_hc3(spark):
    rng = np.random.default_rng(4)
    g, x = rng.integers(0, 4, 120), rng.normal(size=120)
    y = 0.7 * x + g + rng.normal(size=120) * (1 + np.abs(x))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    r = rg.ols_group_effects(df, "y", "x", "g").first()
    m = np.column_stack([x] + [(g == k).astype(float) for k in range(4)])
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    e = y - m @ b
    lev = np.einsum("ij,jk,ik->i", m, inv, m)
    cov = inv @ (m.T @ (((e / (1 - lev)) ** 2)[:, None] * m)) @ inv
    assert (r.slope, r.hc3_se) == pytest.approx((b[0], np.sqrt(cov[0, 0])))
    assert r.r_squared == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) and r.df == 115


def test_clustered(spark):
    rng = np.random.default_rng(6)
    n = 200
    c, a, b2 = rng.integers(0, 20, n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    x = rng.normal(size=n)
    y = 1.5 * x + a - b2 + rng.normal(size=20)[c] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"c": c, "a": a, "b": b2, "x": x, "y": y}))
    r = rg.ols_clustered(df, "y", ["x"], {"a": [0, 1, 2], "b": [0, 1]}, "c").first()
    m = np.column_stack([np.ones(n), x, a == 1, a == 2, b2 == 1]).astype(float)
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    e = y - m @ beta
    s = np.array([(m[c == k] * e[c == k, None]).sum(0) for k in range(20)])
    cov = inv @ (s.T @ s) @ inv * 20 / 19 * (n - 1) / (n - 5)
    assert (r.coefficient, r.clustered_se) == pytest.approx((beta[1], np.sqrt(cov[1, 1])))
    assert r.clusters == 20


def test_tuning_prefers_the_earlier_of_equals(spark):
    rng = random.Random(1)
    rows = [(u, rng.randint(0, 1), 3) for u in range(4) for _ in range(20)]
    df = spark.createDataFrame(rows, "unit int, s int, y int")
    out = fc.tune_state_mean(df, df, "unit", ["s"], "y", [0.0, 5.0]).where("selected").collect()
    assert [r.smoothing for r in out] == [0.0]


def test_spearman_interval(spark):
    from tallyfloor.operators.summaries import spearman_interval

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 60)
    pdf = pd.DataFrame({"u": range(60), "x": x, "y": x + rng.integers(0, 15, 60)})
    df = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([(90, None, 1), (91, 2, None)], "u long, x long, y long")
    got = spearman_interval(df.unionByName(odd), "u", "x", "y", 120, "rho").first()
    rho = np.corrcoef(pdf.x.rank(), pdf.y.rank())[0, 1]
    assert got["units"] == 60 and got["rho"] == pytest.approx(rho) and got["finite_replicates"] == 120
    assert got["ci_low"] < rho < got["ci_high"] and 0 < got["se"] < 0.3 and 0 < got["p"] < 0.01
    with pytest.raises(Exception, match="too few"):
        spearman_interval(df.limit(2), "u", "x", "y", 120, "rho").collect()
