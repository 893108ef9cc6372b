"""Forecasts, their comparison with the floors, and specification matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.catalog.resampling import P_OR, orders_prepared
from tallyfloor.functions import bounds
from tallyfloor.functions.states import class_binary
from tallyfloor.operators.settle import settle
from tallyfloor.operators import boosting, classification as cl, forecast as fc, information as info, ordering, panel as pn, regression as rg, resample as rs, summaries as sm

SM = 5.0


def split_rows(spark, sf):
    """Train, validation, test and everything before the test window, from one written table."""
    p = settle(prepared(spark, sf))
    return p.where("split = 'train'"), p.where("split = 'validation'"), p.where("split = 'test'"), p.where("split <> 'test'")


def _sql_mean(tag, train, states, k=SM):
    st = ", ".join(states)
    on = lambda a: " AND ".join(f"{a}.{c}=t.{c}" for c in ["unit"] + states)
    return f"""
{tag}_c AS (SELECT unit, {st}, COUNT(*) AS n, SUM(y) AS s FROM prep WHERE {train} GROUP BY unit, {st}),
{tag}_u AS (SELECT unit, AVG(y) AS m FROM prep WHERE {train} GROUP BY unit), {tag}_a AS (SELECT AVG(y) AS m FROM prep WHERE {train}),
{tag} AS (SELECT t.*, GREATEST(0, COALESCE((c.s + {k}e0*COALESCE(u.m,a.m))/(c.n+{k}e0), u.m, a.m)) AS p FROM prep t CROSS JOIN {tag}_a a LEFT JOIN {tag}_c c ON {on('c')} LEFT JOIN {tag}_u u ON u.unit=t.unit)
"""


def means(spark, sf, rows=None):
    """Test rows with both state-mean forecasts and their errors."""
    _, _, test, pre = rows or split_rows(spark, sf)
    out = test
    for tag, st in (("0", ["zl"]), ("1", ["zl", "b"])):
        out = fc.score(fc.state_mean(fc.cells(pre, ["unit", *st], "y"), out, "unit", st, SM, f"p{tag}"), "y", f"p{tag}", tag)
    return out


M0, M1 = _sql_mean("m0", "split<>'test'", ["zl"]), _sql_mean("m1", "split<>'test'", ["zl", "b"])
PAIR = "pr AS (SELECT m0.unit, m0.period, m0.pos, m0.block, m0.y, m0.p AS p0, m1.p AS p1, floor(m0.p+0.5) AS k0, floor(m1.p+0.5) AS k1, (m0.y-floor(m0.p+0.5))*(m0.y-floor(m0.p+0.5)) AS e0, (m1.y-floor(m1.p+0.5))*(m1.y-floor(m1.p+0.5)) AS e1 FROM m0 JOIN m1 USING (unit, period) WHERE m0.split='test')"


@register("k01_state_mean", cte(*PREP, M1) + f"SELECT unit, CAST(period AS VARCHAR) AS period, y, {r('p','prediction')} FROM m1 WHERE split='test'")
def _(spark, sf):
    _, _, test, pre = split_rows(spark, sf)
    return fc.state_mean(fc.cells(pre, ["unit", "zl", "b"], "y"), test, "unit", ["zl", "b"], SM).select("unit", "period", "y", "prediction")


@register("k17_score_frame", cte(*PREP, M1) + f"SELECT unit, CAST(period AS VARCHAR) AS period, CAST(floor(p+0.5) AS BIGINT) AS integer, {r('(y-floor(p+0.5))*(y-floor(p+0.5))','squared_error_integer')}, {r('abs(y-floor(p+0.5))','absolute_error_integer')}, {r('(y-p)*(y-p)','squared_error_continuous')} FROM m1 WHERE split='test'")
def _(spark, sf):
    _, _, test, pre = split_rows(spark, sf)
    p = fc.state_mean(fc.cells(pre, ["unit", "zl", "b"], "y"), test, "unit", ["zl", "b"], SM)
    return fc.score(p, "y", "prediction").select("unit", "period", "integer", "squared_error_integer", "absolute_error_integer", "squared_error_continuous")


@register("k05_seasonal_lag", cte(P_EV) + f"SELECT COUNT(*) AS n, {r('AVG((y-y7)*(y-y7))','mse')} FROM (SELECT y, LAG(y,7) OVER (PARTITION BY unit ORDER BY period) AS y7 FROM panel) WHERE y7 IS NOT NULL")
def _(spark, sf):
    p = fc.seasonal_lag(events_panel(spark, sf), ["unit"], "period", "y").where("prediction IS NOT NULL")
    return p.agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("prediction")) ** 2).alias("mse"))


_CAND = (0.0, 5.0, 20.0, 100.0)


@register("k06_tune_state_mean", cte(*PREP, *[_sql_mean(f"c{i}", "split='train'", ["zl", "b"], k) for i, k in enumerate(_CAND)],
    "al AS (" + " UNION ALL ".join(f"SELECT {i} AS candidate, {k}e0 AS smoothing, AVG((y-floor(p+0.5))*(y-floor(p+0.5))) AS mi, AVG((y-p)*(y-p)) AS mc FROM c{i} WHERE split='validation'" for i, k in enumerate(_CAND)) + ")")
    + f"SELECT CAST(candidate AS BIGINT) AS candidate, smoothing, {r('mi','mse_integer')}, {r('mc','mse_continuous')}, ROW_NUMBER() OVER (ORDER BY ROUND(mi,12), ROUND(mc,12), candidate)=1 AS selected FROM al")
def _(spark, sf):
    train, valid, _, _ = split_rows(spark, sf)
    return fc.tune_state_mean(train, valid, "unit", ["zl", "b"], "y", _CAND)


_TW = f"tw AS (SELECT rep, ({sql_draw(repr('test'), 'rep', 'j')}) % 2 + 3 AS block, COUNT(*) AS w FROM range(1,41) a(rep), range(2) b(j) GROUP BY ALL)"


def test_weights(spark):
    return rs.block_weights(spark, 2, 40, "test", 3)


@register("k07_paired_contrast", cte(*PREP, M0, M1, PAIR, _TW, "bs AS (SELECT rep, SUM((e0-e1)*w)/SUM(w) AS d FROM pr JOIN tw USING (block) GROUP BY rep)") + f"SELECT {r('(SELECT AVG(e0-e1) FROM pr)','point')}, {r('STDDEV_SAMP(d)','se')}, {r('AVG(CASE WHEN d<=0 THEN 1e0 ELSE 0e0 END)','nonpositive_share')} FROM bs")
def _(spark, sf):
    return contrast(spark, sf).select("point", "se", "nonpositive_share")


def contrast(spark, sf):
    p = settle(means(spark, sf).select("block", (F.col("squared_error_integer0") - F.col("squared_error_integer1")).alias("d")))
    point = p.agg(F.avg("d").alias("d"))
    reps = rs.bootstrap_losses(rs.loss_blocks(p, {"d": "d"}), test_weights(spark), ["d"], rows=80)
    return rs.normal_interval(point, reps, [], "d")


@register("k08_per_category", """
WITH c AS (SELECT user_id AS unit, event_type AS category, CAST(ts AS DATE) AS period, COUNT(*) AS y FROM events GROUP BY ALL),
cal AS (SELECT CAST(d AS DATE) AS period FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d)),
p AS (SELECT u.unit, u.category, cal.period, COALESCE(y,0) AS y FROM (SELECT DISTINCT unit, category FROM c) u CROSS JOIN cal LEFT JOIN c ON c.unit=u.unit AND c.category=u.category AND c.period=cal.period),
g AS (SELECT *, LAG(y) OVER (PARTITION BY unit, category ORDER BY period) AS y1, isodow(period)-1 AS dow FROM p),
prep AS (SELECT *, LEAST(y1, 3) AS zl FROM g WHERE y1 IS NOT NULL),""" + sql_info("prep", ["category"], ["dow"], "zl", "y") + f" SELECT category, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')} FROM i")
def _(spark, sf):
    from tallyfloor.functions.calendars import day_of_week
    from tallyfloor.functions.states import count_code

    ev = read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("category"), F.to_date("ts").alias("period"))
    d = pn.densify(pn.period_counts(ev, ["unit", "category", "period"], {"y": F.lit(True)}), ["unit", "category"], "period", ["y"], EV_START, EV_END)
    d = pn.add_lags(d, ["unit", "category"], "period", {"y1": ("y", 1)}).where("y1 IS NOT NULL").withColumns({"zl": count_code(F.col("y1")), "dow": day_of_week(F.col("period"))})
    return info.conditional_information(info.joint_counts(d, ["dow"], "zl", "y", ["category"]), ["dow"], "zl", "y", ["category"]).select("category", "n", "h0", "hb", "cmi")


@register("k09_rolling_months", cte(P_OR, """
t AS (SELECT unit, zl, strftime(period,'%Y-%m') AS month, COUNT(*) AS n, SUM(y) AS s, SUM(y*y) AS ss FROM oprep GROUP BY ALL),
c AS (SELECT *, SUM(n) OVER w AS nc, SUM(s) OVER w AS sc FROM t WINDOW w AS (PARTITION BY unit, zl ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT unit, month, SUM(n) OVER w AS nu, SUM(s) OVER w AS su FROM (SELECT unit, month, SUM(n) AS n, SUM(s) AS s FROM t GROUP BY ALL) WINDOW w AS (PARTITION BY unit ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT month, SUM(n) OVER w AS na, SUM(s) OVER w AS sa FROM (SELECT month, SUM(n) AS n, SUM(s) AS s FROM t GROUP BY ALL) WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT c.*, COALESCE((sc + 5e0*COALESCE(su/nu,sa/na))/(nc+5e0), COALESCE(su/nu,sa/na)) AS p FROM c JOIN u USING (unit, month) JOIN a USING (month))
""") + f"SELECT month, CAST(SUM(n) AS BIGINT) AS n, {r('SUM(ss-2*p*s+n*p*p)/SUM(n)','mse_continuous')}, {r('SUM(ss-2*floor(p+0.5)*s+n*floor(p+0.5)*floor(p+0.5))/SUM(n)','mse_integer')} FROM p WHERE p IS NOT NULL GROUP BY month")
def _(spark, sf):
    return fc.rolling_state_mean(orders_prepared(spark, sf), "unit", ["zl"], "period", "y", 5.0)


LT = (*PREP, "pre AS (SELECT * FROM prep WHERE split<>'test')", sql_info("pre", ["unit"], ["zl"], "b", "y"), M0, M1, PAIR,
      f"fl AS (SELECT unit, {sql_floor('GREATEST(h0,0)')} AS l0, {sql_floor('LEAST(GREATEST(hb,0),GREATEST(h0,0))')} AS lb FROM i)",
      "lt AS (SELECT unit, unit%7 AS grp, ANY_VALUE(l0-lb) AS delta_l, AVG(e0-e1) AS delta_mse FROM fl JOIN pr USING (unit) GROUP BY unit)")


def local_theory(spark, sf):
    rows = split_rows(spark, sf)
    pre = rows[3]
    c = info.conditional_information(info.joint_counts(pre, ["zl"], "b", "y", ["unit"]), ["zl"], "b", "y", ["unit"])
    floors = bounds.attach_floors(c.select("unit", "h0", "hb"), "h0", "hb").select("unit", "delta_l")
    gains = means(spark, sf, rows).groupBy("unit").agg(F.avg(F.col("squared_error_integer0") - F.col("squared_error_integer1")).alias("delta_mse"))
    return floors.join(gains, "unit").withColumn("grp", F.col("unit") % 7)


@register("k10_local_theory_practice", cte(*LT, "md AS (SELECT median(delta_l) AS a, median(delta_mse) AS b FROM lt)") + f"SELECT unit, {r('delta_l','delta_l')}, {r('delta_mse','delta_mse')} FROM lt, md")
def _(spark, sf):
    return local_theory(spark, sf).select("unit", "delta_l", "delta_mse")


@register("k10_local_classes", cte(*LT, "md AS (SELECT median(ROUND(delta_l,9)) AS a, median(ROUND(delta_mse,9)) AS b FROM lt)") + "SELECT CASE WHEN ROUND(delta_l,9)>a THEN 'high_theory' ELSE 'low_theory' END || '__' || CASE WHEN ROUND(delta_mse,9)>b THEN 'high_empirical' ELSE 'low_empirical' END AS median_class, COUNT(*) AS units FROM lt, md GROUP BY 1")
def _(spark, sf):
    t = local_theory(spark, sf).withColumns({"delta_l": F.round("delta_l", 9), "delta_mse": F.round("delta_mse", 9)})
    t = ordering.median_classes(t, "delta_l", "delta_mse")
    return t.groupBy("median_class").agg(F.count("*").alias("units"))


@register("d08_theory_to_practice", cte(*PREP, sql_info("prep", ["split"], ["zl"], "b", "y"), "er AS (SELECT split, dow, AVG((y-zl)*(y-zl)) AS mse FROM prep GROUP BY ALL)") + f"SELECT split, CAST(dow AS BIGINT) AS dow, {r('cmi','cmi')}, {r('mse','mse')} FROM i JOIN er USING (split)")
def _(spark, sf):
    p = prepared(spark, sf)
    theory = info.conditional_information(info.joint_counts(p, ["zl"], "b", "y", ["split"]), ["zl"], "b", "y", ["split"]).select("split", "cmi")
    return p.groupBy("split", "dow").agg(F.avg((F.col("y") - F.col("zl")) ** 2).alias("mse")).join(theory, "split")


@register("d09_replicates_to_observed", cte(*PREP, M0, M1, PAIR, _TW, "bs AS (SELECT rep, SUM((e0-e1)*w)/SUM(w) AS d FROM pr JOIN tw USING (block) GROUP BY rep)", "o AS (SELECT AVG(e0-e1) AS d FROM pr)") + "SELECT COUNT(*) AS replicates, COUNT(*) FILTER (WHERE bs.d >= o.d - 1e-12) AS exceed FROM bs, o")
def _(spark, sf):
    from tallyfloor.operators.nulls import TIE

    p = settle(means(spark, sf).select("block", (F.col("squared_error_integer0") - F.col("squared_error_integer1")).alias("d")))
    reps = rs.bootstrap_losses(rs.loss_blocks(p, {"d": "d"}), test_weights(spark), ["d"], rows=80)
    return reps.withColumn("o", p.agg(F.avg("d")).scalar()).agg(F.count("*").alias("replicates"), F.count_if(F.col("d") >= F.col("o") - TIE).alias("exceed"))


_OLS = """
d AS (SELECT c_nationkey AS g, CAST(o_orderkey%100 AS DOUBLE) AS x, o_totalprice/1000 + (o_orderkey%100)*0.3e0 AS y FROM orders JOIN customer ON o_custkey=c_custkey),
q AS (SELECT *, x-AVG(x) OVER (PARTITION BY g) AS u, y-AVG(y) OVER (PARTITION BY g) AS v, COUNT(*) OVER (PARTITION BY g) AS ng, AVG(y) OVER () AS my FROM d),
s AS (SELECT SUM(u*u) AS sxx, SUM(u*v)/SUM(u*u) AS b FROM q),
e AS (SELECT *, v-b*u AS res, 1-(1e0/ng+u*u/sxx) AS lev FROM q, s)
"""


@register("k11_group_effects", cte(_OLS) + f"SELECT COUNT(*) AS observations, {r('MAX(b)','slope')}, {r('sqrt(SUM(u*u*(res/lev)*(res/lev))/(MAX(sxx)*MAX(sxx)))','hc3_se')}, {r('1-SUM(res*res)/SUM((y-my)*(y-my))','r_squared')}, COUNT(DISTINCT g) AS groups, COUNT(*)-COUNT(DISTINCT g)-1 AS df FROM e")
def _(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("x", (F.col("o_orderkey") % 100).cast("double")).withColumn("y", F.col("o_totalprice") / 1000 + F.col("x") * 0.3)
    return rg.ols_group_effects(o, "y", "x", "g").select("observations", "slope", "hc3_se", "r_squared", "groups", "df")


@register("k11_theory_regression")
def _(spark, sf):
    return rg.ols_group_effects(settle(local_theory(spark, sf)), "delta_mse", "delta_l", "grp")


@register("k12_clustered")
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") % 100).alias("x1"), (F.col("o_orderkey") % 37).alias("x2"))
    effects = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    return rg.ols_clustered(o, "y", ["x1", "x2"], effects, "o_custkey")


def spec_list():
    split = lambda s: F.col("split") == s
    return {
        "base": {"base": ["dow", "zl"], "side": "b", "target": "y"},
        "unit": {"base": ["unit", "zl"], "side": "b", "target": "y"},
        "no_calendar": {"base": ["zl"], "side": "b", "target": "y"},
        "binary_target": {"base": ["dow", "zl"], "side": "b", "target": "occurs"},
        "train_only": {"base": ["dow", "zl"], "side": "b", "target": "y", "where": split("train")},
        "coarse_lag": {"base": ["dow", "z2"], "side": "b", "target": "y"},
    }


def spec_rows(spark, sf):
    return prepared(spark, sf).withColumns({"occurs": class_binary(F.col("y")), "z2": F.least("zl", F.lit(1)), "grp": F.col("unit") % 5})


_SPEC = "pv AS (SELECT *, CAST(y>0 AS BIGINT) AS occurs, LEAST(zl,1) AS z2, unit%5 AS grp FROM prep)"
_SPECS_SQL = {"base": ("pv", "dow,zl", "y"), "unit": ("pv", "unit,zl", "y"), "no_calendar": ("pv", "zl", "y"), "binary_target": ("pv", "dow,zl", "occurs"), "train_only": ("(SELECT * FROM pv WHERE split='train')", "dow,zl", "y"), "coarse_lag": ("pv", "dow,z2", "y")}


def _sql_specs(specs):
    return [sql_info(src, [], cols.split(","), "b", y, "1", f"q{i}") for i, (src, cols, y) in enumerate(specs.values())]


def _sql_spec_rows(specs):
    return " UNION ALL ".join(f"SELECT '{k}' AS spec, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')}, {r('cmi_plugin','cmi_plugin')} FROM q{i}" for i, k in enumerate(specs))


@register("k13_specifications", cte(*PREP, _SPEC, *_sql_specs(_SPECS_SQL)) + _sql_spec_rows(_SPECS_SQL))
def _(spark, sf):
    counts = rg.spec_counts(spec_rows(spark, sf), spec_list())
    return info.conditional_information(counts, ["z"], "b", "y", ["spec"]).select("spec", "n", "h0", "hb", "cmi", "cmi_plugin")


@register("k13_three_estimators")
def _(spark, sf):
    return rg.run_specs(spec_rows(spark, sf), spec_list()).select("spec", "n", "cmi_plugin", "cmi", "cmi_jeffreys")


_MATRIX = [(d, p) for d in ("all", "covered") for p in ("pooled", "train", "test")]


@register("k14_domain_period_matrix", cte(*PREP, *[sql_info(f"(SELECT * FROM prep WHERE {'TRUE' if d == 'all' else 'unit%3>0'} AND {'TRUE' if p == 'pooled' else chr(39).join(['split=', p, ''])})", [], ["dow", "zl"], "b", "y", "1", f"q{i}") for i, (d, p) in enumerate(_MATRIX)])
    + " UNION ALL ".join(f"SELECT '{d}_{p}' AS spec, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')} FROM q{i}" for i, (d, p) in enumerate(_MATRIX)))
def _(spark, sf):
    specs = {}
    for d, p in _MATRIX:
        keep = F.lit(True) if d == "all" else F.col("unit") % 3 > 0
        specs[f"{d}_{p}"] = {"base": ["dow", "zl"], "side": "b", "target": "y", "where": keep if p == "pooled" else keep & (F.col("split") == p)}
    counts = rg.spec_counts(prepared(spark, sf), specs)
    return info.conditional_information(counts, ["z"], "b", "y", ["spec"]).select("spec", "n", "h0", "hb", "cmi")


_MAP = {"by_unit": ("pv", "unit,zl", "y"), "by_group": ("pv", "grp,zl", "y"), "by_weekend": ("(SELECT *, dow>=5 AS we FROM pv)", "we,zl", "y")}


@register("k16_mapping_variants", cte(*PREP, _SPEC, *_sql_specs(_MAP)) + _sql_spec_rows(_MAP))
def _(spark, sf):
    rows = spec_rows(spark, sf).withColumn("we", F.col("dow") >= 5)
    specs = {"by_unit": ["unit", "zl"], "by_group": ["grp", "zl"], "by_weekend": ["we", "zl"]}
    counts = rg.spec_counts(rows, {k: {"base": v, "side": "b", "target": "y"} for k, v in specs.items()})
    return info.conditional_information(counts, ["z"], "b", "y", ["spec"]).select("spec", "n", "h0", "hb", "cmi", "cmi_plugin")


@register("k15_floor_comparison", cte(*PREP, _SPEC, sql_info("pv", ["split"], ["dow", "zl"], "b", "y"), sql_info("pv", ["split"], ["dow", "zl"], "b", "occurs", "1", "o")) + f"SELECT i.split, {r(sql_floor('i.h0'),'mse_floor_base')}, {r(sql_floor('i.hb'),'mse_floor_side')}, {r('o.h0','class_entropy_base')}, {r('o.hb','class_entropy_side')}, false AS comparable FROM i JOIN o USING (split)")
def _(spark, sf):
    rows = spec_rows(spark, sf)
    one = lambda t: info.conditional_information(info.joint_counts(rows, ["dow", "zl"], "b", t, ["split"]), ["dow", "zl"], "b", t, ["split"])
    a = one("y").withColumns({"mse_floor_base": bounds.exact_floor("h0"), "mse_floor_side": bounds.exact_floor("hb")}).select("split", "mse_floor_base", "mse_floor_side")
    b = one("occurs").select("split", F.col("h0").alias("class_entropy_base"), F.col("hb").alias("class_entropy_side"))
    return a.join(b, "split").withColumn("comparable", F.lit(False))


@register("k15_error_rate_floors")
def _(spark, sf):
    rows = spec_rows(spark, sf).withColumn("c", class_binary(F.col("y")))
    h = info.conditional_information(info.joint_counts(rows.where("split <> 'test'"), ["dow", "zl"], "b", "c"), ["dow", "zl"], "b", "c")
    out = h.select(bounds.fano_floor("h0", 2).alias("floor_base"), bounds.fano_floor("hb", 2).alias("floor_side"))
    err = sm.modal_error(rows.where("split <> 'test'"), rows.where("split = 'test'"), ["dow", "zl", "b"], "c")
    return out.withColumns({"test_error": err.select("test_error").scalar(), "unseen": err.select("unseen").scalar()})


_CB = f"""
wa AS (SELECT rep, ({sql_draw(repr('train'), 'rep', 'j')}) % 3 AS block, COUNT(*) AS w FROM range(1,21) a(rep), range(3) b(j) GROUP BY ALL),
rp AS (SELECT i AS rep FROM range(1,21) t(i)),
tr AS (SELECT rep, zl, b, LEAST(y,2) AS c, SUM(w) AS n FROM (SELECT prep.*, rep, w FROM prep JOIN wa ON wa.block=pos//7 WHERE pos<21 UNION ALL SELECT prep.*, rep, 1 FROM prep, rp WHERE pos BETWEEN 21 AND 23) GROUP BY ALL),
"""


@register("h13_classification_bootstrap", cte(*PREP) .rstrip() + "," + _CB.strip() + f"""
md AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rep, zl, b ORDER BY n DESC, c) AS k FROM tr),
gl AS (SELECT rep, c, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY SUM(n) DESC, c) AS k FROM tr GROUP BY rep, c),
te AS (SELECT prep.*, rp.rep, LEAST(y,2) AS cy FROM prep, rp WHERE split='test'),
z AS (SELECT te.rep, AVG(CASE WHEN COALESCE(md.c, gl.c)<>cy THEN 1e0 ELSE 0e0 END) AS e, COUNT(*) AS n, COUNT(*) FILTER (WHERE md.c IS NULL) AS unseen FROM te JOIN gl ON gl.rep=te.rep AND gl.k=1 LEFT JOIN md ON md.rep=te.rep AND md.zl=te.zl AND md.b=te.b AND md.k=1 GROUP BY te.rep)
SELECT rep, n AS test_rows, {r('e','test_error')}, unseen, {r('unseen*1e0/n','unseen_share')} FROM z""")
def _(spark, sf):
    from tallyfloor.functions.states import class_three

    p = prepared(spark, sf).withColumn("c", class_three(F.col("y")))
    pre = p.where("split <> 'test'").groupBy(F.floor(F.col("pos") / 7).cast("int").alias("block"), "zl", "b", "c").agg(F.count("*").alias("m"))
    w = rs.block_weights(spark, 3, 20, "train")
    reps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")))
    moved = pre.where("block < 3").join(F.broadcast(w), "block").select("rep", "zl", "b", "c", (F.col("m") * F.col("w")).alias("w"))  # 20 x 3 rows
    fixed = pre.where("block = 3").select(reps.alias("rep"), "zl", "b", "c", F.col("m").alias("w"))
    test = p.where("split = 'test'").groupBy("zl", "b", "c").agg(F.count("*").alias("w")).select(reps.alias("rep"), "zl", "b", "c", "w")
    return sm.modal_error(moved.unionByName(fixed), test, ["zl", "b"], "c", "w", ["rep"]).drop("train_error")


_FANO_STEP = f"(lo+{(1 - 1 / 3) / 2!r}e0*pow(0.5e0,i))"
_FANO = lambda h: (
    f"CASE WHEN {h} <= 0 THEN 0e0 WHEN {h} >= log2(3e0) THEN {1 - 1 / 3!r}e0 ELSE list_reduce([CAST(q AS DOUBLE) FOR q IN range(54)], lambda lo, i: "
    f"CASE WHEN -{_FANO_STEP}*log2({_FANO_STEP}) - (1-{_FANO_STEP})*log2(1-{_FANO_STEP}) + {_FANO_STEP} <= {h} THEN {_FANO_STEP} ELSE lo END, 0e0) END")


def _sql_classes(tag, weighted):
    """CTEs: train and test counts of each replicate (one numbered 0 without weights), and from them errors and entropies by information set."""
    if weighted:
        head = f"""
{tag}wa AS (SELECT rep, ({sql_draw(repr('train'), 'rep', 'j')}) % 3 AS block, COUNT(*) AS w FROM range(1,21) a(rep), range(3) b(j) GROUP BY ALL),
{tag}we AS (SELECT rep, ({sql_draw(repr('test13'), 'rep', 'j')}) % 2 AS block, COUNT(*) AS w FROM range(1,21) a(rep), range(2) b(j) GROUP BY ALL),
{tag}tr AS (SELECT rep, zl, b, LEAST(y,2) AS c, SUM(w) AS n FROM (SELECT zl, b, y, rep, w FROM prep JOIN {tag}wa q ON q.block=pos//7 WHERE pos<21 UNION ALL SELECT zl, b, y, rep, 1 FROM prep, range(1,21) a(rep) WHERE pos BETWEEN 21 AND 23) GROUP BY ALL),
{tag}te AS (SELECT rep, zl, b, LEAST(y,2) AS c, SUM(w) AS n FROM (SELECT zl, b, y, rep, w FROM prep JOIN {tag}we q ON q.block=(pos-24)//2 WHERE pos BETWEEN 24 AND 27 UNION ALL SELECT zl, b, y, rep, 1 FROM prep, range(1,21) a(rep) WHERE pos > 27) GROUP BY ALL)"""
    else:
        head = f"""
{tag}tr AS (SELECT 0 AS rep, zl, b, LEAST(y,2) AS c, COUNT(*) AS n FROM prep WHERE pos < 24 GROUP BY ALL), {tag}te AS (SELECT 0 AS rep, zl, b, LEAST(y,2) AS c, COUNT(*) AS n FROM prep WHERE pos >= 24 GROUP BY ALL)"""
    parts = [head, sql_info(f"{tag}tr", ["rep"], ["zl"], "b", "c", "n", f"{tag}i"),
             f"{tag}gl AS (SELECT rep, c FROM (SELECT rep, c, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY SUM(n) DESC, c) AS k FROM {tag}tr GROUP BY rep, c) WHERE k=1)"]
    for name, st in (("baseline", "zl"), ("side_aware", "zl, b")):
        q = tag + name[0]
        parts.append(f"""
{q}s AS (SELECT rep, {st}, c, SUM(n) AS n FROM {tag}tr GROUP BY ALL), {q}t AS (SELECT rep, {st}, c, SUM(n) AS n FROM {tag}te GROUP BY ALL),
{q}m AS (SELECT * FROM (SELECT *, SUM(n) OVER (PARTITION BY rep, {st}) AS total, ROW_NUMBER() OVER (PARTITION BY rep, {st} ORDER BY n DESC, c) AS k FROM {q}s) WHERE k=1),
{q}f AS (SELECT rep, 1 - SUM(n)*1e0/SUM(total) AS train_error FROM {q}m GROUP BY rep),
{q}e AS (SELECT t.rep, SUM(CASE WHEN COALESCE(m.c, g.c)<>t.c THEN t.n ELSE 0 END)*1e0/SUM(t.n) AS test_error, SUM(CASE WHEN m.c IS NULL THEN t.n ELSE 0 END) AS unseen
  FROM {q}t t JOIN {tag}gl g ON g.rep=t.rep LEFT JOIN {q}m m ON m.rep=t.rep AND {' AND '.join(f'm.{c}=t.{c}' for c in st.split(', '))} GROUP BY t.rep)""")
    rows = " UNION ALL ".join(
        f"SELECT rep, '{name}' AS information_set, '{kind}' AS estimator, {h} AS entropy, {_FANO(h)} AS floor, train_error, test_error, unseen FROM {tag}i JOIN {tag}{name[0]}f USING (rep) JOIN {tag}{name[0]}e USING (rep)"
        for name, kind, h in (("baseline", "plugin", "h0_plugin"), ("baseline", "miller_madow", "h0"), ("side_aware", "plugin", "hb_plugin"), ("side_aware", "miller_madow", "hb")))
    return (*parts, f"{tag}z AS ({rows})")


def class_counts(spark, sf):
    """Counts of states and class by block, before the test days (weeks) and in them (two days each); what fills no block has none."""
    from tallyfloor.functions.states import class_three

    p = prepared(spark, sf).withColumn("c", class_three(F.col("y")))
    week, pair = F.floor(F.col("pos") / 7).cast("int"), F.floor((F.col("pos") - 24) / 2).cast("int")
    p = p.withColumn("block", F.when(F.col("pos") < 21, week).when((F.col("pos") >= 24) & (F.col("pos") < 28), pair))
    n = settle(p.groupBy("split", "block", "zl", "b", "c").agg(F.count("*").alias("n")))
    return n.where("split <> 'test'").drop("split"), n.where("split = 'test'").drop("split")


def class_replicates(spark, counts):
    return cl.classification_bootstrap(*counts, rs.block_weights(spark, 3, 20, "train"), rs.block_weights(spark, 2, 20, "test13"), 20, ["zl"], "b", "c", 3)


@register("h13_fano_bootstrap", cte(*PREP, *_sql_classes("w", True)) + f"SELECT rep, information_set, estimator, {r('entropy','entropy')}, {r('floor','floor')}, {r('train_error','train_error')}, {r('test_error','test_error')}, {big('unseen','unseen')}, test_error + 1e-12 < floor AS violation FROM wz")
def _(spark, sf):
    return class_replicates(spark, class_counts(spark, sf))


_CONTRAST = lambda tag: f"{tag}c AS (SELECT rep, estimator, metric, value FROM (SELECT rep, estimator, " + ", ".join(
    f"MAX({m}) FILTER (WHERE information_set='baseline') - MAX({m}) FILTER (WHERE information_set='side_aware') AS {m}" for m in cl.METRICS) + f" FROM {tag}z GROUP BY ALL) UNPIVOT (value FOR metric IN ({', '.join(cl.METRICS)})))"


@register("h13_fano_contrasts", cte(*PREP, *_sql_classes("w", True), *_sql_classes("p", False), _CONTRAST("w"), _CONTRAST("p"), "q AS (SELECT estimator, metric, AVG(value) AS m, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM wc GROUP BY ALL)")
    + f"SELECT estimator, metric, {r('value','point')}, {r('value+lo-m','ci_low')}, {r('value+hi-m','ci_high')} FROM pc JOIN q USING (estimator, metric)")
def _(spark, sf):
    counts = class_counts(spark, sf)
    return cl.contrast_intervals(cl.classification_point(*counts, ["zl"], "b", "c", 3), class_replicates(spark, counts))


# --- model families -----------------------------------------------------------------------
FEATURES = ["unit", "dow", "zl", "b"]


def family(spark, sf, fit):
    _, _, test, pre = split_rows(spark, sf)
    model = fit(fc.cells(pre, FEATURES, "y"))
    p = fc.score(model(test), "y", "prediction")
    return sm.forecast_metrics(p, "y", "prediction", "integer", ["split"])


@register("k02_poisson_glm")
def _(spark, sf):
    return family(spark, sf, lambda c: fc.fit_log_linear(c, FEATURES, 0.001).predict)


@register("k03_negative_binomial")
def _(spark, sf):
    return family(spark, sf, lambda c: fc.fit_log_linear(c, FEATURES, 1e-5, dispersion=0.5).predict)


@register("k04_boosted_poisson")
def _(spark, sf):
    return family(spark, sf, lambda c: boosting.fit(c, FEATURES, [boosting.Setting(0.1, 31, 10.0)]).predict)


# Candidate settings of the four families: fixed values.
SMOOTHING = (0.0, 5.0, 20.0, 100.0)
RIDGES = (0.0001, 0.001, 0.01, 0.1, 1.0)
DISPERSIONS, NB_RIDGE = (0.1, 0.5, 1.0, 2.0), 1e-5
TREES = (boosting.Setting(0.05, 15, 1.0), boosting.Setting(0.05, 31, 10.0), boosting.Setting(0.1, 15, 10.0), boosting.Setting(0.1, 31, 10.0))
CANDIDATES = {
    "state_mean": SMOOTHING, "poisson_glm": [fc.Ridge(a) for a in RIDGES],
    "negative_binomial_glm": [fc.Ridge(NB_RIDGE, d) for d in DISPERSIONS], "boosted_poisson": TREES,
}
INFORMATION = {"baseline": ["unit", "dow", "zl"], "side_aware": FEATURES}


def fit_families(df, features, candidates, rounds=250):
    """Predictors of every candidate of every family, fitted to the same cells; log-linear models of both families in one grid."""
    cell = settle(fc.cells(df, features, "y"))
    states = [f for f in features if f != "unit"]
    out = {name: [] for name in candidates}
    out["state_mean"] = [lambda rows, k=k: fc.state_mean(cell, rows, "unit", states, k) for k in candidates["state_mean"]]
    grid = [(name, c) for name in ("poisson_glm", "negative_binomial_glm") for c in candidates[name]]
    for (name, _), model in zip(grid, fc.fit_log_linear_grid(cell, features, [c for _, c in grid], 1e-6)):
        out[name].append(model.predict)
    trees = boosting.fit(cell, features, candidates["boosted_poisson"], rounds)
    out["boosted_poisson"] = [lambda rows, k=k: trees.predict(rows, setting=k) for k in range(len(candidates["boosted_poisson"]))]
    return out


def tuned_families(rows):
    """Validation errors of all candidates with both information sets (train only)."""
    train, valid, _, _ = rows
    parts = [fc.tune(fit_families(train, f, CANDIDATES), valid, f, "y").withColumn("information_set", F.lit(name)) for name, f in INFORMATION.items()]
    return settle(parts[0].unionByName(parts[1]))


@register("k06_tune_families")
def _(spark, sf):
    return tuned_families(split_rows(spark, sf)).select("family", "information_set", "candidate", "n", "mse_integer", "mse_continuous", "mae_integer", "selected")


@register("k07_family_contrasts")
def _(spark, sf):
    """Each family tuned on validation rows, fitted again with them and scored once on the test rows, with and without the side
    state: the paired gain with its bootstrap interval, and q over the families."""
    rows = split_rows(spark, sf)
    _, _, test, pre = rows
    chosen = {(r["family"], r["information_set"]): r["candidate"] for r in tuned_families(rows).where("selected").collect()}  # 4 families x 2 sets
    fitted = {
        name: fit_families(pre, f, {fam: [c[chosen[fam, name]]] for fam, c in CANDIDATES.items()}) for name, f in INFORMATION.items()
    }
    parts = []
    for fam in CANDIDATES:
        p = test
        for name, tag in (("baseline", "0"), ("side_aware", "1")):
            p = fc.score(fitted[name][fam][0](p).withColumnRenamed("prediction", f"p{tag}"), "y", f"p{tag}", tag)
        parts.append(p.select(
            F.lit(fam).alias("family"), "block", F.col("squared_error_integer0").alias("e0"), F.col("squared_error_integer1").alias("e1"),
            (F.col("squared_error_integer0") - F.col("squared_error_integer1")).alias("d")))
    losses = settle(reduce(lambda a, b: a.unionByName(b), parts))
    point = losses.groupBy("family").agg(F.count("*").alias("n"), F.avg("e0").alias("mse_baseline"), F.avg("e1").alias("mse_side_aware"), F.avg("d").alias("d"))
    reps = rs.bootstrap_losses(rs.loss_blocks(losses, {"d": "d"}, ["family"]), test_weights(spark), ["d"], ["family"], rows=80)
    interval = ordering.bh_adjust(rs.normal_interval(point, reps, ["family"], "d"), "p_greater", "q")
    return point.drop("d").join(interval, "family").select(
        "family", "n", "mse_baseline", "mse_side_aware", "point", "se", "ci_low", "ci_high", "nonpositive_share", "p_greater", "q")
