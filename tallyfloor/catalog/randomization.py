"""Randomization references and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.catalog.core import _DIG
from tallyfloor.catalog.resampling import P_OR, orders_prepared
from tallyfloor.functions import bounds
from tallyfloor.functions.draws import draw
from tallyfloor.operators import information as info, nulls, ordering, spatial as sp
from tallyfloor.operators.settle import settle

R = 12
B = ["dow", "zl"]


def rows_once(spark, sf):
    """The prepared rows as a written table, for queries that read them several times."""
    return settle(prepared(spark, sf).select("unit", "period", "pos", *B, "b", "y"))


def observed(p):
    return info.conditional_information(info.joint_counts(p, B, "b", "y"), B, "b", "y")


REP = f"rp AS (SELECT i AS rep FROM range(1,{R + 1}) t(i))"
T_SQL = f"""
bo AS (SELECT rep, unit, i, ROW_NUMBER() OVER (PARTITION BY rep, unit ORDER BY {sql_draw("'temporal'", "rep", "unit", "i")}, i) - 1 AS slot FROM rp, (SELECT DISTINCT unit FROM prep) u, range(4) k(i)),
tn AS (SELECT rp.rep, a.unit, a.dow, a.zl, a.y, d.b FROM prep a, rp LEFT JOIN bo ON bo.rep=rp.rep AND bo.unit=a.unit AND bo.slot=a.pos//7
 JOIN prep d ON d.unit=a.unit AND d.pos = CASE WHEN a.pos < 28 THEN bo.i*7 + a.pos%7 ELSE a.pos END)
"""
C_SQL = f"tn AS (SELECT rp.rep, a.unit, a.dow, a.zl, a.y, d.b FROM prep a, rp, prep d WHERE d.unit=a.unit AND d.pos = (a.pos + 5 + {sql_draw("'circular'", 'rp.rep', 'a.unit')} % 20) % 29)"
S_SQL = f"""
u AS (SELECT DISTINCT unit FROM prep), ur AS (SELECT unit, ROW_NUMBER() OVER (ORDER BY unit) AS k FROM u),
dr AS (SELECT rep, unit AS donor, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY {sql_draw("'series'", "rep", "unit")}, unit) AS k FROM u, rp),
tn AS (SELECT dr.rep, a.unit, a.dow, a.zl, a.y, d.b FROM prep a JOIN ur USING (unit) JOIN dr USING (k) JOIN prep d ON d.unit=dr.donor AND d.pos=a.pos)
"""
G_SQL = f"""
bk0 AS (SELECT unit, block, MIN(period) AS d, SUM(zl)/7e0 + 0.25e0*SUM(CASE WHEN dow=0 THEN 1 ELSE 0 END) AS score FROM prep WHERE pos<28 GROUP BY ALL),
bk1 AS (SELECT *, year(d) AS yr, (month(d)%12)//3 AS season FROM bk0),
bk2 AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY unit, yr, season) >= 3 THEN season ELSE 9 END AS g FROM bk1),
bk AS (SELECT *, COUNT(*) OVER w AS n, ROW_NUMBER() OVER (PARTITION BY unit, yr, g ORDER BY ROUND(score,9), block) - 1 AS rnk FROM bk2 WINDOW w AS (PARTITION BY unit, yr, g)),
mv AS (SELECT rp.rep, a.unit, a.block, CASE WHEN a.n>=3 THEN d.block ELSE a.block END AS donor FROM bk a, rp JOIN bk d ON d.unit=a.unit AND d.yr=a.yr AND d.g=a.g
  AND d.rnk = CASE WHEN a.n>=3 THEN (a.rnk - 1 - ({sql_draw("'matched'", 'rp.rep', 'a.unit', 'a.yr', 'a.g')} % (a.n-1)) + 2*a.n) % a.n ELSE a.rnk END),
tn AS (SELECT rp.rep, a.unit, a.dow, a.zl, a.y, d.b FROM prep a, rp LEFT JOIN mv ON mv.rep=rp.rep AND mv.unit=a.unit AND mv.block=a.block AND a.pos<28
 JOIN prep d ON d.unit=a.unit AND d.pos = CASE WHEN a.pos<28 THEN mv.donor*7 + a.pos%7 ELSE a.pos END)
"""
M_SQL = f"""
ra AS (SELECT dow, zl, y, ROW_NUMBER() OVER (PARTITION BY dow, zl ORDER BY y, unit, period) AS k FROM prep),
rb AS (SELECT rep, dow, zl, b, ROW_NUMBER() OVER (PARTITION BY rep, dow, zl ORDER BY {sql_draw("'state'", "rep", "unit", "pos")}, unit, pos) AS k FROM prep, rp),
tn AS (SELECT rb.rep, rb.dow, rb.zl, rb.b, ra.y FROM rb JOIN ra USING (dow, zl, k))
"""
DESIGNS = {"temporal": T_SQL, "circular": C_SQL, "series": S_SQL, "matched": G_SQL, "state": M_SQL}


def surrogate(p, design, keys=()):
    s = nulls.unit_series(p, ["unit"], "period", B, "b", "y")
    if design == "temporal":
        return nulls.temporal_blocks(s, "unit", R, 7, "temporal", keys, B)
    if design == "circular":
        return nulls.circular_shift(s, "unit", R, 5, "circular", keys, B)
    if design == "series":
        return nulls.series_permutation(s, "unit", R, "series", keys, B)
    if design == "matched":
        strata = nulls.block_strata(p.withColumn("hol", F.col("dow") == 0), "unit", "pos", "period", "zl", "hol", 7, 3)
        return nulls.matched_blocks(s, strata, "unit", R, 7, "matched", keys, B)
    return nulls.state_matched(p.select("unit", "pos", *B, "b", "y"), ["unit", "pos"], R, "state", keys, B, "b", "y")


_CNT = "SELECT rep, CAST(dow AS BIGINT) AS dow, CAST(zl AS BIGINT) AS zl, CAST(b AS BIGINT) AS b, y, COUNT(*) AS n FROM tn GROUP BY ALL"
for _i, (_name, _key) in enumerate([("temporal", "i01_temporal_blocks"), ("series", "i02_series_permutation"), ("circular", "i03_circular_shift"), ("matched", "i04_matched_blocks"), ("state", "i05_state_matched")]):

    def _q(spark, sf, d=_name):
        moved = surrogate(prepared(spark, sf), d)
        return moved if d == "state" else moved.groupBy("rep", *B, "b", "y").agg(F.count("*").alias("n"))  # the last design counts itself

    register(_key, cte(*PREP, REP, DESIGNS[_name]) + _CNT)(_q)


def null_all(p):
    """All three designs go through one set of counts."""
    out = None
    for d in ("temporal", "series", "circular"):
        n = surrogate(p, d).groupBy("rep", *B, "b", "y").agg(F.count("*").alias("n")).withColumn("design", F.lit(d))
        out = n if out is None else out.unionByName(n)
    null = nulls.null_information(out, B, ["design"], counted=True)
    return null.withColumn("cmi", observed(p).select("h0").scalar() - F.col("hb"))


def _sql_null(design, tag):
    return DESIGNS[design].replace("tn AS", f"{tag}_tn AS").replace("bo AS", f"{tag}_bo AS").replace("JOIN bo ON", f"JOIN {tag}_bo AS bo ON") + "," + sql_info(f"{tag}_tn", ["rep"], ["dow", "zl"], "b", "y", "1", tag)


_NULLS = (*PREP, REP, sql_info("prep", [], ["dow", "zl"], "b", "y", "1", "ob"), *[_sql_null(d, d[0] + "n") for d in ("temporal", "series", "circular")],
          "nl AS (" + " UNION ALL ".join(f"SELECT '{d}' AS design, * FROM {d[0]}n" for d in ("temporal", "series", "circular")) + ")")


@register("i06_null_information", cte(*_NULLS) + f"SELECT design, nl.rep, CAST(nl.n AS BIGINT) AS n, {r('nl.hb','hb')}, {r('ob.h0-nl.hb','cmi')}, {big('nl.side_atoms','side_atoms')}, {big('nl.singleton_atoms','singleton_atoms')} FROM nl, ob")
def _(spark, sf):
    return null_all(rows_once(spark, sf)).select("design", "rep", "n", "hb", "cmi", "side_atoms", "singleton_atoms")


def summary_all(spark, sf):
    p = rows_once(spark, sf)
    obs, null = observed(p), null_all(p)
    from tallyfloor.operators.summaries import constant_keyed

    return nulls.null_summary(null, constant_keyed(obs, "design", ["temporal", "series", "circular"]), ["design"])


_SUM = "sm AS (SELECT design, COUNT(*) AS replicates, MAX(ob.cmi) AS observed, AVG(ob.h0-nl.hb) AS null_mean, STDDEV_SAMP(ob.h0-nl.hb) AS null_sd, COUNT(*) FILTER (WHERE ob.h0-nl.hb >= ob.cmi-1e-12) AS exceed FROM nl, ob GROUP BY design)"


@register("i07_null_summary", cte(*_NULLS, _SUM, "pp AS (SELECT *, (1e0+exceed)/(1+replicates) AS p FROM sm)", "qq AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS k, COUNT(*) OVER () AS m FROM pp)") + f"SELECT design, replicates, exceed, {r('observed','observed')}, {r('null_mean','null_mean')}, {r('null_sd','null_sd')}, {r('observed-null_mean','difference')}, {r('p','p')}, {r('LEAST(1, MIN(p*m/k) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))','q')} FROM qq")
def _(spark, sf):
    return ordering.bh_adjust(summary_all(spark, sf), "p", "q").select("design", "replicates", "exceed", "observed", "null_mean", "null_sd", "difference", "p", "q")


_LOCAL = (*PREP, REP, T_SQL, sql_info("tn", ["unit", "rep"], ["zl"], "b", "y", "1", "ln"), sql_info("prep", ["unit"], ["zl"], "b", "y", "1", "lo"),
          "lp AS (SELECT unit, COUNT(*) AS replicates, (1e0+COUNT(*) FILTER (WHERE lo.h0-ln.hb >= lo.cmi-1e-12))/(1+COUNT(*)) AS p FROM ln JOIN lo USING (unit) GROUP BY unit)")


def local_null(spark, sf):
    p = rows_once(spark, sf)
    s = settle(nulls.unit_series(p, ["unit"], "period", ["zl"], "b", "y"))
    rows = nulls.surrogate_rows(s, R)
    obs = info.conditional_information(info.joint_counts(p, ["zl"], "b", "y", ["unit"]), ["zl"], "b", "y", ["unit"])
    sur = nulls.temporal_blocks(s, "unit", R, 7, "temporal", ["unit"], ["zl"], rows)
    null = nulls.with_observed(nulls.null_information(sur, ["zl"], ["unit"], rows=rows), obs, ["unit"])
    return nulls.null_summary(null, obs, ["unit"])


@register("i06_local_null", cte(*_LOCAL) + f"SELECT unit, replicates, {r('p','p')} FROM lp")
def _(spark, sf):
    return local_null(spark, sf).select("unit", "replicates", "p")


_BH = lambda src, p, keys: f"SELECT *, LEAST(1, MIN({p}*m/k) OVER (ORDER BY {p}, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {p}, {keys}) AS k, COUNT(*) OVER () AS m FROM {src})"


@register("f13_bh_adjust", cte(*_LOCAL, f"lq AS ({_BH('lp', 'p', 'unit')})") + f"SELECT unit, {r('p','p')}, {r('q','q')} FROM lq")
def _(spark, sf):
    return ordering.bh_adjust(local_null(spark, sf), "p", "q").select("unit", "p", "q")


@register("i08_joint_screen", cte(*_LOCAL, f"lq AS ({_BH('lp', 'p', 'unit')})") + "SELECT unit, q <= 0.9 AS passes_all, CAST(1 AS BIGINT) AS designs FROM lq")
def _(spark, sf):
    return nulls.joint_screen(ordering.bh_adjust(local_null(spark, sf), "p", "q"), ["unit"], "q", 0.9)


def _sql_local(design, tag):
    """Plus-one p of each unit under a design, with step-up q over the units."""
    body = DESIGNS[design].replace("tn AS", f"{tag}_tn AS").replace("bo AS", f"{tag}_bo AS").replace("JOIN bo ON", f"JOIN {tag}_bo AS bo ON")
    return (body, sql_info(f"{tag}_tn", ["unit", "rep"], ["zl"], "b", "y", "1", tag),
            f"{tag}p AS (SELECT '{design}' AS design, n.unit, (1e0+COUNT(*) FILTER (WHERE lo.h0-n.hb >= lo.cmi-1e-12))/(1+COUNT(*)) AS p FROM {tag} n JOIN lo USING (unit) GROUP BY ALL)",
            f"{tag}q AS ({_BH(tag + 'p', 'p', 'unit')})")


_SCREEN = (*PREP, REP, sql_info("prep", ["unit"], ["zl"], "b", "y", "1", "lo"), *_sql_local("temporal", "lt"), *_sql_local("circular", "lc"), *_sql_local("series", "ls"))


def local_nulls(spark, sf, designs):
    """p and q of each unit under each design; all designs share one table of counts and one pass over them."""
    p = rows_once(spark, sf)
    s = settle(nulls.unit_series(p, ["unit"], "period", ["zl"], "b", "y"))
    rows = nulls.surrogate_rows(s, R)
    obs = settle(info.conditional_information(info.joint_counts(p, ["zl"], "b", "y", ["unit"]), ["zl"], "b", "y", ["unit"]))
    make = {
        "temporal": lambda: nulls.temporal_blocks(s, "unit", R, 7, "temporal", ["unit"], ["zl"], rows),
        "circular": lambda: nulls.circular_shift(s, "unit", R, 5, "circular", ["unit"], ["zl"], rows),
        "series": lambda: nulls.series_permutation(s, "unit", R, "series", ["unit"], ["zl"], rows=rows),
    }
    counts = None
    for d in designs:
        one = make[d]().groupBy("unit", "rep", "zl", "b", "y").agg(F.count("*").alias("n")).withColumn("design", F.lit(d))
        counts = one if counts is None else counts.unionByName(one)
    null = nulls.null_information(counts, ["zl"], ["design", "unit"], counted=True, rows=rows * len(designs))
    every = obs.withColumn("design", F.explode(F.array(*[F.lit(d) for d in designs])))
    summary = nulls.null_summary(nulls.with_observed(null, every, ["design", "unit"]), every, ["design", "unit"])
    return ordering.bh_adjust(summary, "p", "q", ["design"])


@register("i08_screen_over_designs", cte(*_SCREEN, "al AS (" + " UNION ALL ".join(f"SELECT unit, q FROM {t}q" for t in ("lt", "lc", "ls")) + ")") + f"SELECT unit, BOOL_AND(q <= 0.9) AS passes_all, COUNT(*) AS designs, {r('MAX(q)', 'largest_q')} FROM al GROUP BY unit")
def _(spark, sf):
    tests = settle(local_nulls(spark, sf, ["temporal", "circular", "series"]).select("unit", "design", "q"))
    return nulls.joint_screen(tests, ["unit"], "q", 0.9).join(tests.groupBy("unit").agg(F.max("q").alias("largest_q")), "unit")


_LAG = ("lg AS (SELECT *, LAG(b,14) OVER (PARTITION BY unit ORDER BY period) AS b14 FROM prep)", "lm AS (SELECT dow, zl, b, b14, y FROM lg WHERE b14 IS NOT NULL)",
        sql_info("lm", [], ["dow", "zl"], "b", "y", "1", "near"), sql_info("lm", [], ["dow", "zl"], "b14", "y", "1", "far"))


@register("i09_distant_lag", cte(*PREP, *_LAG) + f"SELECT 'near' AS lag, CAST(n AS BIGINT) AS n, {r('cmi','cmi')} FROM near UNION ALL SELECT 'far', CAST(n AS BIGINT), {r('cmi','cmi')} FROM far")
def _(spark, sf):
    from tallyfloor.operators.panel import add_lags

    p = add_lags(prepared(spark, sf), ["unit"], "period", {"b14": ("b", 14)}).where("b14 IS NOT NULL")
    one = lambda side, tag: info.conditional_information(info.joint_counts(p, B, side, "y"), B, side, "y").select(F.lit(tag).alias("lag"), "n", "cmi")
    return one("b", "near").unionByName(one("b14", "far"))


@register("i10_three_estimators", cte(*PREP, REP, T_SQL, sql_info("tn", ["rep"], ["dow", "zl"], "b", "y", "1", "i")) + f"SELECT rep, {r('cmi','miller_madow')}, {r('cmi_plugin','plugin')} FROM i")
def _(spark, sf):
    counts = surrogate(prepared(spark, sf), "temporal").groupBy("rep", *B, "b", "y").agg(F.count("*").alias("n"))
    a = info.conditional_information(counts, B, "b", "y", ["rep"]).select("rep", F.col("cmi").alias("miller_madow"), F.col("cmi_plugin").alias("plugin"))
    return a


_JEF = f"""
a AS (SELECT rep, dow, zl, b, y, COUNT(*)+0.5 AS a FROM tn GROUP BY ALL),
zb AS (SELECT rep, dow, zl, b, SUM(a) AS a FROM a GROUP BY ALL), zy AS (SELECT rep, dow, zl, y, SUM(a) AS a FROM a GROUP BY ALL),
z AS (SELECT rep, dow, zl, SUM(a) AS a FROM a GROUP BY ALL),
g AS (SELECT rep, 'zby' AS t, a FROM a UNION ALL SELECT rep, 'zb', a FROM zb UNION ALL SELECT rep, 'zy', a FROM zy UNION ALL SELECT rep, 'z', a FROM z),
s AS (SELECT rep, t, SUM(a) AS total, SUM(CAST(a AS DOUBLE)*{_DIG('CAST(a AS DOUBLE)')}) AS g FROM g GROUP BY ALL),
w AS (SELECT rep, MAX(total) AS total, (MAX(g) FILTER (WHERE t='z') - MAX(g) FILTER (WHERE t='zy'))/(MAX(total)*ln(2.0)) AS h0, (MAX(g) FILTER (WHERE t='zb') - MAX(g) FILTER (WHERE t='zby'))/(MAX(total)*ln(2.0)) AS hb FROM s GROUP BY rep)
"""


@register("i10_jeffreys_on_surrogates", cte(*PREP, REP, T_SQL, _JEF) + f"SELECT rep, {r('h0','h0')}, {r('hb','hb')}, {r('h0-hb','cmi')} FROM w")
def _(spark, sf):
    counts = surrogate(prepared(spark, sf), "temporal").groupBy("rep", *B, "b", "y").agg(F.count("*").alias("n"))
    return info.jeffreys_information(counts, B, "b", "y", ["rep"])


@register("i10_estimators_side_by_side", cte(*PREP, REP, T_SQL, sql_info("tn", ["rep"], ["dow", "zl"], "b", "y", "1", "i"), _JEF, "j AS (SELECT i.rep, i.cmi AS mm, i.cmi_plugin AS pl, w.h0-w.hb AS je FROM i JOIN w ON w.rep=i.rep)")
    + f"SELECT rep, {r('pl','plugin')}, {r('mm','miller_madow')}, {r('je','jeffreys')}, {r('GREATEST(pl,mm,je)-LEAST(pl,mm,je)','spread')} FROM j")
def _(spark, sf):
    """All three estimators from the same counts of the same surrogates."""
    counts = settle(surrogate(prepared(spark, sf), "temporal").groupBy("rep", *B, "b", "y").agg(F.count("*").alias("n")))
    two = info.conditional_information(counts, B, "b", "y", ["rep"]).select("rep", F.col("cmi_plugin").alias("plugin"), F.col("cmi").alias("miller_madow"))
    out = two.join(info.jeffreys_information(counts, B, "b", "y", ["rep"]).select("rep", F.col("cmi").alias("jeffreys")), "rep")
    three = [F.col(c) for c in ("plugin", "miller_madow", "jeffreys")]
    return out.withColumn("spread", F.greatest(*three) - F.least(*three))


@register("i11_support_shift", cte(*_NULLS) + f"SELECT design, {r('AVG(nl.side_atoms)','null_atoms')}, {r('STDDEV_SAMP(nl.side_atoms)','null_atoms_sd')}, {r('AVG(nl.side_atoms)-MAX(ob.side_atoms)','atom_shift')}, {r('AVG(nl.singleton_atoms*1e0/nl.n)-MAX(ob.singleton_atoms*1e0/ob.n)','singleton_shift')} FROM nl, ob GROUP BY design")
def _(spark, sf):
    p = rows_once(spark, sf)
    obs = observed(p)
    a, s = obs.select("side_atoms").scalar(), obs.select("singleton_share").scalar()
    n = null_all(p).groupBy("design").agg(F.avg("side_atoms").alias("null_atoms"), F.stddev_samp("side_atoms").alias("null_atoms_sd"), F.avg("singleton_share").alias("ss"))
    return n.select("design", "null_atoms", "null_atoms_sd", (F.col("null_atoms") - a).alias("atom_shift"), (F.col("ss") - s).alias("singleton_shift"))


_STRIDE = 7


@register("i12_long_panel_calibration", cte(P_OR, REP, "os AS (SELECT *, (period - DATE '1995-01-02') AS pos, COUNT(*) OVER (PARTITION BY unit) AS t FROM oprep)",
    f"sh AS (SELECT rep, unit, t, 60 + {sql_draw(repr('long'), 'rep', 'unit')} % (t-119) AS k FROM rp, (SELECT DISTINCT unit, t FROM os))",
    "dn AS (SELECT sh.rep, os.unit, (os.pos - sh.k + os.t) % os.t AS pos, os.b FROM os JOIN sh USING (unit))",
    "on2 AS (SELECT dn.rep, a.dow, a.zl, a.y, dn.b FROM os a JOIN dn ON dn.unit=a.unit AND dn.pos=a.pos)",
    sql_info("on2", ["rep"], ["dow", "zl"], "b", "y", "1", "i")) + f"SELECT rep, CAST(n AS BIGINT) AS n, {r('hb','hb')}, {big('side_atoms','side_atoms')} FROM i")
def _(spark, sf):
    s = nulls.unit_series(orders_prepared(spark, sf), ["unit"], "period", B, "b", "y")
    return nulls.null_information(nulls.circular_shift(s, "unit", R, 60, "long", [], B), B).select("rep", "n", "hb", "side_atoms")


@register("i13_balance", f"SELECT l_returnflag, {r('(AVG(l_quantity)-AVG(l_linenumber*10e0))/sqrt((VAR_POP(l_quantity)+VAR_POP(l_linenumber*10e0))/2)','smd')} FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = read(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_linenumber") * 10.0).alias("x"))
    return nulls.standardised_difference(li, "l_quantity", "x", ["l_returnflag"])


@register("i14_replicate_summary", f"SELECT event_type, COUNT(*) AS replicates, {r('AVG(value-10)','bias')}, {r('sqrt(AVG((value-10)*(value-10)))','rmse')}, {r('AVG(CASE WHEN value>0 THEN 1e0 ELSE 0e0 END)','positive_share')}, COUNT(*) FILTER (WHERE event_id%20=0) AS rejections, {r('AVG(CASE WHEN event_id%20=0 THEN 1e0 ELSE 0e0 END)','rejection_rate')} FROM events GROUP BY 1")
def _(spark, sf):
    ev = read(spark, sf, "events").withColumns({"truth": F.lit(10.0), "p": F.when(F.col("event_id") % 20 == 0, 0.01).otherwise(0.5)})
    return nulls.replicate_summary(ev, ["event_type"], "value", "truth", "p")


@register("i15_minimum_effect", f"""
WITH s AS (SELECT l_returnflag AS f, floor(l_quantity/5)/10 AS effect, AVG(CASE WHEN l_discount*10 + l_quantity/50 > 0.8 THEN 1e0 ELSE 0e0 END) AS rate FROM lineitem GROUP BY ALL),
c AS (SELECT *, MAX(rate) OVER w AS rr FROM s WINDOW w AS (PARTITION BY f ORDER BY effect)),
d AS (SELECT *, LAG(rr) OVER w AS pr, LAG(effect) OVER w AS pe FROM c WINDOW w AS (PARTITION BY f ORDER BY effect)),
h AS (SELECT *, CASE WHEN pr IS NULL OR rr=pr THEN effect ELSE pe + (0.8-pr)*(effect-pe)/(rr-pr) END AS x, ROW_NUMBER() OVER (PARTITION BY f, rr>=0.8 ORDER BY effect) AS k FROM d)
SELECT f, {r('MIN(effect) FILTER (WHERE rr>=0.8)','discrete_effect')}, {r('MAX(x) FILTER (WHERE rr>=0.8 AND k=1)','interpolated_effect')}, {r('MAX(rr)','max_power')}, CASE WHEN COUNT(*) FILTER (WHERE rr>=0.8)>0 THEN 'reached' ELSE 'not_reached' END AS status FROM h GROUP BY f""")
def _(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), (F.floor(F.col("l_quantity") / 5) / 10).alias("effect"), (F.col("l_discount") * 10 + F.col("l_quantity") / 50 > 0.8).alias("hit"))
    return nulls.minimum_effect(li.groupBy("f", "effect").agg(F.avg(F.col("hit").cast("double")).alias("rate")), ["f"], "effect", "rate")


@register("f16_running_max", "SELECT unit, CAST(period AS VARCHAR) AS period, CAST(MAX(y) OVER (PARTITION BY unit ORDER BY period) AS BIGINT) AS envelope FROM (SELECT user_id AS unit, CAST(ts AS DATE) AS period, SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS y FROM events GROUP BY ALL)")
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("unit").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return events_counts(spark, sf).select("unit", "period", F.max("y").over(w).alias("envelope"))


# --- lattice of cells ---------------------------------------------------------------------
L_SQL = """
cl AS (SELECT p_size//5 AS x, s_nationkey AS y, CAST((p_size//5)*1000 + s_nationkey AS BIGINT) AS cell, AVG(l_quantity) AS v FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL),
ed AS (SELECT a.cell, b.cell AS nb FROM cl a JOIN cl b ON abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND a.cell<>b.cell),
zz AS (SELECT cell, (v-AVG(v) OVER ())/STDDEV_POP(v) OVER () AS z FROM cl),
lz AS (SELECT z.cell, ANY_VALUE(z.z) AS z, AVG(n.z) AS lag, COUNT(n.z) AS k FROM zz z LEFT JOIN ed ON ed.cell=z.cell LEFT JOIN zz n ON n.cell=ed.nb GROUP BY z.cell),
ob AS (SELECT COUNT(*)*1e0/COUNT(lag)*SUM(z*COALESCE(lag,0))/SUM(z*z) AS i, COUNT(*) AS n, COUNT(lag) AS s0 FROM lz)
"""
PM_SQL = f"""
ur AS (SELECT cell, ROW_NUMBER() OVER (ORDER BY cell) AS k FROM zz),
dr AS (SELECT rep, cell AS donor, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY {sql_draw("'moran'", "rep", "cell")}, cell) AS k FROM zz, rp),
pz AS (SELECT rep, ur.cell, zz.z FROM dr JOIN ur USING (k) JOIN zz ON zz.cell=dr.donor),
pl AS (SELECT p.rep, p.cell, ANY_VALUE(p.z) AS z, AVG(n.z) AS lag FROM pz p LEFT JOIN ed ON ed.cell=p.cell LEFT JOIN pz n ON n.cell=ed.nb AND n.rep=p.rep GROUP BY ALL)
"""


def cells(spark, sf):
    li = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p = read(spark, sf, "part").select("p_partkey", F.floor(F.col("p_size") / 5).alias("x"))
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("y"))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("x", "y", (F.col("x") * 1000 + F.col("y")).alias("cell")).agg(F.avg("l_quantity").alias("v"))


@register("d10_queen_edges", cte(L_SQL) + "SELECT cell, nb AS neighbour FROM ed")
def _(spark, sf):
    return sp.queen_edges(cells(spark, sf), "cell", "x", "y")


@register("j01_spatial_lag", cte(L_SQL) + f"SELECT cell, {r('z','z')}, {r('lag','lag')}, k AS neighbour_count, k=0 AS island FROM lz")
def _(spark, sf):
    c = cells(spark, sf)
    return sp.spatial_lag(sp.standardise(c, "v").select("cell", "z"), sp.queen_edges(c, "cell", "x", "y"), "cell")


@register("j02_moran_global", cte(L_SQL, REP, PM_SQL, "sm AS (SELECT rep, COUNT(*)*1e0/COUNT(lag)*SUM(z*COALESCE(lag,0))/SUM(z*z) AS s FROM pl GROUP BY rep)") + f"SELECT {r('MAX(i)','moran_i')}, MAX(n) AS units, MAX(s0) AS non_islands, {r('AVG(s)','permutation_mean')}, {r('STDDEV_SAMP(s)','permutation_sd')}, COUNT(*) AS permutations, {r('-1e0/(MAX(n)-1)','expected_i')}, {r('(1e0+COUNT(*) FILTER (WHERE abs(s+1e0/(n-1)) >= abs(i+1e0/(n-1))-1e-12))/(1+COUNT(*))','p')} FROM sm, ob")
def _(spark, sf):
    c = cells(spark, sf)
    return sp.moran_global(c, sp.queen_edges(c, "cell", "x", "y"), "cell", "v", R, "moran")


@register("j03_moran_local", cte(L_SQL, REP, PM_SQL, "sm AS (SELECT rep, cell, z*lag AS s FROM pl)", "mn AS (SELECT cell, AVG(s) AS m FROM sm GROUP BY cell)",
    "pv AS (SELECT sm.cell, (1e0+COUNT(*) FILTER (WHERE abs(s-m) >= abs(lz.z*lz.lag-m)-1e-12))/(1+COUNT(*)) AS p FROM sm JOIN mn USING (cell) JOIN lz USING (cell) GROUP BY sm.cell)") + f"SELECT cell, {r('z','z')}, {r('lag','lag')}, {r('z*lag','local_i')}, {r('m','permutation_mean')}, {r('CASE WHEN lag IS NOT NULL THEN p END','p')}, CASE WHEN lag IS NULL THEN 'island' WHEN z>=0 AND lag>=0 THEN 'high_high' WHEN z<0 AND lag<0 THEN 'low_low' WHEN z>=0 THEN 'high_low' ELSE 'low_high' END AS cluster FROM lz LEFT JOIN mn USING (cell) LEFT JOIN pv USING (cell)")
def _(spark, sf):
    c = cells(spark, sf)
    return sp.moran_local(c, sp.queen_edges(c, "cell", "x", "y"), "cell", "v", R, "moran").select("cell", "z", "lag", "local_i", "permutation_mean", "p", "cluster")


METRICS = {"mean_quantity": "AVG(l_quantity)", "lines": "CAST(COUNT(*) AS DOUBLE)", "mean_discount": "AVG(l_discount)"}
_J4 = f"""
ce AS (SELECT n_regionkey AS region, p_size//5 AS x, s_nationkey AS y, CAST((p_size//5)*1000 + s_nationkey AS BIGINT) AS cell, {', '.join(f'{e} AS {m}' for m, e in METRICS.items())}
  FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey GROUP BY ALL),
ed AS (SELECT a.cell, b.cell AS nb FROM ce a JOIN ce b ON a.region=b.region AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND a.cell<>b.cell),
cl AS ({' UNION ALL '.join(f"SELECT region, '{m}' AS metric, cell, {m} AS v FROM ce" for m in METRICS)}),
zz AS (SELECT region, metric, cell, (v-AVG(v) OVER w)/STDDEV_POP(v) OVER w AS z FROM cl WINDOW w AS (PARTITION BY region, metric)),
lz AS (SELECT z.region, z.metric, z.cell, ANY_VALUE(z.z) AS z, AVG(n.z) AS lag FROM zz z LEFT JOIN ed ON ed.cell=z.cell LEFT JOIN zz n ON n.cell=ed.nb AND n.metric=z.metric GROUP BY ALL),
ur AS (SELECT region, metric, cell, ROW_NUMBER() OVER (PARTITION BY region, metric ORDER BY cell) AS k FROM zz),
dr AS (SELECT rep, region, metric, cell AS donor, ROW_NUMBER() OVER (PARTITION BY rep, region, metric ORDER BY {sql_draw("'moran'", "rep", "cell")}, cell) AS k FROM zz, rp),
pz AS (SELECT rep, ur.region, ur.metric, ur.cell, zz.z FROM dr JOIN ur USING (region, metric, k) JOIN zz ON zz.cell=dr.donor AND zz.metric=ur.metric),
pl AS (SELECT p.rep, p.region, p.metric, p.cell, ANY_VALUE(p.z) AS z, AVG(n.z) AS lag FROM pz p LEFT JOIN ed ON ed.cell=p.cell LEFT JOIN pz n ON n.cell=ed.nb AND n.rep=p.rep AND n.metric=p.metric GROUP BY ALL)
"""
_MORAN = "COUNT(*)*1e0/COUNT(lag)*SUM(z*COALESCE(lag,0))/SUM(z*z)"
_J4_GLOBAL = f"""
ob AS (SELECT region, metric, {_MORAN} AS i, COUNT(*) AS n, COUNT(lag) AS s0 FROM lz GROUP BY ALL HAVING COUNT(lag) > 0),
sm AS (SELECT rep, region, metric, {_MORAN} AS s FROM pl GROUP BY ALL HAVING COUNT(lag) > 0),
pv AS (SELECT region, metric, MAX(i) AS i, MAX(n) AS n, MAX(s0) AS s0, AVG(s) AS pm, (1e0+COUNT(*) FILTER (WHERE abs(s+1e0/(n-1)) >= abs(i+1e0/(n-1))-1e-12))/(1+COUNT(*)) AS p FROM sm JOIN ob USING (region, metric) GROUP BY ALL)
"""


def region_metrics(spark, sf):
    """Cells of each region with three metrics, one below the other, and the neighbours inside a region."""
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("y"), F.col("n_regionkey").cast("long").alias("region"))
    li = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount")
    p = read(spark, sf, "part").select("p_partkey", F.floor(F.col("p_size") / 5).alias("x"))
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("y"))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, "y")
    measured = settle(j.groupBy("region", "x", "y", (F.col("x") * 1000 + F.col("y")).alias("cell")).agg(
        F.avg("l_quantity").alias("mean_quantity"), F.count("*").cast("double").alias("lines"), F.avg("l_discount").alias("mean_discount")))
    long = measured.select("region", "cell", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("e")).select("region", "cell", "e.*")
    edges = sp.queen_edges(measured, "cell", "x", "y", ["region"]).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    return long, edges


@register("j04_moran_by_region", cte(REP, _J4, _J4_GLOBAL, f"pq AS ({_BH('pv', 'p', 'region, metric')})") + f"SELECT CAST(region AS BIGINT) AS region, metric, {r('i','moran_i')}, n AS units, s0 AS non_islands, {r('pm','permutation_mean')}, {r('p','p')}, {r('q','q')} FROM pq")
def _(spark, sf):
    long, edges = region_metrics(spark, sf)
    out = sp.moran_global(long, edges, "cell", "v", R, "moran", ["region", "metric"])
    return ordering.bh_adjust(out, "p", "q").select("region", "metric", "moran_i", "units", "non_islands", "permutation_mean", "p", "q")


@register("j04_clusters_by_region", cte(REP, _J4, "mn AS (SELECT region, metric, cell, AVG(z*lag) AS m FROM pl GROUP BY ALL)",
    "pv AS (SELECT pl.region, pl.metric, pl.cell, (1e0+COUNT(*) FILTER (WHERE abs(pl.z*pl.lag-m) >= abs(lz.z*lz.lag-m)-1e-12))/(1+COUNT(*)) AS p FROM pl JOIN mn USING (region, metric, cell) JOIN lz USING (region, metric, cell) GROUP BY ALL)")
    + "SELECT CAST(region AS BIGINT) AS region, metric, CASE WHEN lag IS NULL THEN 'island' WHEN z>=0 AND lag>=0 THEN 'high_high' WHEN z<0 AND lag<0 THEN 'low_low' WHEN z>=0 THEN 'high_low' ELSE 'low_high' END AS cluster, COUNT(*) AS cells, COUNT(*) FILTER (WHERE lag IS NOT NULL AND p <= 0.2) AS marked FROM lz LEFT JOIN pv USING (region, metric, cell) GROUP BY ALL")
def _(spark, sf):
    long, edges = region_metrics(spark, sf)
    out = sp.moran_local(long, edges, "cell", "v", R, "moran", ["region", "metric"])
    return out.groupBy("region", "metric", "cluster").agg(F.count("*").alias("cells"), F.count_if(F.col("p") <= 0.2).alias("marked"))


@register("d15_nested_hierarchy", cte(L_SQL, "pr AS (SELECT x//2 AS px, y//2 AS py FROM (SELECT DISTINCT x, y FROM cl WHERE v > 20) GROUP BY 1,2 HAVING COUNT(*)=4)") + "SELECT CAST(px AS BIGINT) AS parent_x, CAST(py AS BIGINT) AS parent_y, CAST(px*2+i//2 AS BIGINT) AS child_x, CAST(py*2+j//2 AS BIGINT) AS child_y, CAST(px*4+i AS BIGINT) AS x, CAST(py*4+j AS BIGINT) AS y FROM pr, range(4) a(i), range(4) b(j)")
def _(spark, sf):
    return sp.nested_hierarchy(cells(spark, sf).where("v > 20"), "x", "y")
