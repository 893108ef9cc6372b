"""Panel, joint counts and entropies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.functions import bounds, calendars, states
from tallyfloor.operators import information as info, panel as pn

B = ["dow", "zl"]


@register("e01_period_counts", cte(P_EV) + "SELECT unit, CAST(period AS VARCHAR) AS period, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM ev")
def _(spark, sf):
    return events_counts(spark, sf)


@register("d01_dense_panel", cte(P_EV) + "SELECT unit, CAST(period AS VARCHAR) AS period, y, x FROM panel")
def _(spark, sf):
    return pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)


@register("d02_zero_fill_with_units", f"""
WITH u AS (SELECT c_custkey AS unit FROM customer),
ev AS (SELECT user_id AS unit, CAST(ts AS DATE) AS period, COUNT(*) AS n FROM events GROUP BY 1,2),
cal AS (SELECT CAST(d AS DATE) AS period FROM range(TIMESTAMP '{EV_START}', TIMESTAMP '{EV_END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
p AS (SELECT u.unit, cal.period, COALESCE(n,0) AS n FROM u CROSS JOIN cal LEFT JOIN ev ON ev.unit=u.unit AND ev.period=cal.period)
SELECT unit, CAST(COUNT(*) AS BIGINT) AS days, CAST(SUM(n) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE n=0) AS BIGINT) AS zero_days FROM p GROUP BY unit""")
def _(spark, sf):
    units = read(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))
    counts = pn.period_counts(
        read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.to_date("ts").alias("period")),
        ["unit", "period"], {"n": F.lit(True)},
    )
    counts = pn.within_domain(counts, units, ["unit"])
    dense = pn.densify(counts, ["unit"], "period", ["n"], EV_START, EV_END, units)
    return dense.groupBy("unit").agg(
        F.count("*").alias("days"), F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("zero_days")
    )


@register("d03_domain_flag", """
WITH d AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id, lang, d2.doc_id IS NOT NULL AS labelled FROM documents LEFT JOIN (SELECT doc_id AS doc_id FROM d) d2 USING (doc_id)
""".replace("doc_id, lang, d2", "documents.doc_id, lang, d2"))
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return pn.flag_domain(docs, read(spark, sf, "labels"), ["doc_id"], "labelled")


@register("f01_strict_lags", cte(P_EV) + """
SELECT unit, CAST(period AS VARCHAR) AS period, y1, x1, LAG(y,7) OVER (PARTITION BY unit ORDER BY period) AS y7,
 LAG(y,14) OVER (PARTITION BY unit ORDER BY period) AS y14 FROM lagged""")
def _(spark, sf):
    dense = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    return pn.add_lags(dense, ["unit"], "period", {"y1": ("y", 1), "x1": ("x", 1), "y7": ("y", 7), "y14": ("y", 14)}).drop("y", "x")


@register("c09_prepare_states", cte(*PREP) + """
SELECT unit, CAST(period AS VARCHAR) AS period, y, CAST(zl AS BIGINT) AS zl, CAST(b AS BIGINT) AS b, CAST(dow AS BIGINT) AS dow, CAST(block AS BIGINT) AS block, split FROM prep""")
def _(spark, sf):
    return prepared(spark, sf).select("unit", "period", "y", "zl", "b", "dow", "block", "split")


@register("e15_fit_cuts", cte(P_EV) + f"""
SELECT isodow(period)-1 AS dow, {r('quantile_cont(x1, 0.25)', 'q1')}, {r('quantile_cont(x1, 0.5)', 'q2')}, {r('quantile_cont(x1, 0.9)', 'q3')}
FROM lagged WHERE x1>0 AND period <= DATE '{EV_TRAIN_END}' GROUP BY 1""")
def _(spark, sf):
    p = events_panel(spark, sf).where(F.col("period") <= F.lit(EV_TRAIN_END).cast("date"))
    cuts = info.fit_cuts(p.withColumn("dow", calendars.day_of_week(F.col("period"))), "x1", [0.25, 0.5, 0.9], ["dow"])
    return cuts.select("dow", *[F.col("cuts")[i].alias(f"q{i + 1}") for i in range(3)])


@register("d16_frozen_cuts", f"""
WITH s AS (SELECT p_brand AS brand, l_quantity AS q, l_returnflag AS f FROM lineitem JOIN part ON l_partkey=p_partkey),
c AS (SELECT brand, quantile_cont(q,1.0/3) AS c1, quantile_cont(q,2.0/3) AS c2 FROM s WHERE f='N' AND q>0 GROUP BY 1)
SELECT brand, CASE WHEN q=0 THEN 'zero' WHEN q<=c1 THEN 'low' WHEN q<=c2 THEN 'medium' ELSE 'high' END AS state, COUNT(*) AS n
FROM s JOIN c USING (brand) GROUP BY 1,2""")
def _(spark, sf):
    s = read(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag").join(
        read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand")),
        F.col("l_partkey") == F.col("p_partkey"),
    ).groupBy("brand", "l_quantity", "l_returnflag").agg(F.count("*").alias("n"))
    cuts = s.where((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 0)).groupBy("brand").agg(
        F.expr("percentile(l_quantity, array(1D/3, 2D/3), n)").alias("cuts")
    )
    return s.join(cuts, "brand").groupBy(
        "brand", states.cut_label(F.col("l_quantity"), F.col("cuts")).alias("state")
    ).agg(F.sum("n").alias("n"))


@register("e16_joint_counts", cte(*PREP) + "SELECT CAST(dow AS BIGINT) AS dow, CAST(zl AS BIGINT) AS zl, CAST(b AS BIGINT) AS b, y, CAST(block AS BIGINT) AS block, COUNT(*) AS n FROM prep GROUP BY ALL")
def _(spark, sf):
    return info.joint_counts(prepared(spark, sf), B, "b", "y", block="block")


_INFO_COLS = (
    "CAST(n AS BIGINT) AS n, " + ", ".join(r(c, c) for c in ("h0_plugin", "hb_plugin", "h0", "hb", "cmi_plugin", "cmi"))
    + ", " + ", ".join(big(c, c) for c in ("base_states", "side_states", "base_atoms", "side_atoms", "singleton_atoms", "nu"))
    + ", " + r("side_atoms/n", "k_over_n") + ", " + r("singleton_atoms/n", "singleton_share") + ", " + r("nu/n", "nu_over_n")
)


@register("e17_conditional_information", cte(*PREP, sql_info("prep", [], ["dow", "zl"], "b", "y")) + f"SELECT {_INFO_COLS} FROM i")
def _(spark, sf):
    return info.conditional_information(info.joint_counts(prepared(spark, sf), B, "b", "y"), B, "b", "y")


@register("e17_information_by_split", cte(*PREP, sql_info("prep", ["split"], ["unit", "zl"], "b", "y")) + f"SELECT split, {_INFO_COLS} FROM i")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), ["unit", "zl"], "b", "y", ["split"])
    return info.conditional_information(counts, ["unit", "zl"], "b", "y", ["split"])


@register("e17_information_by_unit", cte(*PREP, sql_info("prep", ["unit"], ["zl"], "b", "y")) + f"SELECT unit, {_INFO_COLS} FROM i")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["unit"])
    return info.conditional_information(counts, ["zl"], "b", "y", ["unit"])


@register("e18_marginal_entropy", cte(*PREP, sql_entropy("prep", ["split", "dow"], [], "y", tag="m")) + f"SELECT split, {big('dow','dow')}, CAST(n AS BIGINT) AS n, {big('atoms','support')}, {r('plug','h_plugin')}, {r('mm','h')} FROM m")
def _(spark, sf):
    return info.marginal_entropy(prepared(spark, sf), "y", ["split", "dow"])


_DIG = lambda a: f"(ln({a}+9.0) - 0.5/({a}+9.0) - " + " - ".join(
    f"{c}/pow({a}+9.0,{p})" for c, p in (("(1.0/12)", 2), ("(-1.0/120)", 4), ("(1.0/252)", 6), ("(-1.0/240)", 8), ("(1.0/132)", 10))
) + " - " + " - ".join(f"1.0/({a}+{i}.0)" for i in range(1, 9)) + ")"


@register("e19_jeffreys_information", cte(*PREP, f"""
a AS (SELECT split, dow, zl, b, y, COUNT(*)+0.5 AS a FROM prep GROUP BY ALL),
zb AS (SELECT split, dow, zl, b, SUM(a) AS a FROM a GROUP BY ALL), zy AS (SELECT split, dow, zl, y, SUM(a) AS a FROM a GROUP BY ALL),
z AS (SELECT split, dow, zl, SUM(a) AS a FROM a GROUP BY ALL),
g AS (SELECT split, 'zby' AS t, a FROM a UNION ALL SELECT split, 'zb', a FROM zb UNION ALL SELECT split, 'zy', a FROM zy UNION ALL SELECT split, 'z', a FROM z),
s AS (SELECT split, t, SUM(a) AS total, SUM(CAST(a AS DOUBLE)*{_DIG('CAST(a AS DOUBLE)')}) AS g FROM g GROUP BY ALL),
w AS (SELECT split, MAX(total) AS total, MAX(g) FILTER (WHERE t='zby') AS gzby, MAX(g) FILTER (WHERE t='zb') AS gzb, MAX(g) FILTER (WHERE t='zy') AS gzy, MAX(g) FILTER (WHERE t='z') AS gz FROM s GROUP BY split)
""") + f"SELECT split, {r('(gz-gzy)/(total*ln(2.0))','h0')}, {r('(gzb-gzby)/(total*ln(2.0))','hb')}, {r('(gz-gzy)/(total*ln(2.0))-(gzb-gzby)/(total*ln(2.0))','cmi')} FROM w")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), B, "b", "y", ["split"])
    return info.jeffreys_information(counts, B, "b", "y", ["split"])


@register("e20_support", cte(*PREP, sql_info("prep", ["zl"], ["dow"], "b", "y")) + f"SELECT {big('zl','zl')}, CAST(n AS BIGINT) AS n, {big('side_atoms','side_atoms')}, {big('singleton_atoms','singleton_atoms')}, {big('nu','nu')}, {r('side_atoms/n','k_over_n')}, {r('singleton_atoms/n','singleton_share')}, {r('nu/n','nu_over_n')} FROM i")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), ["dow"], "b", "y", ["zl"])
    return info.conditional_information(counts, ["dow"], "b", "y", ["zl"]).select(
        "zl", "n", "side_atoms", "singleton_atoms", "nu", "k_over_n", "singleton_share", "nu_over_n"
    )


@register("e21_state_sparsity", cte(*PREP, "s AS (SELECT split, unit, zl, b, COUNT(*) AS c FROM prep GROUP BY ALL)") + f"""
SELECT split, COUNT(*) AS states, {r('median(c)','median_per_state')}, {r('AVG(CASE WHEN c=1 THEN 1.0 ELSE 0 END)','singleton_state_share')},
{r('SUM(CASE WHEN c=1 THEN 1.0 ELSE 0 END)/SUM(c)','singleton_observation_share')} FROM s GROUP BY split""")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), ["unit", "zl"], "b", "y", ["split"])
    return info.state_sparsity(counts, ["unit", "zl", "b"], ["split"])


@register("f21_encode_states", cte(*PREP, "s AS (SELECT DISTINCT dow, zl, b FROM prep)") + "SELECT CAST(dow AS BIGINT) AS dow, CAST(zl AS BIGINT) AS zl, CAST(b AS BIGINT) AS b, CAST(DENSE_RANK() OVER (ORDER BY dow, zl, b) AS BIGINT) AS code FROM s")
def _(spark, sf):
    from tallyfloor.operators.ordering import cumulative_counts

    distinct = prepared(spark, sf).select("dow", "zl", "b").distinct().withColumn("s", F.struct("dow", "zl", "b"))
    return cumulative_counts(distinct, "s").select("s.*", (F.col("n_below") + 1).alias("code"))


@register("g05_floor_pair", cte(*PREP, sql_info("prep", ["split"], ["dow", "zl"], "b", "y"), f"""
f AS (SELECT *, GREATEST(h0,0) AS p0, LEAST(GREATEST(hb,0),GREATEST(h0,0)) AS pb FROM i),
g AS (SELECT *, {sql_floor('p0')} AS l0, {sql_floor('pb')} AS lb FROM f)
""") + f"SELECT split, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')}, {r('l0','l0')}, {r('lb','lb')}, {r('l0-lb','delta_l')}, {r('greatest(0,pow(2,2*p0)/(2*pi()*exp(1.0))-1.0/12)','closed_l0')}, (p0<>h0 OR pb<>hb) AS projected FROM g")
def _(spark, sf):
    counts = info.joint_counts(prepared(spark, sf), B, "b", "y", ["split"])
    out = info.conditional_information(counts, B, "b", "y", ["split"])
    return bounds.attach_floors(out, "h0", "hb").select("split", "h0", "hb", "cmi", "l0", "lb", "delta_l", "closed_l0", "projected")
