"""Bootstraps, subsamples, intervals and block designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.functions import bounds
from tallyfloor.operators import information as info, ordering, panel as pn, resample as rs
from tallyfloor.operators.settle import settle

REPS, BLOCKS = 40, 5
B = ["dow", "zl"]

W_SQL = f"""
wt AS (SELECT rep, ({sql_draw("'boot'", "rep", "j")}) % {BLOCKS} AS block, COUNT(*) AS w FROM range(1,{REPS + 1}) a(rep), range({BLOCKS}) b(j) GROUP BY ALL)
"""


def weights(spark):
    return rs.block_weights(spark, BLOCKS, REPS, "boot")


def boot(spark, sf, keys=(), base=B):
    counts = info.joint_counts(prepared(spark, sf), base, "b", "y", keys, "block")
    return rs.bootstrap_information(counts, weights(spark), base, "b", "y", keys, REPS * BLOCKS)


BOOT_SRC = "bs AS (SELECT p.*, w.rep, w.w FROM prep p JOIN wt w ON w.block=p.block)"
BOOT_SQL = (*PREP, W_SQL, BOOT_SRC, sql_info("bs", ["rep"], ["dow", "zl"], "b", "y", "w", "i"))
SPLIT_BOOT = (*PREP, W_SQL, BOOT_SRC, sql_info("bs", ["split", "rep"], ["zl"], "b", "y", "w", "i"))


@register("h01_block_weights", cte(P_EV, W_SQL) + "SELECT rep, CAST(block AS BIGINT) AS block, w, s.n FROM wt JOIN (SELECT (period - DATE '2024-01-02')//7 AS b, COUNT(*) AS n FROM lagged WHERE y1 IS NOT NULL GROUP BY 1) s ON s.b=wt.block")
def _(spark, sf):
    sizes = prepared(spark, sf).groupBy("block").agg(F.count("*").alias("n"))
    return weights(spark).join(sizes, "block")


@register("h02_bootstrap_information", cte(*BOOT_SQL) + f"SELECT rep, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')}, {r('cmi_plugin','cmi_plugin')}, {big('side_atoms','side_atoms')}, {big('singleton_atoms','singleton_atoms')}, {big('nu','nu')} FROM i")
def _(spark, sf):
    return boot(spark, sf).select("rep", "n", "h0", "hb", "cmi", "cmi_plugin", "side_atoms", "singleton_atoms", "nu")


@register("h02_bootstrap_by_unit_floors", cte(*PREP, W_SQL, BOOT_SRC, sql_info("bs", ["unit", "rep"], ["zl"], "b", "y", "w", "i")) + f"SELECT unit, COUNT(*) AS reps, {r('AVG(h0)','h0')}, {r('AVG(hb)','hb')}, {r('STDDEV_SAMP(cmi)','se')} FROM i GROUP BY unit")
def _(spark, sf):
    return boot(spark, sf, ["unit"], ["zl"]).groupBy("unit").agg(F.count("*").alias("reps"), F.avg("h0").alias("h0"), F.avg("hb").alias("hb"), F.stddev_samp("cmi").alias("se"))


def ordered_blocks(spark, sf, reps=6):
    periods = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("period"))
    # One row per calendar period: small, and read by several steps below.
    blocks, pmap = (settle(t) for t in rs.block_universe(settle(periods.distinct()), "period", 7))
    return blocks, pmap, rs.balanced_order(blocks, reps, "sample")


_UNI = """
p AS (SELECT period, ROW_NUMBER() OVER (ORDER BY period)-1 AS i, COUNT(*) OVER () AS t FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS period FROM orders)),
m AS (SELECT period, CASE WHEN i < (t//7)*7 THEN i//7 END AS block FROM p),
bl0 AS (SELECT block, MIN(period) AS block_start, MAX(period) AS block_end, COUNT(*) AS periods_in_block FROM m WHERE block IS NOT NULL GROUP BY 1),
bl1 AS (SELECT *, block_start + CAST((block_end-block_start)//2 AS INTEGER) AS mid FROM bl0),
bl AS (SELECT *, year(mid) AS stratum_year, CASE WHEN month(mid) IN (12,1,2) THEN 'winter' WHEN month(mid) IN (3,4,5) THEN 'spring' WHEN month(mid) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS stratum_season FROM bl1)
"""
_ORD = f"""
o1 AS (SELECT bl.*, rep, ROW_NUMBER() OVER (PARTITION BY rep, stratum_year, stratum_season ORDER BY {sql_draw("'sample'", "rep", "block")}, block) AS k, COUNT(*) OVER (PARTITION BY rep, stratum_year, stratum_season) AS c FROM bl, range(1,7) g(rep)),
ord AS (SELECT *, (k-0.5e0)/c AS score, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY ROUND((k-0.5e0)/c,9), stratum_year, stratum_season, block) AS selection_rank FROM o1)
"""
_FRACTIONS = (0.2, 0.4, 0.6, 0.8, 1.0)


def _sql_membership():
    return "mem AS (" + " UNION ALL ".join(
        f"SELECT rep, {f}e0 AS fraction, block, selection_rank FROM ord WHERE selection_rank <= CAST(CASE WHEN {f}=1.0 THEN (SELECT COUNT(*) FROM bl) ELSE GREATEST(1, round_even((SELECT COUNT(*) FROM bl)*{f}, 0)) END AS BIGINT)" for f in _FRACTIONS
    ) + ")"


def members(spark, sf):
    blocks, pmap, order = ordered_blocks(spark, sf)
    total = blocks.count()  # calendar blocks
    return blocks, pmap, rs.nested_prefixes(order, total, _FRACTIONS)


@register("f05_block_universe", cte(_UNI) + "SELECT CAST(period AS VARCHAR) AS period, CAST(block AS BIGINT) AS block, block IS NOT NULL AS included, CASE WHEN block IS NULL THEN 'incomplete_terminal_sampling_block' ELSE '' END AS residual_reason FROM m")
def _(spark, sf):
    return ordered_blocks(spark, sf)[1]


@register("f05_block_strata", cte(_UNI) + "SELECT CAST(block AS BIGINT) AS block, CAST(block_start AS VARCHAR) AS block_start, CAST(block_end AS VARCHAR) AS block_end, periods_in_block, stratum_year, stratum_season FROM bl")
def _(spark, sf):
    return ordered_blocks(spark, sf)[0]


@register("f06_balanced_order", cte(_UNI, _ORD) + "SELECT rep, CAST(block AS BIGINT) AS block, selection_rank FROM ord")
def _(spark, sf):
    return ordered_blocks(spark, sf)[2].select("rep", "block", "selection_rank")


@register("f06_nested_prefixes", cte(_UNI, _ORD, _sql_membership()) + "SELECT rep, fraction, CAST(block AS BIGINT) AS block, selection_rank FROM mem")
def _(spark, sf):
    return members(spark, sf)[2]


@register("f08_stratum_balance", cte(_UNI, _ORD, _sql_membership(), """
s AS (SELECT stratum_year, stratum_season, COUNT(*) AS n FROM bl GROUP BY ALL), z AS (SELECT rep, fraction, COUNT(*) AS size FROM mem GROUP BY ALL),
k AS (SELECT mem.rep, mem.fraction, stratum_year, stratum_season, COUNT(*) AS c FROM mem JOIN bl USING (block) GROUP BY ALL)
""") + f"SELECT z.rep, z.fraction, {r('MAX(abs(COALESCE(c,0)*1e0/size - n*1e0/(SELECT COUNT(*) FROM bl)))','max_share_deviation')} FROM z CROSS JOIN s LEFT JOIN k ON k.rep=z.rep AND k.fraction=z.fraction AND k.stratum_year=s.stratum_year AND k.stratum_season=s.stratum_season GROUP BY 1,2")
def _(spark, sf):
    blocks, _, mem = members(spark, sf)
    return rs.stratum_balance(mem, blocks)


@register("f08_not_nested", cte(_UNI, _ORD, _sql_membership(), "f AS (SELECT DISTINCT fraction FROM mem)", "nx AS (SELECT fraction, LEAD(fraction) OVER (ORDER BY fraction) AS wider FROM f)") + "SELECT COUNT(*) AS missing FROM mem JOIN nx USING (fraction) LEFT JOIN mem m2 ON m2.rep=mem.rep AND m2.block=mem.block AND m2.fraction=nx.wider WHERE nx.wider IS NOT NULL AND m2.block IS NULL")
def _(spark, sf):
    mem = members(spark, sf)[2]
    parts = [rs.not_nested(mem, a, b) for a, b in zip(_FRACTIONS, _FRACTIONS[1:])]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.agg(F.count("*").alias("missing"))


def orders_panel(spark, sf):
    """Nations x days: orders placed (y), lines shipped (x)."""
    cust = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("od")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy("unit", F.col("od").alias("period")).agg(F.count("*").alias("y"), F.lit(0).cast("long").alias("x"))
    li = read(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("period"))
    x = li.join(o.select("o_orderkey", "unit"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("unit", "period").agg(F.lit(0).cast("long").alias("y"), F.count("*").alias("x"))
    both = y.unionByName(x).groupBy("unit", "period").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))
    dense = pn.densify(both, ["unit"], "period", ["y", "x"], OR_START, OR_END)
    return pn.add_lags(dense, ["unit"], "period", {"y1": ("y", 1), "x1": ("x", 1)})


P_OR = f"""
oo AS (SELECT o_orderkey, c_nationkey AS unit, CAST(o_orderdate AS DATE) AS period FROM orders JOIN customer ON o_custkey=c_custkey),
oy AS (SELECT unit, period, COUNT(*) AS y FROM oo GROUP BY 1,2),
ox AS (SELECT unit, CAST(l_shipdate AS DATE) AS period, COUNT(*) AS x FROM lineitem JOIN oo ON l_orderkey=o_orderkey GROUP BY 1,2),
ocal AS (SELECT CAST(d AS DATE) AS period FROM range(TIMESTAMP '{OR_START}', TIMESTAMP '{OR_END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
opanel AS (SELECT CAST(u.unit AS BIGINT) AS unit, c.period, CAST(COALESCE(y,0) AS BIGINT) AS y, CAST(COALESCE(x,0) AS BIGINT) AS x FROM (SELECT DISTINCT unit FROM (SELECT unit FROM oy UNION ALL SELECT unit FROM ox)) u CROSS JOIN ocal c LEFT JOIN oy ON oy.unit=u.unit AND oy.period=c.period LEFT JOIN ox ON ox.unit=u.unit AND ox.period=c.period),
olag AS (SELECT *, LAG(y) OVER w AS y1, LAG(x) OVER w AS x1 FROM opanel WINDOW w AS (PARTITION BY unit ORDER BY period)),
oprep AS (SELECT *, LEAST(y1,3) AS zl, LEAST(x1,3) AS b, isodow(period)-1 AS dow FROM olag WHERE y1 IS NOT NULL)
"""


def orders_prepared(spark, sf):
    from tallyfloor.functions.calendars import day_of_week
    from tallyfloor.functions.states import count_code

    return orders_panel(spark, sf).where("y1 IS NOT NULL").withColumns({"zl": count_code(F.col("y1")), "b": count_code(F.col("x1")), "dow": day_of_week(F.col("period"))})


@register("a06_long_panel_totals", cte(P_OR) + "SELECT unit, CAST(SUM(y) AS BIGINT) AS y, CAST(SUM(x) AS BIGINT) AS x, COUNT(*) AS days, CAST(SUM(y1) AS BIGINT) AS y1 FROM olag GROUP BY unit")
def _(spark, sf):
    return orders_panel(spark, sf).groupBy("unit").agg(F.sum("y").alias("y"), F.sum("x").alias("x"), F.count("*").alias("days"), F.sum("y1").alias("y1"))


@register("d06_block_map_join", cte(_UNI, P_OR) + "SELECT CAST(block AS BIGINT) AS block, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS y FROM opanel JOIN m USING (period) WHERE block IS NOT NULL GROUP BY block")
def _(spark, sf):
    pmap = ordered_blocks(spark, sf)[1].where("included")
    return orders_panel(spark, sf).join(pmap, "period").groupBy("block").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@register("h03_subsample_information", cte(_UNI, _ORD, _sql_membership(), P_OR, "sb AS (SELECT o.dow, o.zl, o.b, o.y, mem.rep, mem.fraction FROM oprep o JOIN m USING (period) JOIN mem ON mem.block=m.block)", sql_info("sb", ["rep", "fraction"], ["dow", "zl"], "b", "y")) + f"SELECT rep, fraction, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('cmi','cmi')}, {big('side_atoms','side_atoms')} FROM i")
def _(spark, sf):
    return subsampled(spark, sf).select("rep", "fraction", "n", "h0", "hb", "cmi", "side_atoms")


def subsampled(spark, sf):
    _, pmap, mem = members(spark, sf)
    rows = orders_prepared(spark, sf).join(pmap.where("included").select("period", "block"), "period")
    counts = info.joint_counts(rows, B, "b", "y", block="block")
    member = mem.select("rep", "fraction", "block").withColumn("w", F.lit(1))
    return rs.bootstrap_information(counts, member, B, "b", "y", rep=["rep", "fraction"])


def _losses(spark, sf):
    p = prepared(spark, sf)
    return p.withColumns({"e0": (F.col("y") - F.col("zl")) ** 2, "e1": (F.col("y") - F.least("zl", "b")) ** 2})


_LOSS = "ls AS (SELECT *, CAST((y-zl)*(y-zl) AS DOUBLE) AS e0, CAST((y-LEAST(zl,b))*(y-LEAST(zl,b)) AS DOUBLE) AS e1 FROM prep)"


@register("h04_loss_bootstrap", cte(*PREP, W_SQL, _LOSS) + f"SELECT rep, {r('SUM(e0*w)/SUM(w)','e0')}, {r('SUM(e1*w)/SUM(w)','e1')} FROM ls JOIN wt USING (block) GROUP BY rep")
def _(spark, sf):
    return rs.bootstrap_losses(rs.loss_blocks(_losses(spark, sf), {"e0": "e0", "e1": "e1"}), weights(spark), ["e0", "e1"], rows=REPS * BLOCKS)


@register("h05_joint_bootstrap", cte(*BOOT_SQL, _LOSS, f"""
lo AS (SELECT rep, SUM(e0*w)/SUM(w) AS m0, SUM(e1*w)/SUM(w) AS m1 FROM ls JOIN wt USING (block) GROUP BY rep),
f AS (SELECT rep, m0, m1, GREATEST(h0,0) AS p0, LEAST(GREATEST(hb,0),GREATEST(h0,0)) AS pb FROM i JOIN lo USING (rep)),
g AS (SELECT *, {sql_floor('p0')} AS l0, {sql_floor('pb')} AS lb FROM f)
""") + f"SELECT rep, {r('m0-l0','gap_base')}, {r('m1-lb','gap_side')}, {r('l0/m0','efficiency_base')}, {r('lb/m1','efficiency_side')}, {r('m0-m1','delta_mse')}, {r('l0-lb','delta_l')}, {r('(m0-l0)-(m1-lb)','gap_narrowing')} FROM g")
def _(spark, sf):
    losses = rs.bootstrap_losses(rs.loss_blocks(_losses(spark, sf), {"e0": "e0", "e1": "e1"}), weights(spark), ["e0", "e1"], rows=REPS * BLOCKS)
    both = bounds.attach_floors(boot(spark, sf).select("rep", "h0", "hb"), "h0", "hb").join(losses, "rep")
    return bounds.gap_metrics(both, "e0", "e1", "l0", "lb").select("rep", "gap_base", "gap_side", "efficiency_base", "efficiency_side", "delta_mse", "delta_l", "gap_narrowing")


_Z975 = "1.9599639845400536e0"


@register("h06_normal_interval", cte(*SPLIT_BOOT, sql_info("prep", ["split"], ["zl"], "b", "y", "1", "pt")) + f"""
SELECT split, {r('ANY_VALUE(pt.cmi)','point')}, {r('STDDEV_SAMP(i.cmi)','se')}, {r('AVG(i.cmi)-ANY_VALUE(pt.cmi)','bias')}, {r(f'ANY_VALUE(pt.cmi)-{_Z975}*STDDEV_SAMP(i.cmi)','ci_low')}, {r(f'ANY_VALUE(pt.cmi)+{_Z975}*STDDEV_SAMP(i.cmi)','ci_high')},
{r('quantile_cont(i.cmi,0.025)','percentile_low')}, {r('quantile_cont(i.cmi,0.975)','percentile_high')}, {r('AVG(CASE WHEN i.cmi<=0 THEN 1e0 ELSE 0e0 END)','nonpositive_share')}, COUNT(*) AS replicates FROM i JOIN pt USING (split) GROUP BY split""")
def _(spark, sf):
    return interval_by_split(spark, sf).select("split", "point", "se", "bias", "ci_low", "ci_high", "percentile_low", "percentile_high", "nonpositive_share", "replicates")


def interval_by_split(spark, sf):
    point = info.conditional_information(info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["split"]), ["zl"], "b", "y", ["split"])
    return rs.normal_interval(point, boot(spark, sf, ["split"], ["zl"]), ["split"], "cmi")


@register("h06_evidence")
def _(spark, sf):
    t = interval_by_split(spark, sf)
    t = ordering.bh_adjust(t, "p_greater", "q")
    return t.withColumn("evidence", rs.evidence_label(F.col("point"), F.col("ci_low"), F.col("q"), F.col("ci_low"))).select("split", "z", "p_greater", "p_two_sided", "q", "evidence")


@register("h07_centred_interval", cte(*SPLIT_BOOT, sql_info("prep", ["split"], ["zl"], "b", "y", "1", "pt")) + f"SELECT split, {r('ANY_VALUE(pt.cmi)','point')}, {r('ANY_VALUE(pt.cmi)+quantile_cont(i.cmi,0.025)-AVG(i.cmi)','ci_low')}, {r('ANY_VALUE(pt.cmi)+quantile_cont(i.cmi,0.975)-AVG(i.cmi)','ci_high')} FROM i JOIN pt USING (split) GROUP BY split")
def _(spark, sf):
    point = info.conditional_information(info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["split"]), ["zl"], "b", "y", ["split"])
    return rs.centred_percentile_interval(point, boot(spark, sf, ["split"], ["zl"]), ["split"], "cmi")


@register("h08_percentile_interval", cte(*BOOT_SQL) + f"SELECT COUNT(*) AS replicates, {r('quantile_cont(h0,0.025)','h0_low')}, {r('quantile_cont(h0,0.5)','h0_median')}, {r('quantile_cont(h0,0.975)','h0_high')}, {r('quantile_cont(cmi,0.025)','cmi_low')}, {r('quantile_cont(cmi,0.5)','cmi_median')}, {r('quantile_cont(cmi,0.975)','cmi_high')} FROM i")
def _(spark, sf):
    return rs.percentile_interval(boot(spark, sf), [], ["h0", "cmi"])


_SUB = (_UNI, _ORD, _sql_membership(), P_OR, "sb AS (SELECT o.dow, o.zl, o.b, o.y, mem.rep, mem.fraction FROM oprep o JOIN m USING (period) JOIN mem ON mem.block=m.block)", sql_info("sb", ["rep", "fraction"], ["dow", "zl"], "b", "y"))


@register("h10_thinning_summary", cte(*_SUB) + f"SELECT fraction, COUNT(*) AS replicates, {r('quantile_cont(cmi,0.025)','cmi_low')}, {r('quantile_cont(cmi,0.5)','cmi_median')}, {r('quantile_cont(cmi,0.975)','cmi_high')} FROM i GROUP BY fraction")
def _(spark, sf):
    return rs.percentile_interval(subsampled(spark, sf), ["fraction"], ["cmi"])


@register("d13_reference_row_stability", cte(*_SUB) + f"SELECT a.rep, a.fraction, {r('abs(a.cmi-b.cmi)/GREATEST(abs(b.cmi),1e-12)','deviation')} FROM i a JOIN i b ON a.rep=b.rep AND b.fraction=1.0 WHERE a.fraction<1.0")
def _(spark, sf):
    from tallyfloor.operators.summaries import against_reference

    return against_reference(subsampled(spark, sf), ["rep"], "fraction", 1.0, "cmi", "deviation").where("fraction < 1").select("rep", "fraction", "deviation")


@register("h11_block_length_sensitivity", cte(*PREP, *[
    f"w{n} AS (SELECT rep, ({sql_draw(repr('len' + str(n)), 'rep', 'j')}) % {k} AS bk, COUNT(*) AS w FROM range(1,21) a(rep), range({k}) b(j) GROUP BY ALL), s{n} AS (SELECT p.*, rep, w FROM prep p JOIN w{n} ON bk = pos//{n}), " + sql_info(f"s{n}", ["rep"], ["zl"], "b", "y", "w", f"i{n}")
    for n, k in ((3, 10), (7, 5), (14, 3))]) + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS block_length, {r('AVG(cmi)','mean')}, {r('STDDEV_SAMP(cmi)','se')} FROM i{n}" for n in (3, 7, 14)))
def _(spark, sf):
    p, out = prepared(spark, sf), None
    for n, k in ((3, 10), (7, 5), (14, 3)):
        rows = p.withColumn("block", F.floor(F.col("pos") / n).cast("int"))
        reps = rs.bootstrap_information(info.joint_counts(rows, ["zl"], "b", "y", block="block"), rs.block_weights(spark, k, 20, f"len{n}"), ["zl"], "b", "y", rows=20 * k)
        part = reps.agg(F.lit(n).alias("block_length"), F.avg("cmi").alias("mean"), F.stddev_samp("cmi").alias("se"))
        out = part if out is None else out.unionByName(part)
    return out


@register("d14_category_pairs", cte(*SPLIT_BOOT) + f"SELECT a.split AS category_a, b.split AS category_b, COUNT(*) AS replicates, {r('AVG(a.cmi-b.cmi)','mean_difference')}, {r('STDDEV_SAMP(a.cmi-b.cmi)','se')} FROM i a JOIN i b ON a.rep=b.rep AND a.split<b.split GROUP BY ALL")
def _(spark, sf):
    from tallyfloor.operators.summaries import category_differences

    d = category_differences(boot(spark, sf, ["split"], ["zl"]), "split", "rep", "cmi")
    return d.groupBy("category_a", "category_b").agg(F.count("*").alias("replicates"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("se"))


@register("h09_category_difference", None)
def _(spark, sf):
    from tallyfloor.operators.summaries import category_differences

    reps = category_differences(boot(spark, sf, ["split"], ["zl"]), "split", "rep", "cmi")
    counts = info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["split"])
    point = info.conditional_information(counts, ["zl"], "b", "y", ["split"]).withColumn("rep", F.lit(0))
    point = category_differences(point, "split", "rep", "cmi")
    return rs.normal_interval(point, reps, ["category_a", "category_b"], "difference").select("category_a", "category_b", "point", "se", "ci_low", "ci_high", "p_two_sided")


@register("h12_spearman_bootstrap", cte(P_EV, f"""
u AS (SELECT unit, SUM(x) AS sx, SUM(y) AS sy FROM panel GROUP BY unit), n AS (SELECT COUNT(*) AS n FROM u),
ur AS (SELECT *, ROW_NUMBER() OVER (ORDER BY unit)-1 AS k FROM u),
d AS (SELECT rep, {sql_draw("'rho'", "rep", "j")} % n AS k FROM n, range(1,31) a(rep), LATERAL (SELECT unnest(range(n)) AS j)),
s AS (SELECT rep, sx, sy FROM d JOIN ur USING (k)),
rk AS (SELECT rep, RANK() OVER (PARTITION BY rep ORDER BY sx) + (COUNT(*) OVER (PARTITION BY rep, sx)-1)/2e0 AS rx, RANK() OVER (PARTITION BY rep ORDER BY sy) + (COUNT(*) OVER (PARTITION BY rep, sy)-1)/2e0 AS ry FROM s),
c AS (SELECT rep, CORR(rx, ry) AS rho FROM rk GROUP BY rep)
""") + f"SELECT COUNT(*) AS replicates, {r('AVG(rho)','mean')}, {r('quantile_cont(rho,0.025)','ci_low')}, {r('quantile_cont(rho,0.975)','ci_high')} FROM c")
def _(spark, sf):
    from tallyfloor.operators.summaries import spearman_bootstrap

    u = events_counts(spark, sf).groupBy("unit").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    reps = spearman_bootstrap(u, "unit", "sx", "sy", 30, "rho")
    return reps.agg(F.count("*").alias("replicates"), F.avg("rho").alias("mean"), F.expr("percentile(rho, 0.025D)").alias("ci_low"), F.expr("percentile(rho, 0.975D)").alias("ci_high"))


@register("h12_spearman_interval", None)
def _(spark, sf):
    from tallyfloor.operators.summaries import spearman_interval

    u = events_counts(spark, sf).groupBy("unit").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return spearman_interval(u, "unit", "sx", "sy", 200, "rho")
