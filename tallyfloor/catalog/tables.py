"""Descriptive tables, ranks, joins and checks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.catalog.columns import _EVENT_RULES_SQL, event_rows
from tallyfloor.catalog.resampling import P_OR, orders_panel, orders_prepared
from tallyfloor.functions import bounds, calendars, special
from tallyfloor.functions.states import split_label
from tallyfloor.operators import audit as au, checks as ck, information as info, ordering, panel as pn, repair as rp, stations as st, summaries as sm

B = ["dow", "zl"]


# --- joins --------------------------------------------------------------------------------
@register("d05_unique_alias", "SELECT c_mktsegment AS city, p AS name, MIN(k) AS alias_key FROM (SELECT c_mktsegment, substr(c_name, 15) AS p, CAST(c_custkey%50 AS VARCHAR) AS k FROM customer) GROUP BY 1,2 HAVING COUNT(DISTINCT k)=1")
def _(spark, sf):
    d = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("city"), F.expr("substr(c_name, 15)").alias("name"), (F.col("c_custkey") % 50).cast("string").alias("k"))
    return st.unique_alias(d, "city", "name", "k")


_DICT_SQL = """
ob AS (SELECT l_returnflag AS city, strftime(l_shipdate,'%Y-%m') AS month, 'I:' || l_suppkey AS station_key, 38.8e0 + (l_suppkey%89)*0.003e0 + (l_partkey%5)*0.0005e0 AS latitude, -77.2e0 + (l_suppkey%97)*0.004e0 AS longitude FROM lineitem),
dc AS (SELECT city, month, station_key, COUNT(*) AS observations, median(latitude) AS latitude, median(longitude) AS longitude FROM ob GROUP BY ALL)
"""


def station_obs(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("city"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.concat(F.lit("I:"), F.col("l_suppkey").cast("string")).alias("station_key"),
        (F.lit(38.8) + (F.col("l_suppkey") % 89) * 0.003 + (F.col("l_partkey") % 5) * 0.0005).alias("latitude"),
        (F.lit(-77.2) + (F.col("l_suppkey") % 97) * 0.004).alias("longitude"),
    )


def dictionary(spark, sf):
    return st.prepass(station_obs(spark, sf), ["city", "month", "station_key"])


@register("e04_station_prepass", cte(_DICT_SQL) + f"SELECT city, month, station_key, observations, {r('latitude','latitude')}, {r('longitude','longitude')} FROM dc")
def _(spark, sf):
    return dictionary(spark, sf)


@register("e05_weighted_median", f"WITH s AS (SELECT p_brand, p_size, SUM(l_quantity) AS w FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY ALL), c AS (SELECT *, SUM(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS cw, SUM(w) OVER (PARTITION BY p_brand) AS t FROM s) SELECT p_brand, CAST(MIN(p_size) AS BIGINT) AS p_size FROM c WHERE cw >= t/2 GROUP BY 1")
def _(spark, sf):
    j = read(spark, sf, "lineitem").select("l_partkey", "l_quantity").join(read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return st.weighted_median(j, "p_size", "l_quantity", ["p_brand"])


@register("e05_mode", "WITH s AS (SELECT p_brand, p_name, COUNT(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS k FROM s) WHERE k=1")
def _(spark, sf):
    return st.most_common(read(spark, sf, "part"), "p_name", ["p_brand"])


@register("f03_movement_episodes", cte(_DICT_SQL, """
mv AS (SELECT *, LAG(latitude) OVER w AS pla, LAG(longitude) OVER w AS plo FROM dc WINDOW w AS (PARTITION BY city, station_key ORDER BY month)),
hv AS (SELECT *, 2*6371008.8e0*asin(sqrt(pow(sin(radians(latitude-pla)/2),2)+cos(radians(pla))*cos(radians(latitude))*pow(sin(radians(longitude-plo)/2),2))) AS m FROM mv)
""") + "SELECT city, station_key, month, ROUND(m, 3) + 0.0 AS movement, 1 + CAST(SUM(CASE WHEN m>100 THEN 1 ELSE 0 END) OVER (PARTITION BY city, station_key ORDER BY month) AS BIGINT) AS episode_id FROM hv")
def _(spark, sf):
    d = st.movement_episodes(dictionary(spark, sf), ["city", "station_key"], "month", "latitude", "longitude")
    return d.select("city", "station_key", "month", F.round("movement_from_previous_m", 3).alias("movement"), "episode_id")


@register("d04_resolve_by_month", cte(_DICT_SQL, """
wn AS (SELECT DISTINCT l_returnflag AS city, strftime(l_shipdate,'%Y-%m') AS month, 'I:' || ((l_suppkey*7)%120) AS station_key FROM lineitem),
mt AS (SELECT wn.*, dc.latitude, abs((CAST(substr(dc.month,1,4) AS INT)*12+CAST(substr(dc.month,6,2) AS INT))-(CAST(substr(wn.month,1,4) AS INT)*12+CAST(substr(wn.month,6,2) AS INT))) AS gap, dc.month AS dm FROM wn JOIN dc ON dc.city=wn.city AND dc.station_key=wn.station_key),
bs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city, month, station_key ORDER BY gap, dm) AS k FROM mt)
""") + f"SELECT city, month, station_key, {r('latitude','latitude')}, CASE WHEN gap=0 THEN 'historical_same_month' ELSE 'historical_nearest_month' END AS tier FROM bs WHERE k=1")
def _(spark, sf):
    li = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("city"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.concat(F.lit("I:"), ((F.col("l_suppkey") * 7) % 120).cast("string")).alias("station_key")).distinct()
    return st.resolve_by_month(li, dictionary(spark, sf), "city", "month", "station_key").select("city", "month", "station_key", "latitude", "tier")


@register("d04_resolve_stations")
def _(spark, sf):
    li = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("city"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey").cast("string")).alias("station_id"),
        F.lit(None).cast("string").alias("name"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit(38.9)).alias("source_lat"), F.when(F.col("l_partkey") % 2 == 0, F.lit(-77.0)).alias("source_lon"),
        (F.col("l_suppkey") % 20 == 0).alias("non_public"))
    d = dictionary(spark, sf).withColumn("name", F.lit(None).cast("string"))
    return st.resolve_stations(li, d).groupBy("city", "coordinate_source").agg(F.count("*").alias("n"), F.avg("latitude").alias("mean_lat"))


@register("d07_paired_losses", cte(*PREP) + f"SELECT a.split, COUNT(*) AS n, {r('AVG((a.y-a.zl)*(a.y-a.zl)-(b.y-b.b)*(b.y-b.b))','d')} FROM prep a JOIN prep b ON a.unit=b.unit AND a.period=b.period AND a.y=b.y GROUP BY 1")
def _(spark, sf):
    p = prepared(spark, sf)
    a = p.select("unit", "period", "y", "split", ((F.col("y") - F.col("zl")) ** 2).alias("e0"))
    b = p.select("unit", "period", "y", ((F.col("y") - F.col("b")) ** 2).alias("e1"))
    return a.join(b, ["unit", "period", "y"]).groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("e0") - F.col("e1")).alias("d"))


@register("d11_source_row_match", "SELECT COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority='1-URGENT')")
def _(spark, sf):
    sel = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return pn.within_domain(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), sel, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@register("d12_panel_adjustment", cte(P_EV, "sl AS (SELECT user_id AS unit, CAST(ts AS DATE) AS period, COUNT(*) AS s FROM events WHERE event_type='click' AND value > 20 GROUP BY ALL)") + "SELECT unit, CAST(period AS VARCHAR) AS period, x, CAST(x-COALESCE(s,0) AS BIGINT) AS x_adjusted FROM panel LEFT JOIN sl USING (unit, period)")
def _(spark, sf):
    sel = read(spark, sf, "events").where("event_type = 'click' AND value > 20").select(F.col("user_id").alias("unit"), F.to_date("ts").alias("period"))
    p = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END).select("unit", "period", "x")
    return sm.subtract_selected(p, sel, ["unit", "period"], "x")


# --- aggregates ---------------------------------------------------------------------------
@register("e01_pivot_types", "SELECT user_id AS unit, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, COUNT(*) FILTER (WHERE event_type='click') AS click, COUNT(*) FILTER (WHERE event_type='error') AS error, COUNT(*) FILTER (WHERE event_type='view') AS view, COUNT(*) FILTER (WHERE event_type='refund') AS refund, COUNT(*) AS total FROM events GROUP BY 1,2")
def _(spark, sf):
    ev = read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.to_date("ts").alias("period"), "event_type")
    kinds = {k: F.col("event_type") == k for k in ("click", "error", "view", "refund")}
    return pn.period_counts(ev, ["unit", "period"], {**kinds, "total": F.lit(True)})


@register("e02_endpoint_flow", """
WITH t AS (SELECT l_suppkey AS a, l_partkey%100 AS b, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE)+1 AS e FROM lineitem),
x AS (SELECT a AS place, s AS period, 0 AS i, 1 AS o FROM t UNION ALL SELECT b, e, 1, 0 FROM t)
SELECT place, CAST(period AS VARCHAR) AS period, CAST(SUM(i) AS BIGINT) AS inflow, CAST(SUM(o) AS BIGINT) AS outflow, CAST(SUM(i+o) AS BIGINT) AS total_flow, CAST(SUM(i-o) AS BIGINT) AS net_flow FROM x GROUP BY 1,2""")
def _(spark, sf):
    t = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), F.to_date("l_shipdate").alias("s"))
    return pn.endpoint_flow(t, ("a", F.col("s")), ("b", F.date_add("s", 1)))


@register("e03_trips_any_endpoint", "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS period, COUNT(*) AS trips FROM lineitem WHERE l_suppkey%5=0 OR l_partkey%5=0 GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "lineitem").where("l_suppkey % 5 = 0 OR l_partkey % 5 = 0").groupBy(F.to_date("l_shipdate").alias("period")).agg(F.count("*").alias("trips"))


@register("e06_reconciliation", cte(_EVENT_RULES_SQL) + "SELECT event_type, COUNT(*) AS physical_rows, COUNT(*) FILTER (WHERE reasons='') AS retained, COUNT(*) FILTER (WHERE reasons<>'') AS excluded, COUNT(*) FILTER (WHERE reasons LIKE '%outside_period%') AS outside FROM q GROUP BY 1")
def _(spark, sf):
    return au.reconcile(event_rows(spark, sf), ["event_type"], {"retained": F.col("reasons") == "", "excluded": F.col("reasons") != "", "outside": F.col("reasons").contains("outside_period")})


@register("e07_disposition", cte(_EVENT_RULES_SQL) + "SELECT event_type, CASE WHEN reasons='' THEN 'retained' ELSE split_part(reasons,'|',1) END AS disposition, COUNT(*) AS rows FROM q GROUP BY ALL")
def _(spark, sf):
    e = event_rows(spark, sf).withColumn("disposition", F.coalesce("primary_reason", F.lit("retained")))
    return au.disposition(e, ["event_type", "disposition"])


_AUDIT_SQL = """
a0 AS (SELECT event_id%4 AS file, user_id || '|' || event_type || '|' || CAST(value AS VARCHAR) AS sig, * FROM r),
ad AS (SELECT file, COUNT(*) AS rows, COUNT(*)-COUNT(DISTINCT (user_id, event_type, value)) AS repeated_rows, COUNT(*) FILTER (WHERE tt IS NULL) AS bad_time, COUNT(*) FILTER (WHERE tt < TIMESTAMP '2024-01-03' OR tt >= TIMESTAMP '2024-01-28') AS outside, COUNT(*) FILTER (WHERE lat>90) AS bad_place, CAST(0 AS BIGINT) AS no_type, COUNT(*) FILTER (WHERE event_type NOT IN ('error','click','view')) AS odd_type FROM a0 GROUP BY 1)
"""


def audited(spark, sf):
    ev = event_rows(spark, sf).withColumn("file", F.col("event_id") % 4)
    return au.audit_events(ev, "file", "at", "lat", "lon", "event_type", ["error", "click", "view"], "2024-01-03", "2024-01-28", ["user_id", "event_type", "value"]).drop("first_at", "last_at")


@register("e08_audit_events", cte(_EVENT_RULES_SQL, _AUDIT_SQL) + "SELECT * FROM ad")
def _(spark, sf):
    return audited(spark, sf)


@register("e09_audit_trips", """
WITH t AS (SELECT l_returnflag AS file, l_linenumber = 7 AS blank, l_orderkey, o_orderdate AS s, CASE WHEN l_linenumber <= 5 THEN l_shipdate END AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT file, COUNT(*) AS physical_rows, COUNT(*) FILTER (WHERE blank) AS blank_rows, COUNT(*) FILTER (WHERE NOT blank) AS rows,
COUNT(*) FILTER (WHERE NOT blank) - COUNT(DISTINCT CASE WHEN NOT blank THEN l_orderkey END) AS repeats, CAST(0 AS BIGINT) AS no_start,
COUNT(*) FILTER (WHERE NOT blank AND e IS NULL) AS no_end, COUNT(*) FILTER (WHERE NOT blank AND e < s) AS reversed, COUNT(*) FILTER (WHERE NOT blank AND e <= s) AS not_positive,
strftime(MIN(CASE WHEN NOT blank THEN s END), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(MAX(CASE WHEN NOT blank THEN s END), '%Y-%m-%d %H:%M:%S') AS last_start FROM t GROUP BY 1""")
def _(spark, sf):
    j = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_shipdate").join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    full = F.col("l_linenumber") != 7  # the last line of an order stands for a blank row
    j = j.select(F.col("l_returnflag").alias("file"), *[F.when(full, F.col(c)).alias(c) for c in ("l_orderkey", "o_orderdate")], F.when(F.col("l_linenumber") <= 5, F.col("l_shipdate")).alias("e"))
    return au.audit_trips(j, ["file"], "o_orderdate", "e", ["l_orderkey"], "l_orderkey")


@register("e10_issue_list", cte(_EVENT_RULES_SQL, _AUDIT_SQL) + " UNION ALL ".join(f"SELECT file, '{s}' AS severity, '{c}' AS code, {c} AS rows, '{a}' AS action FROM ad WHERE {c}>0" for c, s, a in (("bad_time", "error", "exclude"), ("outside", "warning", "exclude"), ("repeated_rows", "warning", "review"))))
def _(spark, sf):
    return au.issue_list(audited(spark, sf), ["file"], {"bad_time": ("error", "bad_time", "exclude"), "outside": ("warning", "outside", "exclude"), "repeated_rows": ("warning", "repeated_rows", "review")})


@register("e11_audit_summary", cte(_EVENT_RULES_SQL, _AUDIT_SQL) + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST(SUM({c}) AS DOUBLE) AS value FROM ad" for c in ("rows", "repeated_rows", "bad_time", "outside")) + " UNION ALL SELECT 'files', CAST(COUNT(*) AS DOUBLE) FROM ad")
def _(spark, sf):
    m = {c: F.sum(c) for c in ("rows", "repeated_rows", "bad_time", "outside")}
    return au.metric_table(audited(spark, sf), {**m, "files": F.count("*")})


@register("e12_descriptives", cte(P_EV) + f"SELECT month(period)*0 + isodow(period)-1 AS dow, COUNT(*) AS rows, CAST(SUM(x) AS BIGINT) AS total, {r('quantile_cont(x,0.5)','p50')}, {r('quantile_cont(x,0.9)','p90')}, {r('quantile_cont(x,0.99)','p99')}, MAX(x) AS maximum, {r('AVG(x)','mean')}, {r('STDDEV_SAMP(x)','sd')}, {r('AVG(CASE WHEN x=0 THEN 1e0 ELSE 0e0 END)','zero_share')} FROM panel GROUP BY 1")
def _(spark, sf):
    p = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END).withColumn("dow", calendars.day_of_week(F.col("period")))
    return sm.describe_counts(p, "x", ["dow"])


@register("e13_weekday_index", cte(P_OR, "w AS (SELECT isodow(period)-1 AS dow, AVG(y) AS mean FROM opanel GROUP BY 1)") + f"SELECT dow, {r('mean','mean')}, {r('100*mean/AVG(mean) OVER ()','index')} FROM w")
def _(spark, sf):
    return sm.weekday_index(orders_panel(spark, sf).withColumn("dow", calendars.day_of_week(F.col("period"))), "y", "dow")


@register("e13_peaks_and_weekend", cte(P_OR, "t AS (SELECT unit, month(period) AS m, SUM(y) AS v FROM opanel GROUP BY ALL)", "k AS (SELECT unit, m, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY v DESC, m) AS hi, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY v, m) AS lo FROM t)", "e AS (SELECT unit, AVG(y) FILTER (WHERE isodow(period)>=6)/AVG(y) FILTER (WHERE isodow(period)<6) AS w FROM opanel GROUP BY 1)") + f"SELECT unit, MAX(m) FILTER (WHERE hi=1) AS peak, MAX(m) FILTER (WHERE lo=1) AS trough, {r('MAX(w)','weekend_ratio')} FROM k JOIN e USING (unit) GROUP BY unit")
def _(spark, sf):
    p = orders_panel(spark, sf).withColumn("m", F.month("period"))
    return sm.peaks(p, "y", "m", ["unit"]).join(sm.weekend_ratio(p, "y", F.weekday("period") >= 5, ["unit"]), "unit")


@register("e14_class_shares", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total, {r('COUNT(*)*1e0/SUM(COUNT(*)) OVER (PARTITION BY l_returnflag)','share')} FROM lineitem GROUP BY 1,2")
def _(spark, sf):
    return au.class_shares(read(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus")


@register("e22_multiscale", "SELECT CAST(p_size//10 AS BIGINT) AS x, CAST(s_nationkey//2 AS BIGINT) AS y, l_returnflag, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2,3")
def _(spark, sf):
    j = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(read(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    fine = j.groupBy(F.floor(F.col("p_size") / 5).alias("x"), F.col("s_nationkey").cast("long").alias("y"), "l_returnflag").agg(F.count("*").alias("n"))
    return pn.coarsen(fine, 2, "x", "y", ["l_returnflag"], ["n"])


_WEEK = lambda having: f"SELECT unit, CAST(CAST(date_trunc('week', period) AS DATE) AS VARCHAR) AS period_start, CAST(MAX(period) AS VARCHAR) AS period_end, COUNT(*) AS days_in_period, CAST(SUM(y) AS BIGINT) AS y, CAST(SUM(x) AS BIGINT) AS x FROM opanel GROUP BY unit, date_trunc('week', period) {having}"


@register("e23_weekly_complete", cte(P_OR) + _WEEK("HAVING COUNT(*)=7"))
def _(spark, sf):
    return pn.to_weekly(orders_panel(spark, sf), ["unit"], "period", ["y", "x"])


@register("e23_weekly_all", cte(P_OR) + _WEEK(""))
def _(spark, sf):
    return pn.to_weekly(orders_panel(spark, sf), ["unit"], "period", ["y", "x"], complete_only=False)


_LABEL = lambda c: f"CASE WHEN {c} <= DATE '{OR_TRAIN_END}' THEN 'train' WHEN {c} <= DATE '{OR_VALID_END}' THEN 'validation' ELSE 'test' END"


@register("e23_weekly_split", cte(P_OR, "wk AS (SELECT unit, CAST(date_trunc('week', period) AS DATE) AS a, MAX(period) AS b, SUM(y) AS y FROM opanel GROUP BY unit, date_trunc('week', period))")
    + " UNION ALL ".join(f"SELECT '{k}' AS split_by, {_LABEL(c)} AS split, COUNT(*) AS weeks, CAST(SUM(y) AS BIGINT) AS y FROM wk GROUP BY ALL" for k, c in (("start", "a"), ("end", "b"))))
def _(spark, sf):
    label = lambda c: split_label(c, OR_TRAIN_END, OR_VALID_END)
    parts = []
    for by in ("start", "end"):
        weeks = pn.to_weekly(orders_panel(spark, sf), ["unit"], "period", ["y"], complete_only=False, split=label, split_by=by)
        parts.append(weeks.groupBy(F.lit(by).alias("split_by"), "split").agg(F.count("*").alias("weeks"), F.sum("y").alias("y")))
    return parts[0].unionByName(parts[1])


@register("d01_window_disposition", f"""
SELECT CASE WHEN CAST(l_shipdate AS DATE) < DATE '{OR_START}' THEN 'before' WHEN CAST(l_shipdate AS DATE) > DATE '{OR_END}' THEN 'after' ELSE 'inside' END AS place,
COUNT(*) AS rows, CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1""")
def _(spark, sf):
    shipped = read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("period"), "l_linenumber")
    return pn.window_disposition(shipped, "period", ["l_linenumber"], OR_START, OR_END)


@register("e24_week_bounds", "WITH b AS (SELECT c_nationkey AS unit, CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1), f AS (SELECT unit, lo + CAST((8-isodow(lo))%7 AS INTEGER) AS first, hi - CAST(CASE WHEN isodow(hi)=7 THEN 6 ELSE isodow(hi)+6 END AS INTEGER) AS last FROM b) SELECT CAST(unit AS BIGINT) AS unit, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, CAST((last-first)//7+1 AS BIGINT) AS weeks FROM f")
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("unit")), F.col("o_custkey") == F.col("c_custkey"))
    b = o.groupBy("unit").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    f, l, w = pn.complete_week_bounds(F.col("lo"), F.col("hi"))
    return b.select("unit", f.alias("first"), l.alias("last"), w.alias("weeks"))


_FC = "fc AS (SELECT *, (zl*2+b)/3e0 AS c, floor((zl*2+b)/3e0+0.5e0) AS k FROM prep)"


@register("e25_forecast_metrics", cte(*PREP, _FC) + f"SELECT split, COUNT(*) AS n, {r('AVG((y-k)*(y-k))','mse_integer')}, {r('sqrt(AVG((y-k)*(y-k)))','rmse_integer')}, {r('AVG(abs(y-k))','mae_integer')}, {r('AVG((y-c)*(y-c))','mse_continuous')}, {r('AVG(2*(CASE WHEN y>0 THEN y*ln(y/GREATEST(c,1e-12)) ELSE 0 END - (y-GREATEST(c,1e-12))))','poisson_deviance')}, {r('AVG(CASE WHEN y=k THEN 1e0 ELSE 0e0 END)','exact_share')}, {r('SUM(c)/SUM(y)','total_ratio')} FROM fc GROUP BY split")
def _(spark, sf):
    from tallyfloor.functions.states import half_up

    p = prepared(spark, sf).withColumn("c", (F.col("zl") * 2 + F.col("b")) / 3.0)
    return sm.forecast_metrics(p.withColumn("k", half_up(F.col("c"))), "y", "c", "k", ["split"])


@register("e26_local_gain", cte(*PREP) + f"SELECT unit, COUNT(*) AS n, {r('AVG((y-zl)*(y-zl))','mse_base')}, {r('AVG((y-b)*(y-b))','mse_side')}, {r('AVG((y-zl)*(y-zl))-AVG((y-b)*(y-b))','gain')}, {r('CASE WHEN AVG((y-zl)*(y-zl))>0 THEN (AVG((y-zl)*(y-zl))-AVG((y-b)*(y-b)))/AVG((y-zl)*(y-zl)) END','relative_gain')} FROM prep WHERE split<>'train' GROUP BY unit")
def _(spark, sf):
    p = prepared(spark, sf).where("split <> 'train'").withColumns({"e0": (F.col("y") - F.col("zl")) ** 2, "e1": (F.col("y") - F.col("b")) ** 2})
    return sm.forecast_gain(p, "e0", "e1", ["unit"])


@register("e27_composition", "SELECT event_type, CAST(SUM(n) AS BIGINT) AS events, ROUND(AVG(n), 8) + 0.0 AS mean, ROUND(AVG(CASE WHEN n=0 THEN 1e0 ELSE 0e0 END), 8) + 0.0 AS zero_share, ROUND(CAST(SUM(n) AS DOUBLE)/SUM(SUM(n)) OVER (), 8) + 0.0 AS share FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    t = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sm.composition(t, "event_type", "n", [])


_UI = (*PREP, sql_info("prep", ["unit"], ["zl"], "b", "y"))


def by_unit(spark, sf):
    return info.conditional_information(info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["unit"]), ["zl"], "b", "y", ["unit"])


@register("e28_local_summary", cte(*_UI) + f"SELECT COUNT(*) AS units, COUNT(*) FILTER (WHERE cmi>0) AS positive, {r('AVG(cmi)','mean_cmi')}, {r('median(cmi)','median_cmi')}, {r('median(h0)','median_h0')} FROM i")
def _(spark, sf):
    from tallyfloor.operators.settle import settle

    u = settle(by_unit(spark, sf))
    med = ordering.quantiles(u, "cmi", {"c": 0.5}), ordering.quantiles(u, "h0", {"h": 0.5})
    return u.agg(F.count("*").alias("units"), F.count_if(F.col("cmi") > 0).alias("positive"), F.avg("cmi").alias("mean_cmi")).withColumns({"median_cmi": med[0].scalar(), "median_h0": med[1].scalar()})


@register("e29_local_to_pooled", cte(*_UI, sql_info("prep", [], ["unit", "zl"], "b", "y", "1", "pl")) + f"SELECT {r('(SELECT h0 FROM pl)','pooled_h0')}, {r('SUM(n*h0)/SUM(n)','weighted_h0')}, {r('(SELECT hb FROM pl)','pooled_hb')}, {r('SUM(n*hb)/SUM(n)','weighted_hb')} FROM i")
def _(spark, sf):
    pooled = info.conditional_information(info.joint_counts(prepared(spark, sf), ["unit", "zl"], "b", "y"), ["unit", "zl"], "b", "y")
    w = by_unit(spark, sf).agg((F.sum(F.col("n") * F.col("h0")) / F.sum("n")).alias("weighted_h0"), (F.sum(F.col("n") * F.col("hb")) / F.sum("n")).alias("weighted_hb"))
    return w.withColumns({"pooled_h0": pooled.select("h0").scalar(), "pooled_hb": pooled.select("hb").scalar()})


@register("e30_coverage_mixture", cte(*PREP, "cv AS (SELECT *, CASE WHEN unit%3=0 THEN 'out' ELSE 'in' END AS dom FROM prep)", sql_info("cv", ["dom"], ["unit", "zl"], "b", "y")) + f"SELECT {r('MAX(CASE WHEN dom=$$in$$ THEN n/(SELECT SUM(n) FROM i) END)','inside_share')}, {r('SUM(n/(SELECT SUM(n) FROM i)*cmi)','mixture_cmi')} FROM i")
def _(spark, sf):
    p = prepared(spark, sf).withColumn("dom", F.when(F.col("unit") % 3 == 0, "out").otherwise("in"))
    parts = info.conditional_information(info.joint_counts(p, ["unit", "zl"], "b", "y", ["dom"]), ["unit", "zl"], "b", "y", ["dom"])
    return sm.coverage_mixture(parts, "dom", "in", "n", "cmi")


_MODAL = """
tr AS (SELECT dow, zl, b, LEAST(y,2) AS c, COUNT(*) AS n FROM prep WHERE split='train' GROUP BY ALL),
md AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dow, zl, b ORDER BY n DESC, c) AS k FROM tr),
gl AS (SELECT c FROM tr GROUP BY c ORDER BY SUM(n) DESC, c LIMIT 1),
tt AS (SELECT p.*, LEAST(p.y,2) AS cy, md.c AS m FROM prep p LEFT JOIN md ON md.dow=p.dow AND md.zl=p.zl AND md.b=p.b AND md.k=1 WHERE p.split='test')
"""


@register("e31_modal_error", cte(*PREP, _MODAL) + f"SELECT COUNT(*) AS test_rows, {r('AVG(CASE WHEN COALESCE(m,(SELECT c FROM gl))<>cy THEN 1e0 ELSE 0e0 END)','test_error')}, COUNT(*) FILTER (WHERE m IS NULL) AS unseen, {r('COUNT(*) FILTER (WHERE m IS NULL)*1e0/COUNT(*)','unseen_share')}, "
    + "(SELECT " + r("1 - SUM(hit)*1e0/SUM(n)", "train_error") + " FROM (SELECT MAX(k) AS hit, SUM(k) AS n FROM (SELECT dow, zl, b, LEAST(y,2) AS c, COUNT(*) AS k FROM prep WHERE split='train' GROUP BY ALL) GROUP BY dow, zl, b)) AS train_error FROM tt")
def _(spark, sf):
    from tallyfloor.functions.states import class_three

    p = prepared(spark, sf).withColumn("c", class_three(F.col("y")))
    return sm.modal_error(p.where("split = 'train'"), p.where("split = 'test'"), ["dow", "zl", "b"], "c")


@register("e41_unseen_share", cte(*PREP, "s AS (SELECT DISTINCT unit, zl, b FROM prep WHERE split='train')") + f"SELECT COUNT(*) AS test_rows, COUNT(*) FILTER (WHERE s.unit IS NULL) AS unseen, {r('COUNT(*) FILTER (WHERE s.unit IS NULL)*1e0/COUNT(*)','unseen_share')} FROM prep p LEFT JOIN s ON s.unit=p.unit AND s.zl=p.zl AND s.b=p.b WHERE split='test'")
def _(spark, sf):
    p = prepared(spark, sf)
    return sm.modal_error(p.where("split = 'train'"), p.where("split = 'test'"), ["unit", "zl", "b"], "y").drop("test_error", "train_error")


@register("e32_error_slack", cte(*PREP, _FC, """
t AS (SELECT split, y-k AS e, k AS f, COUNT(*) AS n FROM fc GROUP BY ALL), j AS (SELECT split, SUM(n) AS n, SUM(n*ln(n)) AS ef, SUM(n*e*e) AS ss FROM t GROUP BY 1),
e AS (SELECT split, SUM(c*ln(c)) AS ee FROM (SELECT split, e, CAST(SUM(n) AS DOUBLE) AS c FROM t GROUP BY ALL) GROUP BY 1), f AS (SELECT split, SUM(c*ln(c)) AS ff FROM (SELECT split, f, CAST(SUM(n) AS DOUBLE) AS c FROM t GROUP BY ALL) GROUP BY 1)
""") + f"SELECT split, CAST(n AS BIGINT) AS n, {r('ss/n','mean_square')}, {r('(n*ln(n)-ee)/(n*ln(2.0))','h_error')}, {r('(n*ln(n)-ef)/(n*ln(2.0))','h_joint')}, {r('(n*ln(n)-ff)/(n*ln(2.0))','h_forecast')}, {r('(n*ln(n)-ee-ff+ef)/(n*ln(2.0))','information')} FROM j JOIN e USING (split) JOIN f USING (split)")
def _(spark, sf):
    from tallyfloor.functions.states import half_up

    p = prepared(spark, sf).withColumn("k", half_up((F.col("zl") * 2 + F.col("b")) / 3.0))
    return sm.error_slack(p.withColumn("e", F.col("y") - F.col("k")), "e", "k", ["split"]).drop("h_max", "law_distance")


@register("e33_occupancy", f"WITH c AS (SELECT c_nationkey AS cell, c_mktsegment AS seg, COUNT(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderdate <= TIMESTAMP '{OR_TRAIN_END} 23:59:59' GROUP BY ALL) SELECT seg, COUNT(*) AS active_cells, {r('AVG(n)','mean_per_cell')}, AVG(n) >= 50 AS promote FROM c GROUP BY seg")
def _(spark, sf):
    o = read(spark, sf, "orders").where(F.to_date("o_orderdate") <= F.lit(OR_TRAIN_END).cast("date")).select("o_custkey").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return c.groupBy("seg").agg(F.count("*").alias("active_cells"), F.avg("n").alias("mean_per_cell"), (F.avg("n") >= 50).alias("promote"))


_SPLITI = (*PREP, sql_info("prep", ["split", "dow"], ["zl"], "b", "y"))


def by_split_dow(spark, sf):
    return info.conditional_information(info.joint_counts(prepared(spark, sf), ["zl"], "b", "y", ["split", "dow"]), ["zl"], "b", "y", ["split", "dow"])


@register("e34_domain_wide", cte(*_SPLITI) + f"SELECT CAST(dow AS BIGINT) AS dow, {r('MAX(h0) FILTER (WHERE split=$$train$$)','train')}, {r('MAX(h0) FILTER (WHERE split=$$test$$)','test')}, {r('MAX(h0) FILTER (WHERE split=$$test$$)/MAX(h0) FILTER (WHERE split=$$train$$)','test_over_train')} FROM i GROUP BY dow")
def _(spark, sf):
    return sm.wide_ratio(by_split_dow(spark, sf), ["dow"], "split", ["train", "test"], "h0")


@register("e35_sign_count", cte(*_SPLITI) + f"SELECT split, COUNT(*) AS specs, COUNT(*) FILTER (WHERE cmi>0) AS positive, {r('MIN(cmi)','lowest')}, {r('MAX(cmi)','highest')} FROM i GROUP BY split")
def _(spark, sf):
    return sm.sign_count(by_split_dow(spark, sf), "cmi", ["split"])


@register("e36_anonymised_counts", cte(*PREP, f"s AS (SELECT dow, zl, ROW_NUMBER() OVER (ORDER BY sha256('salt|' || dow || '|' || zl)) AS baseline_state_id FROM (SELECT DISTINCT dow, zl FROM prep))") + "SELECT baseline_state_id, CAST(b AS BIGINT) AS b, y, COUNT(*) AS n FROM prep JOIN s USING (dow, zl) GROUP BY ALL")
def _(spark, sf):
    c = info.joint_counts(prepared(spark, sf), B, "b", "y")
    key = F.sha2(F.concat_ws("|", F.lit("salt"), "dow", "zl"), 256)
    ids = ordering.cumulative_counts(c.select(*B, key.alias("h")).distinct(), "h").select("h", (F.col("n_below") + 1).alias("baseline_state_id"))
    return c.withColumn("h", key).join(ids, "h").select("baseline_state_id", "b", "y", "n")


@register("e37_rebuild_from_counts", cte(*PREP, "ct AS (SELECT dow, zl, b, y, COUNT(*) AS c FROM prep GROUP BY ALL)", sql_info("ct", [], ["dow", "zl"], "b", "y", "c"), f"g AS (SELECT *, {sql_floor('h0')} AS l0, {sql_floor('hb')} AS lb FROM i)") + f"SELECT CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('hb','hb')}, {r('l0','l0')}, {r('lb','lb')} FROM g")
def _(spark, sf):
    from tallyfloor.operators.settle import settle

    stored = settle(info.joint_counts(prepared(spark, sf), B, "b", "y"))
    return bounds.attach_floors(info.conditional_information(stored, B, "b", "y"), "h0", "hb").select("n", "h0", "hb", "l0", "lb")


def documents_rows(spark, sf):
    return read(spark, sf, "documents").select("source", "doc_id", "text", "lang")


@register("e42_repeated_rows", "SELECT source, doc_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS k FROM documents) WHERE k>1")
def _(spark, sf):
    return au.repeated_rows(documents_rows(spark, sf), "source", "doc_id", ["lang", "text"]).select("source", "doc_id")


@register("e38_repeat_decision", f"SELECT source, COUNT(*) AS rows, COUNT(*) FILTER (WHERE k>1) AS repeats, {r('COUNT(*) FILTER (WHERE k>1)*1e0/COUNT(*)','repeat_share')}, COUNT(*) FILTER (WHERE k>1)*2 AS worst_case_endpoints FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS k FROM documents) GROUP BY 1")
def _(spark, sf):
    d = documents_rows(spark, sf)
    return au.repeat_decision(d, au.repeated_rows(d, "source", "doc_id", ["lang", "text"]), "source")


@register("e39_quarterly", f"SELECT c_nationkey::BIGINT AS unit, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, {r('AVG(o_totalprice-250000)','mean_gain')}, {r('AVG(CASE WHEN o_totalprice>250000 THEN 1e0 ELSE 0e0 END)','positive_share')} FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY ALL")
def _(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("unit")), F.col("o_custkey") == F.col("c_custkey"))
    g = F.col("o_totalprice") - 250000
    return o.groupBy("unit", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.avg(g).alias("mean_gain"), F.avg((g > 0).cast("double")).alias("positive_share"))


@register("e43_station_exceptions", "SELECT l_suppkey, CASE WHEN l_suppkey%20=0 THEN 'non_public_node' ELSE 'unresolved_public_or_unknown' END AS classification, COUNT(*) AS row_count FROM lineitem WHERE l_suppkey%20=0 OR l_suppkey%20=7 GROUP BY ALL")
def _(spark, sf):
    m = F.col("l_suppkey") % 20
    li = read(spark, sf, "lineitem").select("l_suppkey", F.when(m == 0, "non_public_node").when(m == 7, "unresolved").otherwise("source").alias("src"))
    return au.station_exceptions(li, ["l_suppkey"], "src")


@register("e44_monthly_reconciliation", "SELECT c_nationkey::BIGINT AS unit, strftime(o_orderdate,'%Y-%m') AS month, COUNT(*) AS physical_rows, COUNT(*) FILTER (WHERE o_orderstatus='F') AS retained FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY ALL")
def _(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("unit")), F.col("o_custkey") == F.col("c_custkey")).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return au.reconcile(o, ["unit", "month"], {"retained": F.col("o_orderstatus") == "F"})


# --- ranks, runs, sets --------------------------------------------------------------------
@register("f02_longest_run", cte(P_EV, "m AS (SELECT unit, period, x=0 AS z, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY period) - ROW_NUMBER() OVER (PARTITION BY unit, x=0 ORDER BY period) AS g FROM panel)", "l AS (SELECT unit, z, g, COUNT(*) AS n FROM m GROUP BY ALL)") + "SELECT unit, COALESCE(MAX(n) FILTER (WHERE z), 0) AS max_zero_run FROM l GROUP BY unit")
def _(spark, sf):
    p = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    return ordering.longest_run(p, ["unit"], "period", F.col("x") == 0, "max_zero_run")


_ELIG = """
run AS (SELECT unit, MAX(n) FILTER (WHERE z) AS mr FROM (SELECT unit, z, g, COUNT(*) AS n FROM (SELECT unit, x1=0 AS z, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY period) - ROW_NUMBER() OVER (PARTITION BY unit, x1=0 ORDER BY period) AS g FROM prep) GROUP BY ALL) GROUP BY 1),
el AS (SELECT prep.unit, COUNT(*) AS valid_days, SUM(y) AS total_events, COUNT(*) FILTER (WHERE x1>0) AS pos, COUNT(DISTINCT y) AS ty, COUNT(DISTINCT b) AS tb, COALESCE(ANY_VALUE(mr),0) AS mr FROM prep JOIN run ON run.unit=prep.unit GROUP BY 1)
"""


@register("c07_eligible_units", cte(*PREP, _ELIG) + "SELECT unit, valid_days, CAST(total_events AS BIGINT) AS total_events, concat_ws(';', CASE WHEN total_events<5 THEN 'insufficient_events' END, CASE WHEN pos<8 THEN 'insufficient_positive_side_days' END, CASE WHEN mr>10 THEN 'coverage_discontinuity' END, CASE WHEN ty<2 THEN 'insufficient_target_states' END, CASE WHEN tb<3 THEN 'insufficient_side_states' END) AS exclusion_reasons FROM el")
def _(spark, sf):
    p = prepared(spark, sf)
    run = ordering.longest_run(p, ["unit"], "period", F.col("x1") == 0, "max_zero_run")
    rules = {"valid_days": 20, "events": 5, "positive_side_days": 8, "zero_run": 10, "target_states": 2, "side_states": 3}
    return au.eligible_units(p, "unit", "period", "y", "x1", "b", rules, run).select("unit", "valid_days", "total_events", "exclusion_reasons")


@register("f04_block_ids", cte(P_EV, "m AS (SELECT MIN(period) AS lo FROM panel)") + "SELECT CAST((period-lo)//7 AS BIGINT) AS block_id, COUNT(*) AS n, CAST(MIN(period) AS VARCHAR) AS first FROM panel, m GROUP BY 1")
def _(spark, sf):
    p = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    return pn.block_ids(p, "period", 7, pn.first_period(p, "period")).groupBy("block_id").agg(F.count("*").alias("n"), F.min("period").alias("first"))


_EXP = (0.5, 0.75, 1.0)


@register("f07_expanding_windows", cte(P_EV, "pp AS (SELECT *, LEAST(y1,3) AS zl, DENSE_RANK() OVER (ORDER BY period) AS k FROM lagged WHERE y1 IS NOT NULL)",
    *[f"c{i} AS (SELECT quantile_cont(x1,1.0/3) AS c1, quantile_cont(x1,2.0/3) AS c2 FROM pp WHERE x1>0 AND k <= {'(SELECT MAX(k) FROM pp)' if f == 1 else f'GREATEST(1, round_even((SELECT MAX(k) FROM pp)*{f},0))'}), e{i} AS (SELECT zl, y, CASE WHEN x1=0 THEN 0 WHEN x1<=c1 THEN 1 WHEN x1<=c2 THEN 2 ELSE 3 END AS b FROM pp, c{i} WHERE k <= {'(SELECT MAX(k) FROM pp)' if f == 1 else f'GREATEST(1, round_even((SELECT MAX(k) FROM pp)*{f},0))'}), " + sql_info(f"e{i}", [], ["zl"], "b", "y", "1", f"i{i}") for i, f in enumerate(_EXP)])
    + " UNION ALL ".join(f"SELECT {f}e0 AS fraction, CAST(n AS BIGINT) AS n, {r('h0','h0')}, {r('cmi','cmi')} FROM i{i}" for i, f in enumerate(_EXP)))
def _(spark, sf):
    from tallyfloor.functions.states import count_code

    p = events_panel(spark, sf).where("y1 IS NOT NULL").withColumn("zl", count_code(F.col("y1")))
    return sm.expanding_information(p, "period", _EXP, ["zl"], "zl", "x1", "y").select("fraction", "n", "h0", "cmi")


_US = "us AS (SELECT c_custkey AS unit, CAST(SUM(o_totalprice) AS DOUBLE) AS v, COUNT(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1)"


def unit_totals(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


@register("f09_rank_strata", cte(_US, "rk AS (SELECT unit, ROW_NUMBER() OVER (ORDER BY n, unit) AS k, COUNT(*) OVER () AS t FROM us)") + "SELECT unit, CAST(" + "+".join(f"(CASE WHEN k > 1+(t-1)*{i}/5e0 THEN 1 ELSE 0 END)" for i in range(1, 5)) + " AS BIGINT) AS stratum FROM rk")
def _(spark, sf):
    return sm.equal_rank_strata(unit_totals(spark, sf), "n", "unit", 5, "stratum").select("unit", "stratum")


@register("f10_spread_units", cte(_US, "rk AS (SELECT unit, n, ROW_NUMBER() OVER (ORDER BY n, unit) AS k, COUNT(*) OVER () AS t FROM us)") + "SELECT unit, n, k AS rank FROM rk WHERE k IN (SELECT CAST(floor((t-1)*i/8e0+0.5)+1 AS BIGINT) FROM rk r2, range(9) g(i) WHERE r2.k=1)")
def _(spark, sf):
    return sm.spread_units(unit_totals(spark, sf), "n", "unit", 9).select("unit", "n", "rank")


@register("f11_top_share", cte(_US, "rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC) AS k, COUNT(*) OVER () AS t FROM us)") + f"SELECT MAX(t) AS units, {r('SUM(CASE WHEN k<=ceil(t*0.1e0) THEN n ELSE 0 END)/SUM(n)','top_share')} FROM rk")
def _(spark, sf):
    return ordering.top_share(unit_totals(spark, sf), "n", 0.1)


@register("f12_spearman", cte("us AS (SELECT c_nationkey::BIGINT AS g, o_totalprice AS a, CAST(o_orderkey%1000 AS DOUBLE) AS b FROM orders JOIN customer ON o_custkey=c_custkey)", "rk AS (SELECT g, RANK() OVER (PARTITION BY g ORDER BY a)+(COUNT(*) OVER (PARTITION BY g, a)-1)/2e0 AS ra, RANK() OVER (PARTITION BY g ORDER BY b)+(COUNT(*) OVER (PARTITION BY g, b)-1)/2e0 AS rb FROM us)") + f"SELECT g, COUNT(*) AS n, {r('CORR(ra,rb)','rho')} FROM rk GROUP BY g")
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("a"), (F.col("o_orderkey") % 1000).cast("double").alias("b")).join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), F.col("o_custkey") == F.col("c_custkey"))
    return ordering.spearman(o, "a", "b", ["g"])


@register("f14_median_classes", cte(_US, "md AS (SELECT median(v) AS mv, median(n) AS mn FROM us)") + "SELECT unit, CASE WHEN v>mv THEN 'high_theory' ELSE 'low_theory' END || '__' || CASE WHEN n>mn THEN 'high_empirical' ELSE 'low_empirical' END AS median_class FROM us, md")
def _(spark, sf):
    return ordering.median_classes(unit_totals(spark, sf), "v", "n").select("unit", "median_class")


@register("f15_best_candidate", "SELECT p_brand, p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS k FROM part) WHERE k=1")
def _(spark, sf):
    return ordering.best_candidate(read(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], ["p_size", "p_retailprice", "p_partkey"])


@register("f17_union_by_name", "SELECT 'c' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, sf):
    c = read(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@register("f18_set_operations", "SELECT 'both' AS part, COUNT(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'orders_only', COUNT(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)")
def _(spark, sf):
    a, b = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf, "events").select(F.col("user_id").alias("k"))
    n = lambda d, t: d.agg(F.lit(t).alias("part"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.distinct().join(b, "k", "left_anti"), "orders_only"))


@register("f19_replay", cte(P_EV, "n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY period)-1 AS i FROM panel)") + "SELECT unit, k AS replay_row, k//30 AS cycle, y FROM n, range(100) g(k) WHERE k%30=i")
def _(spark, sf):
    p = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    return sm.replay(p, "period", 100, ["unit"]).select("unit", "replay_row", "cycle", "y")


@register("f20_distinct_catalogue", "SELECT DISTINCT c_nationkey::BIGINT AS unit, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("segment")).distinct()


# --- floors -------------------------------------------------------------------------------
_HS = f"hs AS (SELECT p_brand, AVG(p_size)/12e0 AS h FROM part GROUP BY 1)"


def brand_h(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand").agg((F.avg("p_size") / 12.0).alias("h"))


@register("g01_exact_floor", cte(_HS) + f"SELECT p_brand, {r('h','h')}, {r(sql_floor('h'),'floor')} FROM hs")
def _(spark, sf):
    return brand_h(spark, sf).withColumn("floor", bounds.exact_floor("h"))


@register("g02_interpolated_floor", cte(_HS) + f"SELECT p_brand, ROUND({sql_floor('h')}, 4) + 0.0 AS floor FROM hs")
def _(spark, sf):
    return bounds.interp_floor(brand_h(spark, sf), "h", bounds.floor_table(spark), "floor").select("p_brand", F.round("floor", 4).alias("floor"))


@register("g03_closed_floor", cte(_HS) + f"SELECT p_brand, {r('GREATEST(0, pow(2e0,2*h)/(2*pi()*exp(1e0))-1e0/12)','floor')} FROM hs")
def _(spark, sf):
    return brand_h(spark, sf).select("p_brand", bounds.closed_floor(F.col("h")).alias("floor"))


@register("g04_max_entropy", cte("d AS (SELECT p_brand, VAR_POP(p_size)/50 AS v FROM part GROUP BY 1)", f"s AS (SELECT p_brand, v, list_reduce([CAST(k AS DOUBLE) FOR k IN range(56)], lambda lo, i: CASE WHEN {sql_d_of_lambda('exp(lo + 19e0*pow(0.5e0,i))')} >= v THEN lo + 19e0*pow(0.5e0,i) ELSE lo END, -32e0) AS t FROM d)", "l AS (SELECT p_brand, exp(t) AS lam FROM s)") + f"SELECT p_brand, {r('lam','rate')}, {r(sql_h_of_lambda('lam'),'entropy')} FROM l")
def _(spark, sf):
    d = read(spark, sf, "part").groupBy("p_brand").agg((F.var_pop("p_size") / 50).alias("v"))
    return d.select("p_brand", bounds.law_rate("v").alias("rate"), bounds.max_entropy("v").alias("entropy"))


@register("g06_fano_floor", cte("d AS (SELECT p_brand, AVG(p_size)/25e0 AS h FROM part GROUP BY 1)") + "SELECT p_brand, " + ", ".join(
    r(f"CASE WHEN h >= log2({k}e0) THEN {1 - 1 / k!r}e0 ELSE list_reduce([CAST(q AS DOUBLE) FOR q IN range(54)], lambda lo, i: CASE WHEN -(lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i))*log2(lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i)) - (1-(lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i)))*log2(1-(lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i))) + (lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i))*log2({k - 1}e0) <= h THEN lo+{(1 - 1 / k) / 2!r}e0*pow(0.5e0,i) ELSE lo END, 0e0) END", f"e{k}") for k in (2, 3)) + " FROM d")
def _(spark, sf):
    d = read(spark, sf, "part").groupBy("p_brand").agg((F.avg("p_size") / 25.0).alias("h"))
    return d.select("p_brand", bounds.fano_floor("h", 2).alias("e2"), bounds.fano_floor("h", 3).alias("e3"))


@register("g06_fano_labels", f"""
WITH j AS (SELECT l.quality AS y, d.lang AS s FROM labels l JOIN documents d USING (doc_id)), a AS (SELECT s, y, CAST(COUNT(*) AS DOUBLE) AS c FROM j GROUP BY ALL),
z AS (SELECT s, SUM(c) AS ns, SUM(c*ln(c)) AS f FROM a GROUP BY 1) SELECT CAST(SUM(ns) AS BIGINT) AS n, {r('(SUM(ns*ln(ns))-SUM(f))/(SUM(ns)*ln(2.0))','h')} FROM z""")
def _(spark, sf):
    j = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("one", F.lit(0))
    c = info.joint_counts(j, ["lang"], "one", "quality")
    return info.conditional_information(c, ["lang"], "one", "quality").select("n", F.col("h0_plugin").alias("h"))


@register("g07_gap_metrics", cte(*_UI, "m AS (SELECT unit, AVG((y-zl)*(y-zl)) AS m0, AVG((y-b)*(y-b)) AS m1 FROM prep GROUP BY 1)", f"f AS (SELECT unit, m0, m1, GREATEST(h0,0) AS p0, LEAST(GREATEST(hb,0),GREATEST(h0,0)) AS pb FROM i JOIN m USING (unit) WHERE m0>0 AND m1>0)", f"g AS (SELECT *, {sql_floor('p0')} AS l0, {sql_floor('pb')} AS lb FROM f)") + f"SELECT unit, {r('m0-l0','gap_base')}, {r('m1-lb','gap_side')}, {r('m0-m1','delta_mse')}, {r('l0-lb','delta_l')}, {r('(m0-l0)-(m1-lb)','gap_narrowing')} FROM g")
def _(spark, sf):
    p = prepared(spark, sf)
    m = p.groupBy("unit").agg(F.avg((F.col("y") - F.col("zl")) ** 2).alias("m0"), F.avg((F.col("y") - F.col("b")) ** 2).alias("m1")).where("m0 > 0 AND m1 > 0")
    j = bounds.attach_floors(by_unit(spark, sf).select("unit", "h0", "hb"), "h0", "hb").join(m, "unit")
    return bounds.gap_metrics(j, "m0", "m1", "l0", "lb").select("unit", "gap_base", "gap_side", "delta_mse", "delta_l", "gap_narrowing")


@register("g08_by_estimator", cte(*PREP, sql_info("prep", ["split"], ["dow", "zl"], "b", "y")) + f"SELECT split, 'plugin' AS estimator, {r('h0_plugin','h0')}, {r('hb_plugin','hb')} FROM i UNION ALL SELECT split, 'miller_madow', {r('h0','h0')}, {r('hb','hb')} FROM i")
def _(spark, sf):
    c = info.conditional_information(info.joint_counts(prepared(spark, sf), B, "b", "y", ["split"]), B, "b", "y", ["split"])
    return bounds.by_estimator(c, ["split"], {"plugin": {"h0": "h0_plugin", "hb": "hb_plugin"}, "miller_madow": {"h0": "h0", "hb": "hb"}})


# --- repair -------------------------------------------------------------------------------
@register("l01_reclassify", "SELECT coordinate_source, flags, COUNT(*) AS n, COUNT(*) FILTER (WHERE changed) AS changed FROM (SELECT l_suppkey IN (20,40) AS changed, CASE WHEN l_suppkey%20=0 AND l_suppkey NOT IN (20,40) THEN 'non_public_node' ELSE 'source' END AS coordinate_source, CASE WHEN l_suppkey%20=0 AND l_suppkey NOT IN (20,40) THEN 'np|late' ELSE 'late' END AS flags FROM lineitem) GROUP BY 1,2")
def _(spark, sf):
    np = F.col("l_suppkey") % 20 == 0
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("station_id"), F.when(np, "non_public_node").otherwise("source").alias("coordinate_source"), F.when(np, "np|late").otherwise("late").alias("flags"))
    out = rp.reclassify(rows, ["20", "40"], "station_id", "coordinate_source", "flags", "np", "source")
    return out.groupBy("coordinate_source", "flags").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@register("l02_backfill", cte(_DICT_SQL, "fs AS (SELECT station_key, arg_min(latitude, (month, city)) AS la FROM dc GROUP BY 1)") + f"SELECT l_suppkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_linenumber>2 AND la IS NOT NULL) AS filled, {r('SUM(CASE WHEN l_linenumber<=2 THEN 38e0 ELSE la END)','s')} FROM lineitem LEFT JOIN fs ON station_key='I:'||l_suppkey GROUP BY 1")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_suppkey", F.concat(F.lit("I:"), F.col("l_suppkey").cast("string")).alias("station_key"), F.when(F.col("l_linenumber") <= 2, F.lit(38.0)).alias("lat"), F.when(F.col("l_linenumber") <= 2, F.lit(-77.0)).alias("lon"))
    d = dictionary(spark, sf).select("station_key", F.struct("month", "city").alias("at"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rp.backfill(rows, d, "station_key", "at", "lat", "lon").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("filled").alias("filled"), F.sum("lat").alias("s"))


@register("l03_apply_deltas", "SELECT l_suppkey, COUNT(*) + COUNT(*) FILTER (WHERE l_returnflag='R') AS n FROM lineitem GROUP BY 1 HAVING l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal<0)")
def _(spark, sf):
    li = read(spark, sf, "lineitem").select("l_suppkey", "l_returnflag")
    t = li.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    d = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    gone = read(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return rp.drop_resolved(rp.apply_deltas(t, d, ["l_suppkey"], "n"), gone, ["l_suppkey"])


# --- checks -------------------------------------------------------------------------------
@register("n01_expectations", f"SELECT 'rows' AS \"check\", CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) AS expected, CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) AS observed, 'PASS' AS status UNION ALL SELECT 'negative_price', 0e0, CAST((SELECT COUNT(*) FROM orders WHERE o_totalprice<0) AS DOUBLE), CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_totalprice<0)=0 THEN 'PASS' ELSE 'FAIL' END")
def _(spark, sf):
    o = read(spark, sf, "orders")
    return ck.expect(o, {"rows": (F.count("*"), o.agg(F.count("o_orderkey")).scalar()), "negative_price": (F.count_if(F.col("o_totalprice") < 0), 0)})


@register("n02_key_relation", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, COUNT(*) AS b FROM customer GROUP BY 1), j AS (SELECT COALESCE(a,0) AS a, COALESCE(b,0) AS b FROM a FULL JOIN b USING (k)) SELECT COUNT(*) AS keys, COUNT(*) FILTER (WHERE b=0) AS left_only, COUNT(*) FILTER (WHERE a=0) AS right_only, MAX(a) AS max_left, MAX(b) AS max_right, 'many_to_one' AS relation, COUNT(*) FILTER (WHERE a=0 OR b=0)=0 AS full_match FROM j")
def _(spark, sf):
    return ck.key_relation(read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


_PI = """
pu AS (SELECT unit, COUNT(*) AS days, MIN(period) AS lo, MAX(period) AS hi, SUM(y) AS sy, SUM(y1) AS sl, arg_max(y, period) AS last, MIN(y) AS low, COUNT(*) FILTER (WHERE y1 IS NULL) AS nulls FROM lagged GROUP BY unit)
"""
_PI_ROWS = {
    "rows_over_units": ("30", "SUM(days)*1e0/COUNT(*)"), "unequal_length": ("0", "COUNT(*) FILTER (WHERE days<>30)"),
    "wrong_range": ("0", f"COUNT(*) FILTER (WHERE lo<>DATE '{EV_START}' OR hi<>DATE '{EV_END}')"), "negative": ("0", "COUNT(*) FILTER (WHERE low<0)"),
    "lag_identity": ("0", "COUNT(*) FILTER (WHERE sl<>sy-last)"), "first_lag_null": ("0", "COUNT(*) FILTER (WHERE nulls<>1)"),
}


def _sql_checks(rows, src):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", {e}e0 AS expected, CAST({o} AS DOUBLE) AS observed, CASE WHEN {o} = {e} THEN 'PASS' ELSE 'FAIL' END AS status FROM {src}" for c, (e, o) in rows.items())


@register("n03_panel_integrity", cte(P_EV, _PI) + _sql_checks(_PI_ROWS, "pu"))
def _(spark, sf):
    return ck.panel_integrity(events_panel(spark, sf), "unit", "period", "y", "y1", EV_START, EV_END)


@register("n04_scale_conservation", cte(P_OR, "w AS (SELECT SUM(y) AS s FROM (SELECT SUM(y) AS y FROM opanel GROUP BY unit, date_trunc('week', period)))") + "SELECT 'spread' AS \"check\", 0e0 AS expected, CAST(abs((SELECT SUM(y) FROM opanel)-(SELECT s FROM w)) AS DOUBLE) AS observed, CASE WHEN (SELECT SUM(y) FROM opanel) = (SELECT s FROM w) THEN 'PASS' ELSE 'FAIL' END AS status")
def _(spark, sf):
    p = orders_panel(spark, sf)
    day = p.agg(F.sum("y").alias("t"))
    week = pn.to_weekly(p, ["unit"], "period", ["y"], complete_only=False).agg(F.sum("y").alias("t"))
    return ck.expect(day.unionByName(week), {"spread": (F.max("t") - F.min("t"), 0)})


@register("n05_estimate_identities", cte(*_SPLITI, f"g AS (SELECT *, {sql_floor('GREATEST(h0,0)')} AS l0, {sql_floor('LEAST(GREATEST(hb,0),GREATEST(h0,0))')} AS lb FROM i)") + _sql_checks({
    "cmi_identity": ("0", "COUNT(*) FILTER (WHERE abs(cmi-(h0-hb))>1e-12)"), "floor_order": ("0", "COUNT(*) FILTER (WHERE lb>l0)"),
    "correction_sign": ("0", "COUNT(*) FILTER (WHERE h0<h0_plugin-1e-12 OR hb<hb_plugin-1e-12)")}, "g"))
def _(spark, sf):
    t = bounds.attach_floors(by_split_dow(spark, sf), "h0", "hb")
    return ck.expect(t, {
        "cmi_identity": (F.count_if(F.abs(F.col("cmi") - (F.col("h0") - F.col("hb"))) > 1e-12), 0),
        "floor_order": (F.count_if(F.col("lb") > F.col("l0")), 0),
        "correction_sign": (F.count_if((F.col("h0") < F.col("h0_plugin") - 1e-12) | (F.col("hb") < F.col("hb_plugin") - 1e-12)), 0),
    })


@register("n06_balanced_panel", cte(P_EV) + "SELECT 'unequal_length' AS \"check\", 0e0 AS expected, CAST(MAX(c)-MIN(c) AS DOUBLE) AS observed, CASE WHEN MAX(c) = MIN(c) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT COUNT(*) AS c FROM panel GROUP BY unit)")
def _(spark, sf):
    n = events_panel(spark, sf).groupBy("unit").agg(F.count("*").alias("c"))
    return ck.require(ck.expect(n, {"unequal_length": (F.max("c") - F.min("c"), 0)}))


@register("e40_shared_token_columns", "SELECT 'doc_id' AS name, (SELECT COUNT(doc_id) FROM documents) AS left_values, (SELECT COUNT(doc_id) FROM labels) AS right_values")
def _(spark, sf):
    a, b = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = None
    for c in au.shared_token_columns([a, b], ["id", "text"]):
        part = a.agg(F.lit(c).alias("name"), F.count(c).alias("left_values")).withColumn("right_values", b.agg(F.count(c)).scalar())
        out = part if out is None else out.unionByName(part)
    return out
