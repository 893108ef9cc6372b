"""Column functions and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import big, cte, r, read, register
from tallyfloor.functions import cleaning as cl, geo, states
from tallyfloor.functions.calendars import calendar_fields, holidays
from tallyfloor.operators import audit as au, information as info

# Coordinates derived from the keys of customers, near 77 W 38.9 N.
def lon():
    return F.lit(-77.2) + F.pmod("c_custkey", F.lit(97)) * 0.004


def lat():
    return F.lit(38.8) + F.pmod("c_custkey", F.lit(89)) * 0.003


S_LON, S_LAT = "(-77.2e0 + (c_custkey % 97) * 0.004e0)", "(38.8e0 + (c_custkey % 89) * 0.003e0)"


@register("b01_resolve_columns", "SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name, CAST(NULL AS VARCHAR) AS lat FROM supplier")
def _(spark, sf):
    raw = read(spark, sf, "supplier").withColumnsRenamed({"s_suppkey": " Start  Station ID ", "s_name": "﻿Station Name"})
    return cl.resolve_columns(raw, {"station_id": ["station number", "start station id"], "station_name": ["station name", "name"], "lat": ["latitude", "lat"]})


@register("b02_clean_text", "SELECT page_id, md5(NULLIF(regexp_replace(CASE page_id % 5 WHEN 0 THEN chr(9) || ' ' || chr(10) ELSE chr(9) || html || chr(13) || chr(10) END, '^\\s+|\\s+$', '', 'g'), '')) AS page, NULLIF(regexp_replace(chr(9) || url || ' ', '^\\s+|\\s+$', '', 'g'), '') AS address FROM pages")
def _(spark, sf):
    page = F.when(F.col("page_id") % 5 == 0, F.lit("\t \n")).otherwise(F.concat(F.lit("\t"), "html", F.lit("\r\n")))
    return read(spark, sf, "pages").select("page_id", F.md5(cl.clean_text(page)).alias("page"), cl.clean_text(F.concat(F.lit("\t"), "url", F.lit(" "))).alias("address"))


@register("b03_safe_casts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN o_totalprice END AS price,
CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format(d, "M/d/yyyy HH:mm")
    ).otherwise(F.lit("unknown"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    raw = F.when(key % 7 == 0, F.lit("n/a")).when(key % 11 == 0, F.lit("NaN")).when(key % 13 == 0, F.concat(price, F.lit("d"))).otherwise(F.concat(F.lit("\t"), price))
    return read(spark, sf, "orders").select(
        "o_orderkey", cl.safe_double(raw).alias("price"),
        cl.safe_timestamp(text, ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy HH:mm"]).cast("string").alias("at"),
    )


@register("b04_norm_names", "SELECT doc_id, NULLIF(TRIM(regexp_replace(translate(translate(lower(nfc_normalize(t)), '‘’“”–—', '''''\"\"--'), chr(160), ' '), '\\s+', ' ', 'g')), '') AS name FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ‘’“”–—]', '', 'g') AS t FROM documents)")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z ‘’“”–—]+", "").alias("t"))
    return cl.norm_names(d, "t", "name").select("doc_id", "name")


@register("b05_station_id", "SELECT p_partkey, regexp_replace(CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey%2=0 THEN '.0' ELSE '.5' END, '^(\\d+)\\.0$', '\\1') AS id FROM part")
def _(spark, sf):
    t = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(".5"))
    return read(spark, sf, "part").select("p_partkey", cl.station_id(t).alias("id"))


@register("b06_station_key", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'I:' || c_custkey WHEN c_custkey%3=1 THEN 'N:' || c_name END AS k FROM customer")
def _(spark, sf):
    m = F.col("c_custkey") % 3
    return read(spark, sf, "customer").select("c_custkey", cl.station_key(F.when(m == 0, F.col("c_custkey").cast("string")), F.when(m < 2, F.col("c_name"))).alias("k"))


@register("b07_split_station", "SELECT p_partkey, CASE WHEN p_partkey%5>0 THEN lpad(CAST(p_partkey%10000 AS VARCHAR),4,'0') END AS code, p_name AS name FROM part")
def _(spark, sf):
    label = F.concat_ws(" ", F.when(F.col("p_partkey") % 5 > 0, F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")), "p_name")
    code, name = cl.split_station(label)
    return read(spark, sf, "part").select("p_partkey", code.alias("code"), name.alias("name"))


@register("b08_valid_coordinate", "SELECT c_custkey, COALESCE(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok FROM (SELECT c_custkey, CASE WHEN c_custkey%4>0 THEN c_acctbal/50 END AS lat, c_acctbal/30 AS lon FROM customer)")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", cl.valid_coordinate(F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") / 50), F.col("c_acctbal") / 30).alias("ok"))


@register("b09_combine_flags", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_quantity>40 THEN 'large' END, CASE WHEN l_discount>0.08 THEN 'cheap' END, CASE WHEN l_returnflag='R' THEN 'returned' END) AS flags FROM lineitem")
def _(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cl.combine_flags({"large": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.08, "returned": F.col("l_returnflag") == "R"}).alias("flags"))


@register("b10_flag_edit", "SELECT l_returnflag, CASE WHEN large THEN 'large' ELSE '' END AS removed, CASE WHEN large AND ret THEN 'large|returned' WHEN large THEN 'large|returned' ELSE 'returned' END AS added, COUNT(*) AS n FROM (SELECT l_returnflag, l_quantity>40 AS large, l_returnflag='R' AS ret FROM lineitem) GROUP BY ALL")
def _(spark, sf):
    flags = cl.combine_flags({"large": F.col("l_quantity") > 40, "returned": F.col("l_returnflag") == "R"})
    return read(spark, sf, "lineitem").select("l_returnflag", cl.remove_flag(flags, "returned").alias("removed"), cl.add_flag(flags, "returned").alias("added")).groupBy("l_returnflag", "removed", "added").agg(F.count("*").alias("n"))


@register("b11_primary_reason", "SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN l_quantity>45 THEN 'large' WHEN l_discount>0.08 THEN 'cheap' END AS reason FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "lineitem").groupBy(cl.primary_reason({"large": F.col("l_quantity") > 45, "cheap": F.col("l_discount") > 0.08}).alias("reason")).agg(F.count("*").alias("n"))


@register("b12_period_from_path", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS p FROM orders")
def _(spark, sf):
    path = F.concat(F.lit("/data/trips/"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy-MM")), F.lit("-tripdata.csv"))
    return read(spark, sf, "orders").select("o_orderkey", cl.period_from_path(path).alias("p"))


@register("b13_deterministic_ids", "SELECT o_orderkey, 'CR-' || o_orderstatus || '-' || substr(md5(o_orderpriority),1,12) || '-' || lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS e, 'BI-' || o_orderstatus || '-' || substr(md5(o_orderpriority),1,12) || '-002-' || lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS t FROM orders")
def _(spark, sf):
    h = F.md5("o_orderpriority")
    return read(spark, sf, "orders").select("o_orderkey", cl.event_id(F.col("o_orderstatus"), h, F.col("o_orderkey")).alias("e"), cl.trip_id(F.col("o_orderstatus"), h, F.lit(2), F.col("o_orderkey")).alias("t"))


@register("b14_duration", f"SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, {r('CASE WHEN l_linenumber=1 THEN 60e0 ELSE epoch(l_shipdate) - epoch(o_orderdate) END','s')} FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def _(spark, sf):
    j = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate").join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_partkey", "l_linenumber", cl.duration_seconds(F.when(F.col("l_linenumber") == 1, F.lit(60.0)), F.col("o_orderdate"), F.col("l_shipdate")).alias("s"))


@register("b15_ride_type", "SELECT t, COUNT(*) AS n FROM (SELECT CASE WHEN o_orderkey%5=0 THEN 'docked' WHEN o_orderkey%5 IN (1,2) THEN 'electric' WHEN o_orderkey%5=3 THEN 'classic' END AS t FROM orders) GROUP BY 1")
def _(spark, sf):
    m = F.col("o_orderkey") % 5
    t = cl.ride_type(F.when(m == 0, "docked"), F.when(m == 1, "TRUE").when(m == 2, "1").when(m == 3, "false").otherwise("maybe"))
    return read(spark, sf, "orders").groupBy(t.alias("t")).agg(F.count("*").alias("n"))


@register("b16_haversine", f"SELECT c_custkey, ROUND(2*6371008.8e0*asin(sqrt(pow(sin(radians({S_LAT}-38.9e0)/2),2) + cos(radians(38.9e0))*cos(radians({S_LAT}))*pow(sin(radians({S_LON}+77.0e0)/2),2))), 4) + 0.0 AS m FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(geo.haversine(F.lit(38.9), F.lit(-77.0), lat(), lon()), 4).alias("m"))


def _sql_utm():
    f = 1 / 298.257223563  # fixed values: the WGS 84 ellipsoid and the series of the transverse Mercator projection to the fourth power
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    ]
    e = 2 * n**0.5 / (1 + n)
    terms = lambda f, g: " + ".join(f"{a!r}e0*{f}({2 * j}e0*xi)*{g}({2 * j}e0*eta)".replace("e-", "e-") for j, a in enumerate(alpha, 1))
    fix = lambda s: __import__("re").sub(r"(\d\.\d+e-\d+)e0", r"\1", s)
    return fix(f"""
WITH p AS (SELECT c_custkey, {S_LAT} AS lat, {S_LON} AS lon FROM customer),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}e0*atanh({e!r}e0*sin(radians(lat)))) AS t, radians(lon + 75e0) AS lam FROM p),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM t),
g AS (SELECT c_custkey, 500000e0 + 0.9996e0*{radius!r}e0*(eta + {terms('cos', 'sinh')}) AS east, 0.9996e0*{radius!r}e0*(xi + {terms('sin', 'cosh')}) AS north FROM x)
""")


@register("b17_to_grid", _sql_utm() + "SELECT c_custkey, CAST(floor(east/1000) AS BIGINT) AS x_index, CAST(floor(north/1000) AS BIGINT) AS y_index, true AS grid_valid FROM g")
def _(spark, sf):
    p = read(spark, sf, "customer").select("c_custkey", lon().alias("lon"), lat().alias("lat"))
    return geo.to_grid(p, "lon", "lat", 18, 1000.0).select("c_custkey", "x_index", "y_index", "grid_valid")


@register("b18_grid_key", _sql_utm() + "SELECT c_custkey, CAST(floor(east/500) AS BIGINT)*10000000 + CAST(floor(north/500) AS BIGINT) AS k, 'DC_R500_E' || CAST(floor(east/500) AS BIGINT) || '_N' || CAST(floor(north/500) AS BIGINT) AS id FROM g")
def _(spark, sf):
    p = read(spark, sf, "customer").select("c_custkey", lon().alias("lon"), lat().alias("lat"))
    g = geo.to_grid(p, "lon", "lat", 18, 500.0)
    return g.select("c_custkey", geo.grid_key(F.col("x_index"), F.col("y_index")).alias("k"), geo.grid_id(F.lit("DC"), 500, F.col("x_index"), F.col("y_index")).alias("id"))


@register("b19_cell_geometry")
def _(spark, sf):
    p = read(spark, sf, "customer").select("c_custkey", lon().alias("lon"), lat().alias("lat"))
    cells = geo.to_grid(p, "lon", "lat", 18, 1000.0).select("x_index", "y_index").distinct()
    return geo.cell_geometry(cells, "x_index", "y_index", 1000.0, 18)


@register("b20_coarse_index", "SELECT CAST(floor((p_size-25)/4.0) AS BIGINT) AS i, COUNT(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "part").groupBy(geo.coarse_index(F.col("p_size") - 25, 4).alias("i")).agg(F.count("*").alias("n"))


@register("b21_calendar_fields", """SELECT CAST(d AS VARCHAR) AS day, year(d) AS year, month(d) AS month, isodow(d)-1 AS day_of_week, dayofyear(d) AS day_of_year, week(d) AS iso_week, isodow(d)>=6 AS is_weekend,
CASE WHEN month(d) IN (12,1,2) THEN 'winter' WHEN month(d) IN (3,4,5) THEN 'spring' WHEN month(d) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season, COUNT(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL""")
def _(spark, sf):
    days = read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return calendar_fields(days, "day")


_MON = lambda y, m, n: f"(make_date({y},{m},1) + ((8-isodow(make_date({y},{m},1)))%7)::INTEGER + {7 * (n - 1)})"


def _sql_us():
    y = "y"
    thu = "(make_date(y,11,1) + ((11-isodow(make_date(y,11,1)))%7)::INTEGER + 21)"
    last_mon = "(make_date(y,5,31) - (isodow(make_date(y,5,31))-1)::INTEGER)"
    fixed = ["make_date(y,1,1)", "make_date(y,7,4)", "make_date(y,11,11)", "make_date(y,12,25)", "CASE WHEN y>=2021 THEN make_date(y,6,19) END"]
    obs = [f"(CASE isodow({d}) WHEN 6 THEN {d}-1 WHEN 7 THEN {d}+1 ELSE {d} END)" for d in fixed]
    allh = fixed + obs + [_MON(y, 1, 3), _MON(y, 2, 3), _MON(y, 9, 1), _MON(y, 10, 2), thu, last_mon]
    return "h AS (SELECT DISTINCT unnest([" + ", ".join(f"CAST({d} AS DATE)" for d in allh) + "]) AS d FROM (SELECT CAST(i AS INTEGER) AS y FROM range(1994, 2003) t(i)))"


@register("b22_holiday_counts", cte(_sql_us()) + "SELECT CAST(o.d AS VARCHAR) AS day, h.d IS NOT NULL AS is_holiday, n FROM (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY 1) o LEFT JOIN h ON h.d=o.d")
def _(spark, sf):
    days = read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    h = holidays(spark, "US", "1995-01-01", "2001-12-31").withColumn("is_holiday", F.lit(True))
    return days.join(F.broadcast(h), days["day"] == h["holiday"], "left").select("day", F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"), "n")


@register("b23_split_label", f"SELECT CASE WHEN CAST(o_orderdate AS DATE)<=DATE '{OR_TRAIN_END}' THEN 'train' WHEN CAST(o_orderdate AS DATE)<=DATE '{OR_VALID_END}' THEN 'validation' ELSE 'test' END AS split, COUNT(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "orders").groupBy(states.split_label(F.to_date("o_orderdate"), OR_TRAIN_END, OR_VALID_END).alias("split")).agg(F.count("*").alias("n"))


@register("b24_count_state", cte(P_EV) + "SELECT CASE WHEN y1=0 THEN 'zero' WHEN y1=1 THEN 'one' WHEN y1=2 THEN 'two' WHEN y1>=3 THEN 'three_plus' END AS fine, CASE WHEN y1=0 THEN 'zero' WHEN y1=1 THEN 'one' WHEN y1>=2 THEN 'two_plus' END AS coarse, COUNT(*) AS n FROM lagged GROUP BY ALL")
def _(spark, sf):
    return events_panel(spark, sf).groupBy(states.count_label(F.col("y1")).alias("fine"), states.count_label(F.col("y1"), states.COARSE_LABELS).alias("coarse")).agg(F.count("*").alias("n"))


@register("b25_cut_state", cte(P_EV, P_CUTS) + "SELECT CASE WHEN x1=0 THEN 'zero' WHEN x1<=c1 THEN 'low' WHEN x1<=c2 THEN 'medium' WHEN x1>c2 THEN 'high' END AS state, COUNT(*) AS n FROM lagged, cuts GROUP BY 1")
def _(spark, sf):
    return events_panel(spark, sf).groupBy(states.cut_label(F.col("x1"), events_cuts(spark, sf), k=2).alias("state")).agg(F.count("*").alias("n"))


@register("b26_class_label", cte(P_EV) + "SELECT CAST(y>0 AS BIGINT) AS occurs, CAST(LEAST(y,2) AS BIGINT) AS level, COUNT(*) AS n FROM panel GROUP BY ALL")
def _(spark, sf):
    return events_panel(spark, sf).groupBy(states.class_binary(F.col("y")).alias("occurs"), states.class_three(F.col("y")).alias("level")).agg(F.count("*").alias("n"))


@register("b27_half_up", "SELECT event_id, CAST(floor(GREATEST(value-5.5e0,0)+0.5e0) AS BIGINT) AS k FROM events")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", states.half_up(F.col("value") - 5.5).alias("k"))


_TOP = cte(P_EV, f"cap AS (SELECT ceil(quantile_cont(y, 0.9)) AS cap FROM panel WHERE period <= DATE '{EV_TRAIN_END}')")


@register("b28_top_code", _TOP + "SELECT CAST(LEAST(y,cap) AS BIGINT) AS y, CAST(CASE WHEN y1>cap THEN cap ELSE y1 END AS BIGINT) AS y1, COUNT(*) AS n FROM lagged, cap GROUP BY ALL")
def _(spark, sf):
    p = events_panel(spark, sf)
    tally = p.where(F.col("period") <= F.lit(EV_TRAIN_END).cast("date")).groupBy("y").agg(F.count("*").alias("n"))
    cap = tally.select(F.ceil(F.expr("percentile(y, 0.9D, n)"))).scalar()
    return p.groupBy(states.top_code(F.col("y"), cap).alias("y"), states.top_code(F.col("y1"), cap).alias("y1")).agg(F.count("*").alias("n"))


@register("b29_area_time", f"SELECT p_brand, {r('mse/(4e0*7)/(4e0*7)','rate_mse')}, {r('sqrt(mse)/28e0','rate_rmse')}, {r('pow(2e0,-2*mse/100)','ratio')} FROM (SELECT p_brand, AVG(CAST(p_size AS DOUBLE)) AS mse FROM part GROUP BY 1)")
def _(spark, sf):
    m = read(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mse"))
    a, t = F.lit(4.0), F.lit(7.0)
    return m.select("p_brand", states.per_area_time(F.col("mse"), a, t).alias("rate_mse"), states.per_area_time_root(F.col("mse"), a, t).alias("rate_rmse"), states.entropy_power_ratio(F.col("mse") / 100).alias("ratio"))


@register("b30_abs_measure", cte(P_EV) + "SELECT unit, CAST(period AS VARCHAR) AS period, LAG(abs(y-x)) OVER (PARTITION BY unit ORDER BY period) AS a1 FROM panel")
def _(spark, sf):
    from tallyfloor.operators import panel as pn

    d = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    d = d.withColumn("a", states.abs_measure(F.col("y") - F.col("x")))
    return pn.add_lags(d, ["unit"], "period", {"a1": ("a", 1)}).select("unit", "period", "a1")


# --- row rules ----------------------------------------------------------------------------
_EVENT_RULES_SQL = """
r AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id%11=0 THEN NULL ELSE ts END AS tt, CASE WHEN event_id%13=0 THEN 99e0 ELSE 38.9e0 END AS lat, -77e0 AS lon FROM events),
q AS (SELECT *, concat_ws('|', CASE WHEN tt IS NULL THEN 'invalid_datetime' END, CASE WHEN tt IS NOT NULL AND (tt < TIMESTAMP '2024-01-03' OR tt >= TIMESTAMP '2024-01-28') THEN 'outside_period' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'invalid_coordinate' END, CASE WHEN event_type NOT IN ('error','click','view') THEN 'unexpected_type' END) AS reasons FROM r)
"""


def event_rows(spark, sf):
    ev = read(spark, sf, "events").withColumns({
        "at": F.when(F.col("event_id") % 11 > 0, F.col("ts")),
        "lat": F.when(F.col("event_id") % 13 == 0, F.lit(99.0)).otherwise(38.9), "lon": F.lit(-77.0),
    })
    return au.quarantine_events(ev, "at", "lat", "lon", "event_type", ["error", "click", "view"], "2024-01-03", "2024-01-28")


@register("c01_event_rules", cte(_EVENT_RULES_SQL) + "SELECT event_id, reasons, CASE WHEN reasons='' THEN NULL ELSE split_part(reasons,'|',1) END AS primary_reason FROM q")
def _(spark, sf):
    return event_rows(spark, sf).select("event_id", "reasons", "primary_reason")


@register("c02_trip_rules", "SELECT reasons, COUNT(*) AS n FROM (SELECT concat_ws('|', CASE WHEN o_orderdate IS NULL THEN 'invalid_start' END, CASE WHEN strftime(o_orderdate,'%Y-%m')<>'1998-10' THEN 'outside_month' END) AS reasons FROM (SELECT CASE WHEN o_orderkey%9=0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)) GROUP BY 1")
def _(spark, sf):
    o = read(spark, sf, "orders").withColumns({"at": F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")), "month": F.lit("1998-10")})
    return au.quarantine_trips(o, "at", "month", ["o_orderkey"]).groupBy("reasons").agg(F.count("*").alias("n"))


@register("c03_blank_rows", "SELECT COUNT(*) FILTER (WHERE c_custkey%10=0) AS blank, COUNT(*) AS n FROM customer")
def _(spark, sf):
    m = F.col("c_custkey") % 10 > 0
    raw = read(spark, sf, "customer").select(F.when(m, F.col("c_name")).alias("a"), F.when(m, F.col("c_mktsegment")).alias("b"))
    return raw.agg(F.count_if(au.is_blank("a", "b")).alias("blank"), F.count("*").alias("n"))


@register("c04_endpoint_eligible", "SELECT COUNT(*) FILTER (WHERE l_shipdate IS NOT NULL AND l_suppkey%20<>0 AND l_quantity<40) AS ok, COUNT(*) AS n FROM lineitem")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("lat"), F.lit(10.0).alias("lon"), "l_shipdate", (F.col("l_suppkey") % 20 == 0).alias("np"))
    ok = au.endpoint_eligible(F.when(F.col("lat") < 40, F.col("lat")), F.col("lon"), F.col("np"), F.lit(False), F.col("l_shipdate"))
    return rows.agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


@register("c05_non_public", "SELECT CASE WHEN p_name LIKE 'red%' OR regexp_matches(p_name, '\\b(bolt|gear)\\b') THEN true ELSE false END AS np, COUNT(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "part").groupBy(au.non_public(F.col("p_name"), prefixes=["red"], patterns=[r"\b(bolt|gear)\b"]).alias("np")).agg(F.count("*").alias("n"))


@register("c06_domain_period_masks", cte(*PREP, sql_info("(SELECT * FROM prep WHERE split='test' AND unit IN (SELECT c_custkey FROM customer WHERE c_nationkey<12))", [], ["dow"], "b", "y")) + f"SELECT CAST(n AS BIGINT) AS n, {r('cmi','cmi')} FROM i")
def _(spark, sf):
    from tallyfloor.operators.panel import within_domain

    domain = read(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("unit"))
    p = within_domain(prepared(spark, sf).where("split = 'test'"), domain, ["unit"])
    return info.conditional_information(info.joint_counts(p, ["dow"], "b", "y"), ["dow"], "b", "y").select("n", "cmi")


@register("c08_matched_lags", cte(P_EV) + "SELECT COUNT(*) AS n, CAST(SUM(y1) AS BIGINT) AS s1, CAST(SUM(y14) AS BIGINT) AS s14 FROM (SELECT y1, LAG(y,14) OVER (PARTITION BY unit ORDER BY period) AS y14 FROM lagged) WHERE y1 IS NOT NULL AND y14 IS NOT NULL")
def _(spark, sf):
    from tallyfloor.operators import panel as pn

    d = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    d = pn.add_lags(d, ["unit"], "period", {"y1": ("y", 1), "y14": ("y", 14)}).dropna(subset=["y1", "y14"])
    return d.agg(F.count("*").alias("n"), F.sum("y1").alias("s1"), F.sum("y14").alias("s14"))
