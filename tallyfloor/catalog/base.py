"""Registration of queries with their SQL, and the panels they share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyfloor.functions import calendars, states
from tallyfloor.operators import information as info, panel as pn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 8
EV_START, EV_END = "2024-01-01", "2024-01-30"
EV_TRAIN_END, EV_VALID_END = "2024-01-20", "2024-01-25"
OR_START, OR_END = "1995-01-01", "2001-08-01"
OR_TRAIN_END, OR_VALID_END = "1999-12-31", "2000-12-31"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: long, double (rounded), string, boolean."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


_SCHEMAS: dict[str, T.StructType] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once and reused."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- SQL pieces ---------------------------------------------------------------------------


def r(expr: str, alias: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0 AS {alias}"


def big(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


def sql_draw(*parts: str) -> str:
    """Same integer as ``draws.draw``; parts are SQL expressions."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def _sums(l, n, weight, scale):
    return "(" + " + ".join(f"{weight(k)}e0 * exp(-{scale(k)})" for k in range(1, n)) + ")"


def _curves(l: str) -> tuple[str, str]:
    """Entropy (bits) and mean square of the lattice law, by more terms and another switch point
    than the library uses."""
    pi2 = f"{math.pi**2!r}e0"
    ex = lambda w: _sums(l, 9, w, lambda k: f"{k * k}e0*{l}")
    du = lambda w: _sums(l, 5, w, lambda k: f"{pi2}*{k * k}e0/{l}")
    z, m = f"(1e0+{ex(lambda k: '2')})", ex(lambda k: f"{2 * k * k}")
    th, dm = f"(1e0+{du(lambda k: '2')})", du(lambda k: f"{2 * k * k}")
    d = f"(CASE WHEN {l} >= 1 THEN {m}/{z} ELSE 0.5e0/{l} - {pi2}/({l}*{l})*{dm}/{th} END)"
    h = (
        f"((CASE WHEN {l} >= 1 THEN ln({z}) + {l}*{m}/{z} "
        f"ELSE 0.5e0*ln(pi()/{l}) + ln({th}) + 0.5e0 - {pi2}/{l}*{dm}/{th} END)/ln(2e0))"
    )
    return h, d


def sql_floor(h: str) -> str:
    """Scalar expression: exact floor of an entropy expression (a column name)."""
    hx, _ = _curves("exp(lo + 19e0*pow(0.5e0,i))")
    lam = (
        f"list_reduce([CAST(k AS DOUBLE) FOR k IN range(56)], "
        f"lambda lo, i: CASE WHEN {hx} >= {h} THEN lo + 19e0*pow(0.5e0,i) ELSE lo END, -32e0)"
    )
    _, d = _curves("exp(t)")
    return f"(CASE WHEN {h} <= 0 THEN 0e0 ELSE list_transform([{lam}], lambda t: {d})[1] END)"


def sql_h_of_lambda(l: str) -> str:
    return _curves(l)[0]


def sql_d_of_lambda(l: str) -> str:
    return _curves(l)[1]


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


# --- daily panel over users ---------------------------------------------------------------


def events_counts(spark, sf):
    ev = read(spark, sf, "events").select(
        F.col("user_id").alias("unit"), F.to_date("ts").alias("period"), "event_type"
    )
    return pn.period_counts(
        ev, ["unit", "period"],
        {"y": F.col("event_type") == "error", "x": F.col("event_type") == "click"},
    )


def events_panel(spark, sf):
    dense = pn.densify(events_counts(spark, sf), ["unit"], "period", ["y", "x"], EV_START, EV_END)
    return pn.add_lags(dense, ["unit"], "period", {"y1": ("y", 1), "x1": ("x", 1)})


def with_split(df):
    return df.withColumn("split", states.split_label(F.col("period"), EV_TRAIN_END, EV_VALID_END))


def events_cuts(spark, sf):
    """Cut points of yesterday's side count over the training days. Only positive values count,
    so the sparse counts do and the dense panel is not needed."""
    train = events_counts(spark, sf).where(F.date_add("period", 1) <= F.lit(EV_TRAIN_END).cast("date"))
    return info.scalar_cuts(train, "x", [1 / 3, 2 / 3])


def prepared(spark, sf):
    """Users x days with states: zl (lag state), b (side state), dow, block (7 days), split."""
    panel = events_panel(spark, sf)
    out = info.prepare_states(panel, "y", "y1", "x1", events_cuts(spark, sf), 2, "zl", "b")
    return with_split(out).withColumns(
        {
            "dow": calendars.day_of_week(F.col("period")),
            "block": F.floor(F.datediff("period", F.lit("2024-01-02").cast("date")) / 7).cast("int"),
            "pos": F.datediff("period", F.lit("2024-01-02").cast("date")),
        }
    )


P_EV = f"""
ev AS (SELECT user_id AS unit, CAST(ts AS DATE) AS period,
  SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS y,
  SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1,2),
cal AS (SELECT CAST(d AS DATE) AS period FROM range(TIMESTAMP '{EV_START}', TIMESTAMP '{EV_END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
panel AS (SELECT u.unit, c.period, CAST(COALESCE(y,0) AS BIGINT) AS y, CAST(COALESCE(x,0) AS BIGINT) AS x
  FROM (SELECT DISTINCT user_id AS unit FROM events) u CROSS JOIN cal c LEFT JOIN ev ON ev.unit=u.unit AND ev.period=c.period),
lagged AS (SELECT *, LAG(y) OVER w AS y1, LAG(x) OVER w AS x1 FROM panel WINDOW w AS (PARTITION BY unit ORDER BY period))
"""
P_CUTS = f"""
cuts AS (SELECT quantile_cont(x1, 1.0/3) AS c1, quantile_cont(x1, 2.0/3) AS c2 FROM lagged WHERE x1 > 0 AND period <= DATE '{EV_TRAIN_END}')
"""
P_PREP = f"""
prep AS (SELECT unit, period, y, x, y1, x1, LEAST(y1,3) AS zl,
  CASE WHEN x1=0 THEN 0 WHEN x1<=c1 THEN 1 WHEN x1<=c2 THEN 2 ELSE 3 END AS b,
  isodow(period)-1 AS dow, (period - DATE '2024-01-02') AS pos, (period - DATE '2024-01-02')//7 AS block,
  CASE WHEN period <= DATE '{EV_TRAIN_END}' THEN 'train' WHEN period <= DATE '{EV_VALID_END}' THEN 'validation' ELSE 'test' END AS split
  FROM lagged, cuts WHERE y1 IS NOT NULL AND x1 IS NOT NULL)
"""
PREP = (P_EV, P_CUTS, P_PREP)


def sql_entropy(src: str, keys: list[str], state: list[str], y: str, n: str = "1", tag: str = "h") -> str:
    """CTE text: (keys, n, plug, mm, states, atoms, ones) for one information set of ``src``."""
    k = "".join(f"{c}, " for c in keys)
    s = ", ".join(state) if state else "0"
    grp = lambda cols: ("GROUP BY " + ", ".join(cols)) if cols else ""
    sk = list(keys) + list(state)
    return f"""
{tag}_a AS (SELECT {k}{''.join(c + ', ' for c in state)}{y} AS yy, CAST(SUM({n}) AS DOUBLE) AS c FROM {src} {grp(sk + [y])} HAVING SUM({n}) > 0),
{tag}_s AS (SELECT {k}{''.join(c + ', ' for c in state)}SUM(c) AS ns, SUM(c*ln(c)) AS f, COUNT(*) AS a, COUNT(*) FILTER (WHERE c=1) AS o FROM {tag}_a {grp(sk)}),
{tag} AS (SELECT {k}SUM(ns) AS n, COUNT(*) AS states, SUM(a) AS atoms, SUM(o) AS ones,
  (SUM(ns*ln(ns)) - SUM(f))/(SUM(ns)*ln(2.0)) AS plug,
  (SUM(ns*ln(ns)) - SUM(f))/(SUM(ns)*ln(2.0)) + (SUM(a)-COUNT(*))/(2.0*SUM(ns)*ln(2.0)) AS mm
  FROM {tag}_s {grp(keys)})
"""


def sql_info(src: str, keys: list[str], base: list[str], side: str, y: str, n: str = "1", tag: str = "i") -> str:
    """CTE text: (keys, n, h0_plugin, hb_plugin, h0, hb, cmi, support columns)."""
    on = " AND ".join(f"p.{c}=q.{c}" for c in keys) or "TRUE"
    k = "".join(f"p.{c}, " for c in keys)
    grp = ("GROUP BY " + ", ".join(keys)) if keys else ""
    kk = "".join(f"{c}, " for c in keys)
    onu = " AND ".join(f"p.{c}=u.{c}" for c in keys) or "TRUE"
    zk = ", ".join(list(keys) + list(base)) or "1"
    return ",".join([
        sql_entropy(src, keys, base, y, n, f"{tag}0"),
        sql_entropy(src, keys, base + [side], y, n, f"{tag}1"),
        f"""
{tag}_z AS (SELECT {kk}(COUNT(DISTINCT {side})-1)*(COUNT(DISTINCT {y})-1) AS nu FROM (SELECT * FROM {src} WHERE {n} > 0) {'GROUP BY ' + zk}),
{tag}_u AS (SELECT {kk}SUM(nu) AS nu FROM {tag}_z {grp}),
{tag} AS (SELECT {k}p.n, p.plug AS h0_plugin, q.plug AS hb_plugin, p.mm AS h0, q.mm AS hb, p.plug-q.plug AS cmi_plugin, p.mm-q.mm AS cmi,
  p.states AS base_states, q.states AS side_states, p.atoms AS base_atoms, q.atoms AS side_atoms, q.ones AS singleton_atoms, u.nu
  FROM {tag}0 p JOIN {tag}1 q ON {on} JOIN {tag}_u u ON {onu})
"""])
