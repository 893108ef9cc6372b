"""Scans and sinks over files that Spark writes from the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tallyfloor.catalog.base import *  # noqa: F403
from tallyfloor.catalog.base import cte, r, read, register
from tallyfloor.catalog.columns import _EVENT_RULES_SQL, _sql_utm, event_rows
from tallyfloor.operators.settle import scratch
from tallyfloor.sources import files as fl

_T = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@register("a01_list_inputs")
def _(spark, sf):
    return fl.list_inputs(spark, sf, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")


@register("a02_file_manifest")
def _(spark, sf):
    return fl.file_manifest(spark, sf, "*.parquet").select("name", "bytes", "sha256", "copies", "role")


def orders_csv(spark, sf, long=False):
    """Orders as CSV lines. Where the key leaves 3 of 10 the last field is missing; ``long`` adds lines with a field too many."""
    path = scratch(spark, "csv")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 10 != 3, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))))
    if long:
        line = F.when(F.col("o_orderkey") % 10 == 7, F.concat(line, F.lit(","))).otherwise(line)
    head = F.lit(",".join(COLS))
    parts = read(spark, sf, "orders").select(line.alias("value")).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(8)))
    heads = spark.range(8).select(head.alias("value"), F.col("id").alias("part"))
    both = heads.withColumn("first", F.lit(0)).unionByName(parts.withColumn("first", F.lit(1)))
    both.repartition(8, "part").sortWithinPartitions("part", "first").select("value", "part").write.partitionBy("part").text(path)
    return f"{path}/*"


COLS = ["o_orderkey", "o_custkey", "o_orderpriority"]


def orders_zips(spark, sf):
    """Eight archives of orders, each with a CSV member and what a desktop system adds. Every tenth line is short."""
    path, columns = scratch(spark, "zip"), COLS
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))

    def write(batches):
        import io
        import uuid
        import zipfile

        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        rows = pd.concat([pd.DataFrame(columns=columns), *batches])
        lines = [",".join(columns)] + [f"{k},{c}" if k % 10 == 3 else f"{k},{c},{p}" for k, c, p in rows.itertuples(index=False)]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("orders/part.csv", "\ufeff" + "\n".join(lines) + "\n")
            z.writestr("__MACOSX/orders/._part.csv", "x")
        name = f"{uuid.uuid4().hex}.zip"
        with system.open_output_stream(f"{root}/{name}") as f:
            f.write(held.getvalue())
        yield pd.DataFrame({"name": [name]})

    names = read(spark, sf, "orders").select(*columns).repartition(8, "o_orderkey").mapInPandas(write, "name string")
    return path, [r["name"] for r in names.collect()]


@register("a03_zip_csv", "SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END AS o_orderpriority, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, true AS numbered FROM orders GROUP BY 1")
def _(spark, sf):
    path, names = orders_zips(spark, sf)
    df = fl.read_zip_csv(spark, path, COLS).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(names))
    per = df.groupBy("name").agg(F.count("*").alias("n"), F.max("row_number").alias("hi"), F.count_distinct("row_number").alias("d"))
    fine = per.agg(F.bool_and((F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("numbered"))
    by = df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("s"))
    return by.withColumn("numbered", fine.scalar())


@register("a04_tolerant_csv", "SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END AS o_orderpriority, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 10 <> 7 GROUP BY 1")
def _(spark, sf):
    df = fl.read_csv_tolerant(spark, orders_csv(spark, sf, long=True), COLS)
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("s"))


@register("a05_strict_csv", "SELECT COUNT(*) AS n, true AS numbered")
def _(spark, sf):
    df = fl.read_csv_strict(spark, orders_csv(spark, sf), COLS)
    per = df.groupBy("file").agg(F.count("*").alias("n"), F.max("row_number").alias("hi"), F.min("row_number").alias("lo"), F.count_distinct("row_number").alias("d"))
    return per.agg(F.sum("n").alias("n"), F.bool_and((F.col("hi") == F.col("n")) & (F.col("lo") == 1) & (F.col("d") == F.col("n"))).alias("numbered"))


SQL["a05_strict_csv"] = "SELECT COUNT(*) AS n, true AS numbered FROM orders"  # noqa: F405


@register("a06_pruned_scan", f"SELECT l_returnflag, COUNT(*) AS n, {r('SUM(l_quantity)','q')} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def _(spark, sf):
    li = read(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@register("a07_partitioned_sink", "SELECT o_orderstatus, year(o_orderdate) AS year, COUNT(*) AS n FROM orders WHERE year(o_orderdate)=1998 GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "parquet")
    fl.write_partitioned(read(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), path, ["year", "o_orderstatus"])
    return spark.read.parquet(path).where("year = 1998").groupBy("o_orderstatus", "year").agg(F.count("*").alias("n"))


@register("a08_dual_sink", cte(_EVENT_RULES_SQL) + "SELECT CASE WHEN reasons='' THEN 'retained' ELSE 'excluded' END AS side, event_type, COUNT(*) AS n FROM q GROUP BY ALL")
def _(spark, sf):
    a, b = scratch(spark, "retained"), scratch(spark, "excluded")
    fl.write_retained_and_excluded(event_rows(spark, sf), a, b, ["event_type"])
    n = lambda p, t: spark.read.parquet(p).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("side", F.lit(t))
    return n(a, "retained").unionByName(n(b, "excluded"))


@register("a09_table_csv", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "table")
    fl.write_table_csv(read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return spark.read.csv(path, header=True, schema="o_orderpriority string, n long")


@register("a10_parquet_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS rows FROM {t}" for t in _T))
def _(spark, sf):
    parts = [fl.parquet_inventory(spark, f"{sf}/{t}.parquet").groupBy(F.lit(t).alias("name")).agg(F.sum("rows").alias("rows")) for t in _T]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@register("e45_other_cell_size", _sql_utm().rstrip() + ", o AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest([250, 500, 1000]) AS size), c AS (SELECT size, floor(east/size) AS x, floor(north/size) AS y, SUM(n) AS n FROM g JOIN o ON o_custkey = c_custkey, s GROUP BY ALL) "
    + f"SELECT CAST(size AS BIGINT) AS cell_size, COUNT(*) AS active_cells, CAST(SUM(n) AS BIGINT) AS events, {r('AVG(n)', 'mean_per_cell')} FROM c GROUP BY size")
def _(spark, sf):
    from tallyfloor.catalog.columns import lat, lon
    from tallyfloor.functions.geo import to_grid

    c = read(spark, sf, "customer").select("c_custkey", lon().alias("lon"), lat().alias("lat"))
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = None
    for size in (250, 500, 1000):
        g = to_grid(c, "lon", "lat", 18, float(size)).join(o, F.col("c_custkey") == F.col("o_custkey"))
        part = g.groupBy("x_index", "y_index").agg(F.sum("n").alias("n")).agg(F.lit(size).alias("cell_size"), F.count("*").alias("active_cells"), F.sum("n").alias("events"), F.avg("n").alias("mean_per_cell"))
        out = part if out is None else out.unionByName(part)
    return out
