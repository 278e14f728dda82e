"""Scans, time parsing and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import HOURLY
from panelcast.functions.timefn import civil, parse_instant, truncate
from panelcast.operators import grid
from panelcast.plans import views
from panelcast.plans.registry import query
from panelcast.sources.tables import preview, read_parquet


@query("source_parquet_contract", sql="""
  SELECT event_type, count(*) AS n, count(ts) AS with_ts, sum(value) AS total FROM events GROUP BY 1
""", doubles=["total"], digits={"total": 2})
def source_parquet_contract(spark, sf):
    """IO-2: scan with required columns."""
    ev = read_parquet(spark, f"{sf}/events.parquet", ["event_id", "ts", "event_type", "value"])
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("with_ts"), F.sum("value").alias("total"))


@query("source_preview", sql="""
  SELECT l_orderkey AS order_id, l_quantity AS quantity, l_extendedprice AS price FROM lineitem
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 6
""", doubles=["quantity", "price"])
def source_preview(spark, sf):
    """IO-3: pruned head preview of three renamed columns (the limit is the feature)."""
    li = views.table(spark, sf, "lineitem")
    names = {"l_orderkey": "order_id", "l_quantity": "quantity", "l_extendedprice": "price"}
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return preview(li, names, 6, order)


@query("time_parse_offsets", sql="""
  SELECT user_id, count(*) AS n, count(utc) AS parsed, min(utc) AS first_ts, max(utc) AS last_ts FROM (
    SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) - INTERVAL 1 HOUR * (event_id % 3) END AS utc FROM events)
  GROUP BY 1
""", stamps=["first_ts", "last_ts"])
def time_parse_offsets(spark, sf):
    """TM-1: offset strings to UTC; text that is not a time becomes missing."""
    ev = views.table(spark, sf, "events")
    wall = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("no time "), wall)).otherwise(
        F.concat(wall, F.lit("+0"), (F.col("event_id") % 3).cast("string"), F.lit(":00"))
    )
    parsed = ev.withColumn("utc", parse_instant(text))
    return parsed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("utc").alias("parsed"), F.min("utc").alias("first_ts"), F.max("utc").alias("last_ts")
    )


@query("time_civil_hours", sql="""
  SELECT date_trunc('hour', timezone('Europe/Madrid', timezone('UTC', o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24)))) AS local_ts, count(*) AS n
  FROM orders GROUP BY 1
""", stamps=["local_ts"])
def time_civil_hours(spark, sf):
    """TM-2: UTC to civil time across years of DST changes."""
    o = views.table(spark, sf, "orders")
    ts = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate")).cast("timestamp_ntz")
    return o.groupBy(truncate(civil(ts), "hour").alias("local_ts")).agg(F.count(F.lit(1)).alias("n"))


@query("grid_expected", ["cells"], sql="""
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM cells GROUP BY series_id
""", stamps=["ts"])
def grid_expected(spark, sf):
    """TM-3: expected hourly grid per series."""
    return grid.expected_grid(views.cells(spark, sf), HOURLY).select("series_id", "ts")


@query("grid_future_index", ["cells"], sql="""
  SELECT series_id, origin, h, 'h+' || h AS forecast_horizon, origin + INTERVAL 1 HOUR * h AS ts
  FROM (SELECT series_id, max(ts) AS origin FROM cells GROUP BY 1), (SELECT unnest(generate_series(1, 24)) AS h)
""", stamps=["origin", "ts"], whole=["h"])
def grid_future_index(spark, sf):
    """TM-4: the 24 steps after each series' last instant."""
    origins = views.cells(spark, sf).groupBy("series_id").agg(F.max("ts").alias("origin"))
    return grid.future_steps(origins, HOURLY, 24)


@query("resample_daily_mean", ["panel"], sql="""
  SELECT series_id, date_trunc('day', ts) AS ts, avg(y) AS y, avg(total) AS total FROM panel GROUP BY 1, 2
""", doubles=["y", "total"], stamps=["ts"], places=8)
def resample_daily_mean(spark, sf):
    """TM-5: daily means of hourly values."""
    return grid.resample_mean(views.panel(spark, sf), HOURLY, "day", ["y", "total"])


@query("grid_missing_hours", ["cells"], sql="""
  SELECT series_id, ts FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM cells GROUP BY series_id) g
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.series_id = g.series_id AND c.ts = g.ts)
""", stamps=["ts"])
def grid_missing_hours(spark, sf):
    """GR-1: grid hours without a row."""
    return grid.missing_steps(views.cells(spark, sf), HOURLY)


@query("grid_step_check", ["cells"], sql="""
  SELECT series_id, count(*) AS n_rows, count(d) AS n_diffs, count(*) FILTER (WHERE d <> INTERVAL 1 HOUR) AS bad_steps
  FROM (SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM cells) GROUP BY 1
""", whole=["n_rows", "n_diffs", "bad_steps"])
def grid_step_check(spark, sf):
    """GR-2: successive differences that are not one hour."""
    return grid.step_report(views.cells(spark, sf), HOURLY)


@query("grid_step_check_users", sql="""
  SELECT series_id, count(*) AS n_rows, count(d) AS n_diffs, count(*) FILTER (WHERE d <> INTERVAL 1 HOUR) AS bad_steps
  FROM (SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS d
        FROM (SELECT DISTINCT user_id AS series_id, date_trunc('hour', ts) AS ts FROM events)) GROUP BY 1
""", whole=["n_rows", "n_diffs", "bad_steps"])
def grid_step_check_users(spark, sf):
    """GR-2 over one series per user."""
    ev = views.table(spark, sf, "events")
    hours = ev.groupBy(F.col("user_id").alias("series_id"), truncate(F.col("ts"), "hour").alias("ts")).agg(F.lit(1).alias("one"))
    return grid.step_report(hours.drop("one"), HOURLY)


@query("grid_densify", ["panel"], sql="SELECT series_id, ts, pos, n_steps, y, n FROM panel",
       doubles=["y"], stamps=["ts"], whole=["pos", "n_steps"], places=8)
def grid_densify(spark, sf):
    """GR-3: gap-free panel with positions."""
    return views.panel(spark, sf).select("series_id", "ts", "pos", "n_steps", "y", "n")


@query("grid_densify_users", ["user_panel"], sql="""
  SELECT series_id, count(*) AS steps, max(pos) AS last_pos, max(n_steps) AS n_steps, sum(y) AS y, count(*) FILTER (WHERE y = 0) AS empty_steps
  FROM user_panel GROUP BY 1
""", doubles=["y"], whole=["steps", "last_pos", "n_steps"], digits={"y": 3})
def grid_densify_users(spark, sf):
    """GR-3 for many series."""
    p = views.user_panel(spark, sf)
    return p.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("steps"), F.max("pos").alias("last_pos"), F.max("n_steps").alias("n_steps"),
        F.sum("y").alias("y"), F.count_if(F.col("y") == 0).alias("empty_steps"),
    )


@query("grid_densify_daily", ["daily"], sql="SELECT series_id, ts, pos, n_steps, y, orders FROM daily",
       doubles=["y", "orders"], stamps=["ts"], whole=["pos", "n_steps"], digits={"y": 5})
def grid_densify_daily(spark, sf):
    """GR-3 on a daily step, empty days filled with zero."""
    return views.daily(spark, sf).select("series_id", "ts", "pos", "n_steps", "y", "orders")
