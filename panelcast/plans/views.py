"""Standard panels derived from the driver's tables; every registered query starts from one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.contract import DAILY, HOURLY
from panelcast.functions.timefn import truncate
from panelcast.operators.features import History
from panelcast.operators.grid import densify
from panelcast.operators.splits import expanding_folds
from panelcast.session import prepare

# The event types play the part of the entities.
ENTITIES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type × hour cells that hold at least one event."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("series_id"), truncate(F.col("ts"), "hour").alias("ts")).agg(
        F.avg("value").alias("y"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")
    )


def extent(table: DataFrame, key: Column, ts: str) -> DataFrame:
    """Raw keys and times, from which grids take their range."""
    return table.select(key.alias("series_id"), F.col(ts).alias("ts"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense event type × hour panel; hours without events are NULL rows."""
    ev = table(spark, sf_dir, "events")
    return densify(cells(spark, sf_dir), HOURLY, extent=extent(ev, F.col("event_type"), "ts"))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense user × hour panel: many series."""
    ev = table(spark, sf_dir, "events")
    grouped = ev.groupBy(F.col("user_id").alias("series_id"), truncate(F.col("ts"), "hour").alias("ts")).agg(
        F.sum("value").alias("y")
    )
    return densify(grouped, HOURLY, {"y": 0.0}, extent(ev, F.col("user_id"), "ts"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by hour as one dense series."""
    ev = table(spark, sf_dir, "events")
    grouped = ev.groupBy(F.lit("ALL").alias("series_id"), truncate(F.col("ts"), "hour").alias("ts")).agg(
        F.avg("value").alias("y")
    )
    return densify(grouped, HOURLY, extent=extent(ev, F.lit("ALL"), "ts"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log order value by priority and day, dense; a day without orders is 0."""
    o = table(spark, sf_dir, "orders")
    grouped = o.groupBy(F.col("o_orderpriority").alias("series_id"), truncate(F.col("o_orderdate"), "day").alias("ts")).agg(
        F.log1p(F.sum("o_totalprice") / 1000.0).alias("y"), F.count(F.lit(1)).cast("double").alias("orders")
    )
    return densify(grouped, DAILY, {"y": 0.0, "orders": 0.0}, extent(o, F.col("o_orderpriority"), "o_orderdate"))


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments by return flag and day, dense, NULL where nothing was shipped."""
    li = table(spark, sf_dir, "lineitem")
    grouped = li.groupBy(F.col("l_returnflag").alias("series_id"), truncate(F.col("l_shipdate"), "day").alias("ts")).agg(
        (F.sum("l_extendedprice") / 1000.0).alias("y"), F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
    )
    return densify(grouped, DAILY, extent=extent(li, F.col("l_returnflag"), "l_shipdate"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with a same-weekday naive value and the mean of the 1- and 7-day lags as prediction."""
    lags = History(DAILY).lag("y", 1, "lag_1d").lag("y", 7, "lag_7d")
    out = lags.apply(daily(spark, sf_dir)).where(F.col("lag_7d").isNotNull())
    return out.withColumn("pred", (F.col("lag_1d") + F.col("lag_7d")) / 2.0).withColumn("naive", F.col("lag_7d"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_folds(scored(spark, sf_dir))


FOLD = ["series_id", "fold"]

# --- the same views as SQL for the oracle -------------------------------------------------------


def _dense(cells_cte: str, name: str, step: str, measures: str) -> str:
    return f"""{name}_bounds AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM {cells_cte} GROUP BY 1),
{name}_grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS ts FROM {name}_bounds),
{name} AS (SELECT g.series_id, g.ts, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos,
  count(*) OVER (PARTITION BY g.series_id) AS n_steps, {measures} FROM {name}_grid g LEFT JOIN {cells_cte} c ON c.series_id = g.series_id AND c.ts = g.ts)"""


CTES: dict[str, str] = {
    "cells": """cells AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y, sum(value) AS total,
  count(*) AS n FROM events GROUP BY 1, 2)""",
    "panel": _dense("cells", "panel", "HOUR", "c.y, c.total, c.n"),
    "user_cells": "user_cells AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 1, 2)",
    "user_panel": _dense("user_cells", "user_panel", "HOUR", "coalesce(c.y, 0.0) AS y"),
    "hourly_cells": "hourly_cells AS (SELECT 'ALL' AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2)",
    "hourly": _dense("hourly_cells", "hourly", "HOUR", "c.y"),
    "daily_cells": """daily_cells AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
  ln(1.0::DOUBLE + sum(o_totalprice) / 1000.0::DOUBLE) AS y, count(*)::DOUBLE AS orders FROM orders GROUP BY 1, 2)""",
    "daily": _dense("daily_cells", "daily", "DAY", "coalesce(c.y, 0.0) AS y, coalesce(c.orders, 0.0) AS orders"),
    "ships_cells": """ships_cells AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
  sum(l_extendedprice) / 1000.0::DOUBLE AS y, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2)""",
    "ships": _dense("ships_cells", "ships", "DAY", "c.y, c.qty, c.disc, c.tax"),
    "scored": """scored AS (SELECT * FROM (SELECT d.*, lag(y, 1) OVER w AS lag_1d, lag(y, 7) OVER w AS lag_7d,
  (lag(y, 1) OVER w + lag(y, 7) OVER w) / 2.0::DOUBLE AS pred, lag(y, 7) OVER w AS naive
  FROM daily d WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE lag_7d IS NOT NULL)""",
    "cuts": """cuts(fold, lo, hi) AS (VALUES (1, 0.5::DOUBLE, 0.6::DOUBLE), (2, 0.6::DOUBLE, 0.7::DOUBLE), (3, 0.7::DOUBLE, 0.8::DOUBLE), (4, 0.8::DOUBLE, 1.0::DOUBLE))""",
    "folds": """folds AS (SELECT * FROM (SELECT s.*, fold, CAST(floor(n_steps * lo) AS BIGINT) AS cut,
  CASE WHEN pos < floor(n_steps * lo) THEN 'train' WHEN pos < floor(n_steps * hi) THEN 'validation' END AS role
  FROM scored s, cuts) WHERE role IS NOT NULL)""",
    "splits": """splits AS (SELECT *, CASE WHEN pos < floor(n_steps * 0.70::DOUBLE) THEN 'train'
  WHEN pos < floor(n_steps * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM scored)""",
}
DEPENDS = {
    "panel": ["cells"], "user_panel": ["user_cells"], "hourly": ["hourly_cells"], "daily": ["daily_cells"],
    "ships": ["ships_cells"], "scored": ["daily"], "folds": ["scored", "cuts"], "splits": ["scored"],
}


def with_ctes(names: list[str]) -> str:
    """Text of the named CTEs with everything they depend on, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        for d in DEPENDS.get(name, []):
            visit(d)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    return ",\n".join(CTES[n] for n in done)


