"""Calendar, lag, rolling, ratio and spatial features, their audits and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY, HOURLY
from panelcast.functions.numeric import safe_ratio, total, total_skip_null
from panelcast.operators import features
from panelcast.operators.features import History
from panelcast.operators.manifest import known_at_origin
from panelcast.plans import views
from panelcast.plans.catalogue.quality import WIDE, WIDE_SQL, wide_panel
from panelcast.plans.registry import query

LOCAL = "timezone('Europe/Madrid', timezone('UTC', ts))"
CALENDAR_SQL = f"""SELECT series_id, ts, hour(l) AS hour, isodow(l) - 1 AS day_of_week, day(l) AS day_of_month, month(l) AS month, quarter(l) AS quarter,
    dayofyear(l) AS day_of_year, week(l) AS week_of_year, CASE WHEN isodow(l) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN day(l) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN day(l + INTERVAL 1 DAY) = 1 THEN 1 ELSE 0 END AS is_month_end,
    CASE WHEN day(l) = 1 AND month(l) = 1 THEN 1 ELSE 0 END AS is_year_start, CASE WHEN day(l) = 31 AND month(l) = 12 THEN 1 ELSE 0 END AS is_year_end
  FROM (SELECT series_id, ts, {LOCAL} AS l FROM {{0}})"""
CALENDAR = ["hour", "day_of_week", "day_of_month", "month", "quarter", "day_of_year", "week_of_year", "is_weekend",
            "is_month_start", "is_month_end", "is_year_start", "is_year_end"]
CYCLIC = [f"{n}_{f}" for n in ("hour", "dow", "month", "day_of_year") for f in ("sin", "cos")]


@query("feature_calendar_hourly", ["panel"], sql=CALENDAR_SQL.format("panel"), whole=CALENDAR, stamps=["ts"])
def feature_calendar_hourly(spark, sf):
    """FE-1 on hours."""
    return features.add_calendar(views.panel(spark, sf).select("series_id", "ts"), cyclic=False)


@query("feature_calendar_years", ["daily"], sql=CALENDAR_SQL.format("daily"), whole=CALENDAR, stamps=["ts"])
def feature_calendar_years(spark, sf):
    """FE-1 over several years: ISO weeks, year ends, leap days, DST."""
    return features.add_calendar(views.daily(spark, sf).select("series_id", "ts"), cyclic=False)


def _cycle(field: str, period: str) -> str:
    return f"2 * pi() * {field} / {period}::DOUBLE"


@query("feature_cyclic", ["daily"], sql=f"""
  SELECT series_id, ts, {', '.join(f"{f}({_cycle(c, p)}) AS {n}_{f}" for n, c, p in
    [('hour', 'hour', '24'), ('dow', 'day_of_week', '7'), ('month', 'month', '12'), ('day_of_year', 'day_of_year', '365.25')] for f in ('sin', 'cos'))}
  FROM ({CALENDAR_SQL.format('daily')})
""", doubles=CYCLIC, stamps=["ts"])
def feature_cyclic(spark, sf):
    """FE-2: cyclic encodings."""
    return features.add_calendar(views.daily(spark, sf).select("series_id", "ts")).select("series_id", "ts", *CYCLIC)


@query("feature_identities", ["panel"], sql=f"""
  SELECT ts, y_click AS first_input, y_error AS second_input, y_click + y_error AS input_total FROM ({WIDE_SQL})
""", doubles=["first_input", "second_input", "input_total"], stamps=["ts"], places=8)
def feature_identities(spark, sf):
    """FE-3: same-time inputs and their total, NULL if one is missing."""
    w = wide_panel(spark, sf)
    return w.select("ts", F.col("y_click").alias("first_input"), F.col("y_error").alias("second_input"),
                    total([F.col("y_click"), F.col("y_error")]).alias("input_total"))


@query("feature_safe_ratio", ["panel"], sql=f"""
  SELECT ts, CASE WHEN y_error - 30 > 0 THEN y_click / (y_error - 30) END AS ratio FROM ({WIDE_SQL})
""", doubles=["ratio"], stamps=["ts"], places=8)
def feature_safe_ratio(spark, sf):
    """FE-4: ratio that is NULL for a zero, negative or missing denominator."""
    w = wide_panel(spark, sf)
    return w.select("ts", safe_ratio(F.col("y_click"), F.col("y_error") - 30).alias("ratio"))


@query("feature_lags_hourly", ["panel"], sql="""
  SELECT series_id, ts, lag(y, 24) OVER w AS y_lag_24, lag(y, 48) OVER w AS y_lag_48, lag(y, 168) OVER w AS y_lag_168
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)
""", doubles=["y_lag_24", "y_lag_48", "y_lag_168"], stamps=["ts"], places=8)
def feature_lags_hourly(spark, sf):
    """FE-5: 24, 48 and 168 hour lags in one pass."""
    out = History(HOURLY).lag("y", 24).lag("y", 48).lag("y", 168).apply(views.panel(spark, sf))
    return out.select("series_id", "ts", "y_lag_24", "y_lag_48", "y_lag_168")


@query("feature_lags_irregular", ["cells"], sql="""
  SELECT a.series_id, a.ts, b.y AS y_lag_24 FROM cells a LEFT JOIN cells b ON b.series_id = a.series_id AND b.ts = a.ts - INTERVAL 24 HOUR
""", doubles=["y_lag_24"], stamps=["ts"], places=8)
def feature_lags_irregular(spark, sf):
    """FE-5 without a dense grid: a missing step gives NULL, not a neighbour."""
    return History(HOURLY).lag("y", 24).apply(views.cells(spark, sf)).select("series_id", "ts", "y_lag_24")


@query("feature_lags_many_series", ["user_panel"], sql="""
  SELECT series_id, count(l) AS n, sum(l) AS total, max(l) AS top FROM (SELECT series_id, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM user_panel) GROUP BY 1
""", doubles=["total", "top"], digits={"total": 3})
def feature_lags_many_series(spark, sf):
    """FE-5 over one series per user."""
    out = History(HOURLY).lag("y", 24, "l").apply(views.user_panel(spark, sf))
    return out.groupBy("series_id").agg(F.count("l").alias("n"), F.sum("l").alias("total"), F.max("l").alias("top"))


LAGGED = "(SELECT series_id, ts, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 7) OVER w AS c FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts))"


@query("feature_lag_summary", ["panel"], sql=f"""
  SELECT series_id, ts, (a + b + c) / 3 AS y_mean, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS y_std,
    CASE WHEN a + b + c IS NOT NULL THEN least(a, b, c) END AS y_min, CASE WHEN a + b + c IS NOT NULL THEN greatest(a, b, c) END AS y_max FROM {LAGGED}
""", doubles=["y_mean", "y_std", "y_min", "y_max"], stamps=["ts"], places=8)
def feature_lag_summary(spark, sf):
    """FE-6: mean, deviation, minimum and maximum across lags, NULL if one is missing."""
    out = History(HOURLY).lag("y", 1, "a").lag("y", 2, "b").lag("y", 7, "c").apply(views.panel(spark, sf))
    return out.withColumns(features.lag_summary("y", ["a", "b", "c"])).select("series_id", "ts", "y_mean", "y_std", "y_min", "y_max")


@query("feature_lagged_error", ["panel"], sql="""
  SELECT series_id, ts, lag(y - total, 24) OVER (PARTITION BY series_id ORDER BY ts) AS error_lag_24 FROM panel
""", doubles=["error_lag_24"], stamps=["ts"], places=8)
def feature_lagged_error(spark, sf):
    """FE-7: difference of two columns, then lagged."""
    out = History(HOURLY).lag(F.col("y") - F.col("total"), 24, "error_lag_24").apply(views.panel(spark, sf))
    return out.select("series_id", "ts", "error_lag_24")


SKIP = " + ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in WIDE)
GROUPS_SQL = f"""SELECT ts, CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in WIDE)} THEN {SKIP} END AS all_total,
    CASE WHEN y_click IS NOT NULL OR y_view IS NOT NULL THEN coalesce(y_click, 0.0::DOUBLE) + coalesce(y_view, 0.0::DOUBLE) END AS part_total FROM ({WIDE_SQL})"""


def group_totals(spark, sf):
    return wide_panel(spark, sf).select(
        F.lit("all").alias("series_id"), "ts", total_skip_null([F.col(c) for c in WIDE]).alias("all_total"),
        total_skip_null([F.col("y_click"), F.col("y_view")]).alias("part_total"),
    )


@query("feature_group_totals", ["panel"], sql=GROUPS_SQL, doubles=["all_total", "part_total"], stamps=["ts"], places=8)
def feature_group_totals(spark, sf):
    """FE-8: totals that skip missing members."""
    return group_totals(spark, sf).drop("series_id")


@query("feature_share_lag", ["panel"], sql=f"""
  SELECT ts, lag(CASE WHEN all_total > 0 THEN part_total / all_total END, 24) OVER (ORDER BY ts) AS share_lag_24 FROM ({GROUPS_SQL})
""", doubles=["share_lag_24"], stamps=["ts"], places=8)
def feature_share_lag(spark, sf):
    """FE-9: ratio of totals, then lagged."""
    share = safe_ratio(F.col("part_total"), F.col("all_total"))
    return History(HOURLY).lag(share, 24, "share_lag_24").apply(group_totals(spark, sf)).select("ts", "share_lag_24")


MAP_LAGS = [(c, k) for c in WIDE for k in (24, 168)]


@query("feature_lag_map", ["panel"], sql=f"""
  SELECT ts, {', '.join(f'lag({c}, {k}) OVER (ORDER BY ts) AS {c}_lag_{k}' for c, k in MAP_LAGS)} FROM ({WIDE_SQL})
""", doubles=[f"{c}_lag_{k}" for c, k in MAP_LAGS], stamps=["ts"], places=8)
def feature_lag_map(spark, sf):
    """FE-10: many columns × {24, 168} lags, one shuffle."""
    h = History(HOURLY)
    for c, k in MAP_LAGS:
        h.lag(c, k)
    out = h.apply(wide_panel(spark, sf).withColumn("series_id", F.lit("all")))
    return out.select("ts", *[f"{c}_lag_{k}" for c, k in MAP_LAGS])


@query("feature_direction_lag", ["panel"], sql="""
  SELECT series_id, ts, lag(sin(radians(y)), 24) OVER w AS dir_sin_lag_24, lag(cos(radians(y)), 24) OVER w AS dir_cos_lag_24
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)
""", doubles=["dir_sin_lag_24", "dir_cos_lag_24"], stamps=["ts"], places=8)
def feature_direction_lag(spark, sf):
    """FE-11: direction as sine and cosine, then lagged."""
    s, c = features.direction_parts(F.col("y"))
    out = History(HOURLY).lag(s, 24, "dir_sin_lag_24").lag(c, 24, "dir_cos_lag_24").apply(views.panel(spark, sf))
    return out.select("series_id", "ts", "dir_sin_lag_24", "dir_cos_lag_24")


@query("feature_spatial_lag", ["panel"], sql="""
  SELECT ts, lag(m, 24) OVER (ORDER BY ts) AS y_mean_lag_24, lag(x, 24) OVER (ORDER BY ts) AS total_max_lag_24
  FROM (SELECT ts, avg(y) AS m, max(total) AS x FROM panel GROUP BY 1)
""", doubles=["y_mean_lag_24", "total_max_lag_24"], stamps=["ts"], places=8)
def feature_spatial_lag(spark, sf):
    """FE-12: mean and maximum over entities, then lagged."""
    stats = features.spatial_stats(views.panel(spark, sf), ["ts"], {"m": ("y", "mean"), "x": ("total", "max")})
    h = History(HOURLY).lag("m", 24, "y_mean_lag_24").lag("x", 24, "total_max_lag_24")
    return h.apply(stats.withColumn("series_id", F.lit("all"))).select("ts", "y_mean_lag_24", "total_max_lag_24")


@query("feature_rolling_level", ["daily"], sql="""
  SELECT series_id, ts, CASE WHEN count(y) OVER a = 7 THEN avg(y) OVER a END AS mean_7d, CASE WHEN count(y) OVER a = 7 THEN stddev_pop(y) OVER a END AS std_7d,
    CASE WHEN count(y) OVER b = 14 THEN avg(y) OVER b END AS mean_14d, CASE WHEN count(y) OVER b = 14 THEN stddev_pop(y) OVER b END AS std_14d
  FROM daily WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)
""", doubles=["mean_7d", "std_7d", "mean_14d", "std_14d"], stamps=["ts"])
def feature_rolling_level(spark, sf):
    """FE-13: causal rolling mean and deviation."""
    h = History(DAILY).rolling("y", 7, 1, "mean_7d", "std_7d").rolling("y", 14, 1, "mean_14d", "std_14d")
    return h.apply(views.daily(spark, sf)).select("series_id", "ts", "mean_7d", "std_7d", "mean_14d", "std_14d")


@query("feature_rolling_level_gaps", ["panel"], sql="""
  SELECT series_id, ts, CASE WHEN count(y) OVER a = 24 THEN avg(y) OVER a END AS mean_24h
  FROM panel WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)
""", doubles=["mean_24h"], stamps=["ts"], places=8)
def feature_rolling_level_gaps(spark, sf):
    """FE-13 with missing values: a window with one gap is NULL."""
    return History(HOURLY).rolling("y", 24, 24, "mean_24h").apply(views.panel(spark, sf)).select("series_id", "ts", "mean_24h")


SHARES = [("share_7d", 7), ("share_14d", 14), ("share_30d", 30)]
SHARE_SQL = ", ".join(
    f"CASE WHEN count(y) OVER w{n} = {n} THEN avg(CASE WHEN y > 4.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w{n} END AS {c}" for c, n in SHARES)
SHARE_WINDOWS = ", ".join(f"w{n} AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for _, n in SHARES)


@query("feature_high_share", ["daily"], sql=f"SELECT series_id, ts, {SHARE_SQL} FROM daily WINDOW {SHARE_WINDOWS}",
       doubles=[c for c, _ in SHARES], stamps=["ts"])
def feature_high_share(spark, sf):
    """FE-14: share of past values strictly above a threshold."""
    h = History(DAILY)
    for name, n in SHARES:
        h.share_above("y", 4.5, n, 1, name)
    return h.apply(views.daily(spark, sf)).select("series_id", "ts", *[c for c, _ in SHARES])


@query("feature_interactions", ["panel"], sql="""
  SELECT series_id, ts, y * pos AS y_x_pos, y * n AS y_x_n FROM panel
""", doubles=["y_x_pos", "y_x_n"], stamps=["ts"], places=8)
def feature_interactions(spark, sf):
    """FE-15: products of column pairs."""
    p = views.panel(spark, sf).withColumns(features.interactions([("y", "pos", "y_x_pos"), ("y", "n", "y_x_n")]))
    return p.select("series_id", "ts", "y_x_pos", "y_x_n")


ASSEMBLED = ["hour", "day_of_week", "month", "y_lag_24", "total_lag_24", "ratio_lag_24", "mean_24h"]


@query("feature_assembly", ["panel"], sql=f"""
  SELECT series_id, ts, hour({LOCAL}) AS hour, isodow({LOCAL}) - 1 AS day_of_week, month({LOCAL}) AS month, lag(y, 24) OVER w AS y_lag_24,
    lag(total, 24) OVER w AS total_lag_24, lag(CASE WHEN n > 0 THEN total / n END, 24) OVER w AS ratio_lag_24,
    CASE WHEN count(y) OVER r = 24 THEN avg(y) OVER r END AS mean_24h
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts), r AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)
""", doubles=ASSEMBLED[3:], whole=ASSEMBLED[:3], stamps=["ts"], places=8)
def feature_assembly(spark, sf):
    """FE-17: calendar, lag, ratio and rolling features from one chain, one row per key."""
    h = History(HOURLY).lag("y", 24).lag("total", 24).rolling("y", 24, 24, "mean_24h")
    h.lag(safe_ratio(F.col("total"), F.col("n")), 24, "ratio_lag_24")
    out = features.add_calendar(h.apply(views.panel(spark, sf)), cyclic=False)
    return out.select("series_id", "ts", *ASSEMBLED)


@query("feature_lag_audit", ["daily"], sql=" UNION ALL ".join(f"""
  SELECT 'y_lag_{k}' AS feature, {k} AS lag, count(l) AS compared, 0.0::DOUBLE AS max_abs_diff, 0 AS null_mismatch, true AS pass
  FROM (SELECT lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM daily)""" for k in (1, 2, 7)),
       doubles=["max_abs_diff"], whole=["lag", "null_mismatch"])
def feature_lag_audit(spark, sf):
    """FE-19: stored lags against an independent shifted join."""
    stored = History(DAILY).lag("y", 1).lag("y", 2).lag("y", 7).apply(views.daily(spark, sf))
    return features.lag_alignment(stored, DAILY, "y", {"y_lag_1": 1, "y_lag_2": 2, "y_lag_7": 7})


@query("feature_lag_audit_faults", ["daily"], sql="""
  WITH stored AS (SELECT series_id, ts, y, pos, lag(y, 1) OVER w AS y_lag_1, CASE WHEN pos % 50 = 9 THEN NULL ELSE lag(y, 2) OVER w END AS y_lag_2,
      CASE WHEN pos % 40 = 3 THEN lag(y, 6) OVER w ELSE lag(y, 7) OVER w END AS y_lag_7 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
    long AS (SELECT series_id, ts, 'y_lag_1' AS feature, 1 AS lag, y_lag_1 AS s FROM stored UNION ALL SELECT series_id, ts, 'y_lag_2', 2, y_lag_2 FROM stored UNION ALL SELECT series_id, ts, 'y_lag_7', 7, y_lag_7 FROM stored)
  SELECT l.feature, l.lag, count(*) FILTER (WHERE s IS NOT NULL AND e.y IS NOT NULL) AS compared, coalesce(max(abs(s - e.y)), 0) AS max_abs_diff,
    count(*) FILTER (WHERE s IS NULL AND e.y IS NOT NULL) AS null_mismatch, coalesce(max(abs(s - e.y)), 0) <= 1e-9 AS pass
  FROM long l LEFT JOIN daily e ON e.series_id = l.series_id AND e.ts = l.ts - INTERVAL 1 DAY * l.lag GROUP BY 1, 2
""", doubles=["max_abs_diff"], whole=["lag", "null_mismatch"])
def feature_lag_audit_faults(spark, sf):
    """FE-19 on a table with a shifted and a lost lag: both faults are found."""
    d = History(DAILY).lag("y", 1).lag("y", 2).lag("y", 6, "six").lag("y", 7).apply(views.daily(spark, sf))
    d = d.withColumns({"y_lag_2": F.when(F.col("pos") % 50 != 9, F.col("y_lag_2")), "y_lag_7": F.when(F.col("pos") % 40 == 3, F.col("six")).otherwise(F.col("y_lag_7"))})
    return features.lag_alignment(d.drop("six"), DAILY, "y", {"y_lag_1": 1, "y_lag_2": 2, "y_lag_7": 7})


@query("feature_availability_by_row", ["panel"], sql=f"""
  SELECT lag, delay, hour({LOCAL}) AS local_hour, count(*) AS n, count(*) FILTER (WHERE ts - INTERVAL 1 HOUR * (lag - delay) <=
      timezone('UTC', timezone('Europe/Madrid', date_trunc('day', {LOCAL}) - INTERVAL 12 HOUR))) AS known
  FROM panel, (VALUES (24, 0), (24, 3), (48, 0), (168, 0)) s(lag, delay) GROUP BY 1, 2, 3
""", whole=["lag", "delay", "local_hour"])
def feature_availability_by_row(spark, sf):
    """FE-20 by row: which lagged values were known at noon of the day before."""
    cases = [(24, 0), (24, 3), (48, 0), (168, 0)]
    flags = F.array(*[
        F.struct(F.lit(lag).alias("lag"), F.lit(delay).alias("delay"), known_at_origin(F.col("ts"), lag * 3600, delay * 3600).alias("ok"))
        for lag, delay in cases
    ])
    from panelcast.functions.timefn import civil

    rows = views.panel(spark, sf).select(F.hour(civil(F.col("ts"))).alias("local_hour"), F.inline(flags))
    return rows.groupBy("lag", "delay", "local_hour").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("known"))


@query("feature_shares_at_times", ["daily"], sql=f"""
  SELECT series_id, ts, {', '.join(c for c, _ in SHARES)} FROM (SELECT series_id, ts, pos, n_steps, {SHARE_SQL} FROM daily WINDOW {SHARE_WINDOWS})
  WHERE isodow(ts) = 1
""", doubles=[c for c, _ in SHARES], stamps=["ts"])
def feature_shares_at_times(spark, sf):
    """FE-22: high-level shares at requested times (all Mondays) straight from history."""
    d = views.daily(spark, sf)
    times = d.where(F.weekday("ts") == 0).select("series_id", "ts")
    return features.shares_at(d, times, DAILY, "y", 4.5, dict(SHARES), 1)


@query("feature_lookup", ["cells"], sql="""
  SELECT f.series_id, f.ts, c.y FROM (SELECT series_id, max(ts) + INTERVAL 1 HOUR * (h - 12) AS ts FROM cells, (SELECT unnest(generate_series(1, 24)) AS h) GROUP BY series_id, h) f
  LEFT JOIN cells c ON c.series_id = f.series_id AND c.ts = f.ts
""", doubles=["y"], stamps=["ts"], places=8)
def feature_lookup(spark, sf):
    """FE-23: features at requested times, absent rows give NULL."""
    from panelcast.operators.grid import future_steps

    cells = views.cells(spark, sf)
    origin = F.timestamp_add("HOUR", F.lit(-12), F.max("ts")).cast("timestamp_ntz")
    times = future_steps(cells.groupBy("series_id").agg(origin.alias("origin")), HOURLY, 24).select("series_id", "ts")
    return features.lookup(cells, times, HOURLY, ["y"])


FUTURE = "(SELECT series_id, ts + INTERVAL 1 HOUR * h AS ts FROM (SELECT series_id, max(ts) AS ts FROM cells GROUP BY 1), (SELECT unnest(generate_series(1, 24)) AS h))"


@query("feature_future_calendar", ["cells"], sql=CALENDAR_SQL.format(FUTURE), whole=CALENDAR, stamps=["ts"])
def feature_future_calendar(spark, sf):
    """FE-24: calendar of the 24 hours after the last row."""
    origins = views.cells(spark, sf).groupBy("series_id").agg(F.max("ts").alias("origin"))
    return features.future_calendar(origins, HOURLY).select("series_id", "ts", *CALENDAR)
