"""Collapsing duplicates, gap filling, pivots and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import HOURLY
from panelcast.functions.numeric import circular_mean
from panelcast.operators import clean
from panelcast.operators.splits import chronological_split
from panelcast.plans import views
from panelcast.plans.catalogue.quality import KEYED, KEYS, WIDE, WIDE_SQL, keyed_events
from panelcast.plans.registry import query

CIRCLE = "degrees(atan2(avg(sin(radians({0}))), avg(cos(radians({0})))))"
CIRCULAR_SQL = f"CASE WHEN {CIRCLE} < 0 THEN {CIRCLE} + 360 ELSE {CIRCLE} END"


def mode_sql(keys: str, column: str, source: str, cast: str = "VARCHAR") -> str:
    return f"""(SELECT {keys}, first({column} ORDER BY c DESC, CAST({column} AS {cast})) AS {column}
      FROM (SELECT {keys}, {column}, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY ALL) GROUP BY {keys})"""


ANGLED = "(SELECT *, value % 360 AS angle FROM (SELECT date_trunc('hour', ts) AS ts_hour, user_id, event_type, value FROM events))"


@query("clean_collapse_duplicates", sql=f"""
  SELECT a.ts_hour, a.user_id, a.n_rows, a.mean_v, a.max_v, a.median_v, m.event_type FROM
    (SELECT ts_hour, user_id, count(*) AS n_rows, avg(value) AS mean_v, max(value) AS max_v, quantile_cont(value, 0.5) AS median_v FROM {KEYED} GROUP BY 1, 2) a
  JOIN {mode_sql('ts_hour, user_id', 'event_type', KEYED)} m ON a.ts_hour = m.ts_hour AND a.user_id = m.user_id
""", doubles=["mean_v", "max_v", "median_v"], stamps=["ts_hour"])
def clean_collapse_duplicates(spark, sf):
    """CL-1: one row per (hour, user) with one rule per column."""
    ev = keyed_events(spark, sf).select(*KEYS, "event_type", *[F.col("value").alias(f"{r}_v") for r in ("mean", "max", "median")])
    return clean.collapse(ev, KEYS, {"mean_v": "mean", "max_v": "max", "median_v": "median", "event_type": "mode"})


@query("clean_circular_mean", sql=f"""
  SELECT event_type, date_trunc('day', ts_hour) AS ts, {CIRCULAR_SQL.format('angle')} AS direction FROM {ANGLED} GROUP BY 1, 2
""", doubles=["direction"], stamps=["ts"])
def clean_circular_mean(spark, sf):
    """CL-2: circular mean of directions."""
    ev = keyed_events(spark, sf)
    ts = F.date_trunc("day", "ts_hour").cast("timestamp_ntz").alias("ts")
    return ev.groupBy("event_type", ts).agg(circular_mean(F.col("value") % 360).alias("direction"))


@query("clean_mode_text", sql=f"SELECT * FROM {mode_sql('ts_hour', 'event_type', KEYED)}", stamps=["ts_hour"])
def clean_mode_text(spark, sf):
    """CL-3: most frequent category, ties by string order."""
    return clean.group_mode(keyed_events(spark, sf), ["ts_hour"], "event_type")


@query("clean_mode_number", sql=f"""SELECT * FROM {mode_sql('user_id', 'code', '(SELECT user_id, CAST(floor(value / 8) AS BIGINT) AS code FROM events)')}""")
def clean_mode_number(spark, sf):
    """CL-3 on a numeric code: 10 sorts before 9."""
    ev = views.table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 8).alias("code"))
    return clean.group_mode(ev, ["user_id"], "code")


@query("clean_pivot_entities", ["panel"], sql=WIDE_SQL, doubles=WIDE, stamps=["ts"], places=8)
def clean_pivot_entities(spark, sf):
    """CL-4: long entities to wide columns with a fixed list."""
    return clean.pivot_entities(views.panel(spark, sf), ["ts"], "series_id", views.ENTITIES, ["y"])


RUNS_SQL = """SELECT series_id, column_name, min(pos) AS start_pos, max(pos) + 1 AS end_pos, count(*) AS length,
    min(pos) = 0 OR max(pos) = max(n_steps) - 1 AS is_edge FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY series_id, column_name ORDER BY pos) AS island
    FROM (SELECT series_id, 'y' AS column_name, pos, n_steps FROM panel WHERE y IS NULL UNION ALL
          SELECT series_id, 'big' AS column_name, pos, n_steps FROM panel WHERE total IS NULL OR total < 60))
  GROUP BY series_id, column_name, island"""


@query("clean_missing_runs", ["panel"], sql=RUNS_SQL, whole=["start_pos", "end_pos"])
def clean_missing_runs(spark, sf):
    """CL-5: runs of missing values with length and edge flag."""
    p = views.panel(spark, sf).withColumn("big", F.when(F.col("total") >= 60, F.col("total")))
    return clean.missing_runs(p, HOURLY, ["y", "big"])


FILL_SQL = """filled AS (SELECT series_id, ts, pos, y, CASE WHEN y IS NOT NULL THEN y
    WHEN after_pos - before_pos - 1 <= 3 THEN before_y + (after_y - before_y) * (pos - before_pos)::DOUBLE / (after_pos - before_pos) END AS y_filled
  FROM (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS before_pos, last_value(y IGNORE NULLS) OVER b AS before_y,
      first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS after_pos, first_value(y IGNORE NULLS) OVER a AS after_y
    FROM sparse WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""
views.CTES["sparse"] = "sparse AS (SELECT series_id, ts, pos, CASE WHEN y >= 25 THEN y END AS y FROM panel)"
views.CTES["filled"] = FILL_SQL
views.DEPENDS.update({"sparse": ["panel"], "filled": ["sparse"]})


def sparse_panel(spark, sf):
    """Panel whose small values are masked, so that runs of every length occur."""
    return views.panel(spark, sf).withColumn("y", F.when(F.col("y") >= 25, F.col("y")))


@query("clean_fill_short_gaps", ["filled"], sql="SELECT series_id, ts, y_filled AS y FROM filled", doubles=["y"], stamps=["ts"], places=8)
def clean_fill_short_gaps(spark, sf):
    """CL-6: time-linear filling of interior runs of at most three hours."""
    return clean.fill_short_gaps(sparse_panel(spark, sf), HOURLY, ["y"]).select("series_id", "ts", "y")


@query("clean_fill_report", ["filled"], sql="""
  SELECT series_id, 'y' AS column_name, count(*) - count(y) AS before, count(y_filled) - count(y) AS filled, count(*) - count(y_filled) AS remaining
  FROM filled GROUP BY 1
""")
def clean_fill_report(spark, sf):
    """CL-6: what was filled and what stays missing."""
    before = sparse_panel(spark, sf)
    return clean.fill_report(before, clean.fill_short_gaps(before, HOURLY, ["y"]), ["series_id"], ["y"])


@query("clean_measures_allow_list", ["filled"], sql="""
  SELECT f.series_id, f.ts, f.y_filled AS y, p.total AS target FROM filled f JOIN panel p ON f.series_id = p.series_id AND f.ts = p.ts
""", doubles=["y", "target"], stamps=["ts"], places=8)
def clean_measures_allow_list(spark, sf):
    """CL-7: only allow-listed columns are filled, the target is not, empty columns go."""
    p = sparse_panel(spark, sf).withColumn("target", F.col("total")).withColumn("void", F.lit(None).cast("double"))
    out = clean.clean_measures(p, HOURLY, ["y", "void"], ["target"], empty=["void"])
    return out.select("series_id", "ts", "y", "target")


@query("clean_trim_keys", sql="SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def clean_trim_keys(spark, sf):
    """CL-8: keys padded with blanks group again after trimming."""
    c = views.table(spark, sf, "customer")
    padded = F.concat(F.repeat(F.lit(" "), (F.col("c_custkey") % 3).cast("int")), F.col("c_mktsegment"), F.lit("  "))
    return c.groupBy(F.trim(padded).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_one_to_one_join", ["panel", "ships"], sql="""
  SELECT p.series_id, p.ts, p.y, c.total AS side_total, c.n AS side_n FROM panel p LEFT JOIN cells c ON c.series_id = p.series_id AND c.ts = p.ts
""", doubles=["y", "side_total"], stamps=["ts"], places=8)
def clean_one_to_one_join(spark, sf):
    """CL-10: checked one-to-one left join."""
    left = views.panel(spark, sf).select("series_id", "ts", "y")
    right = views.cells(spark, sf).select("series_id", "ts", F.col("total").alias("side_total"), F.col("n").alias("side_n"))
    return clean.one_to_one_left(left, right, ["series_id", "ts"])


@query("clean_melt", ["scored"], sql="""
  SELECT series_id, ts, 'y' AS kind, y AS value FROM scored UNION ALL SELECT series_id, ts, 'pred', pred FROM scored
""", doubles=["value"], stamps=["ts"])
def clean_melt(spark, sf):
    """CL-11: actual and predicted from wide to long."""
    return clean.melt(views.scored(spark, sf), ["series_id", "ts"], ["y", "pred"])


@query("clean_stack_splits", ["splits"], sql="""
  SELECT series_id, ts, y, CASE WHEN split = 'train' THEN pred END AS pred, split FROM splits WHERE split <> 'test'
""", doubles=["y", "pred"], stamps=["ts"])
def clean_stack_splits(spark, sf):
    """CL-12: row concatenation by name; a column one part lacks becomes NULL."""
    s = chronological_split(views.scored(spark, sf))
    train = s.where(F.col("split") == "train").select("series_id", "ts", "y", "pred", "split")
    validation = s.where(F.col("split") == "validation").select("split", "series_id", "ts", "y")
    return clean.stack_frames([train, validation])
