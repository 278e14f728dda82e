"""Quality checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import HOURLY
from panelcast.functions.timefn import truncate
from panelcast.operators import quality
from panelcast.operators.splits import chronological_split
from panelcast.plans import views
from panelcast.plans.registry import query

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["ts_hour", "user_id"]


def keyed_events(spark, sf):
    """Events keyed by hour and user: the key repeats."""
    ev = views.table(spark, sf, "events")
    return ev.select(truncate(F.col("ts"), "hour").alias("ts_hour"), "user_id", "event_type", "value", "props")


KEYED = "(SELECT date_trunc('hour', ts) AS ts_hour, user_id, event_type, value, props FROM events)"
SIZES = f"(SELECT ts_hour, user_id, count(*) AS size FROM {KEYED} GROUP BY 1, 2)"
SUMMARY = """sum(size) AS total_rows, count(*) AS total_groups, count(*) FILTER (WHERE size > 1) AS duplicate_groups,
  coalesce(sum(size) FILTER (WHERE size > 1), 0) AS rows_in_duplicate_groups, sum(size - 1) AS extra_rows,
  count(*) FILTER (WHERE size > 1) * 100.0::DOUBLE / count(*) AS duplicate_group_rate_pct,
  coalesce(sum(size) FILTER (WHERE size > 1), 0) * 100.0::DOUBLE / sum(size) AS rows_in_duplicate_groups_rate_pct,
  sum(size - 1) * 100.0::DOUBLE / sum(size) AS extra_row_rate_pct"""
SUMMARY_WHOLE = ["total_rows", "rows_in_duplicate_groups", "extra_rows"]
SUMMARY_RATES = ["duplicate_group_rate_pct", "rows_in_duplicate_groups_rate_pct", "extra_row_rate_pct"]


@query("quality_index_checks", ["cells"], sql="""
  SELECT series_id, u.check_name, CASE WHEN u.check_name = 'unique_count' THEN true ELSE u.detail = 0 END AS ok, u.detail FROM (
    SELECT series_id, count(*) AS n, count(DISTINCT ts) AS uq, count(*) FILTER (WHERE ts IS NULL) AS unparsed,
      count(*) FILTER (WHERE d <> INTERVAL 1 HOUR) AS bad, date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS miss
    FROM (SELECT series_id, ts, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM cells) GROUP BY 1) q,
  LATERAL (VALUES ('unparsed', unparsed), ('duplicates', n - unparsed - uq), ('unique_count', uq), ('step', bad), ('missing', miss)) u(check_name, detail)
""", whole=["detail"])
def quality_index_checks(spark, sf):
    """QC-1: index checks per series."""
    return quality.index_checks(views.cells(spark, sf).select("series_id", "ts"), HOURLY)


@query("quality_duplicate_summary", sql=f"SELECT {SUMMARY} FROM {SIZES}", whole=SUMMARY_WHOLE, doubles=SUMMARY_RATES)
def quality_duplicate_summary(spark, sf):
    """QC-2: duplicate groups over (hour, user)."""
    return quality.duplicate_summary(keyed_events(spark, sf), KEYS)


@query("quality_multiplicity", sql=f"SELECT size, count(*) AS groups FROM {SIZES} WHERE size > 1 GROUP BY 1")
def quality_multiplicity(spark, sf):
    """QC-3: group size histogram."""
    return quality.multiplicity(keyed_events(spark, sf), KEYS)


@query("quality_duplicate_classes", sql=f"""
  SELECT CASE WHEN nv <= 1 AND nt <= 1 AND np <= 1 THEN 'exact_copy' WHEN nv > 1 THEN 'numeric_differs'
    WHEN nt > 1 THEN 'numeric_same_category_differs' ELSE 'other' END AS kind, count(*) AS groups FROM (
    SELECT ts_hour, user_id, count(*) AS size, count(DISTINCT v) AS nv, count(DISTINCT event_type) AS nt, count(DISTINCT props) AS np
    FROM (SELECT *, floor(value / 50.0::DOUBLE) AS v FROM {KEYED}) GROUP BY 1, 2) WHERE size > 1 GROUP BY 1
""")
def quality_duplicate_classes(spark, sf):
    """QC-4: what differs inside duplicate groups (values compared in bands of 50)."""
    ev = keyed_events(spark, sf).withColumn("band", F.floor(F.col("value") / 50.0))
    return quality.duplicate_classes(ev, KEYS, ["band"], ["event_type"], ["props"])


@query("quality_duplicates_by_entity", sql=f"SELECT user_id, {SUMMARY} FROM {SIZES} GROUP BY 1", whole=SUMMARY_WHOLE, doubles=SUMMARY_RATES)
def quality_duplicates_by_entity(spark, sf):
    """QC-5: the duplicate table per entity."""
    return quality.duplicate_summary(keyed_events(spark, sf), KEYS, ["user_id"])


RULES_SQL = "('quantity > 45', l_quantity > 45), ('quantity <= 1', l_quantity <= 1), ('discount > 0.09', l_discount > 0.09::DOUBLE), ('tax == 0', l_tax = 0)"


@query("quality_outlier_rules", sql=f"""
  SELECT *, sum(entity_count) OVER (PARTITION BY rule) AS rule_count,
    sum(entity_count) OVER (PARTITION BY rule) * 100.0::DOUBLE / sum(n) OVER (PARTITION BY rule) AS rule_rate_pct,
    min(f) OVER (PARTITION BY rule) AS first_ts, max(l) OVER (PARTITION BY rule) AS last_ts
  FROM (SELECT r.rule, l_returnflag, count(*) FILTER (WHERE hit) AS entity_count, count(*) AS n,
    min(l_shipdate) FILTER (WHERE hit) AS f, max(l_shipdate) FILTER (WHERE hit) AS l
    FROM lineitem, LATERAL (VALUES {RULES_SQL}) r(rule, hit) GROUP BY 1, 2)
""".replace("SELECT *, sum", "SELECT rule, l_returnflag, entity_count, sum", 1),
       whole=["rule_count"], doubles=["rule_rate_pct"], stamps=["first_ts", "last_ts"])
def quality_outlier_rules(spark, sf):
    """QC-6: rule-based outlier report; nothing is removed."""
    li = views.table(spark, sf, "lineitem")
    rules = {
        "quantity > 45": F.col("l_quantity") > 45,
        "quantity <= 1": F.col("l_quantity") <= 1,
        "discount > 0.09": F.col("l_discount") > 0.09,
        "tax == 0": F.col("l_tax") == 0,
    }
    return quality.rule_report(li, rules, "l_returnflag", "l_shipdate")


WIDE_SQL = "SELECT ts, " + ", ".join(f"max(y) FILTER (WHERE series_id = '{e}') AS y_{e}" for e in views.ENTITIES) + " FROM panel GROUP BY 1"
WIDE = [f"y_{e}" for e in views.ENTITIES]


def wide_panel(spark, sf):
    from panelcast.operators.clean import pivot_entities

    return pivot_entities(views.panel(spark, sf), ["ts"], "series_id", views.ENTITIES, ["y"])


@query("quality_missing_pattern", ["panel"], sql=f"""
  SELECT count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in WIDE)}) AS rows_any_missing,
    count(*) FILTER (WHERE y_click IS NULL AND y_error IS NULL) AS rows_group_missing,
    {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}' for c in WIDE)} FROM ({WIDE_SQL})
""")
def quality_missing_pattern(spark, sf):
    """QC-7: rows with any and with all of a column group missing."""
    return quality.missing_pattern(wide_panel(spark, sf), WIDE, ["y_click", "y_error"])


@query("quality_final_checks", ["panel"], sql="""
  SELECT series_id, u.check_name, u.ok, u.detail FROM (
    SELECT series_id, count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS miss, min(y) AS lo, max(y) AS hi,
      avg(CASE WHEN total IS NOT NULL AND n IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate,
      count(*) FILTER (WHERE isinf(y) OR isinf(total)) AS inf FROM panel GROUP BY 1) q,
  LATERAL (VALUES ('row_count', n > 0, n::DOUBLE), ('duplicate_timestamp', true, 0), ('missing_timestamp', true, 0), ('monotonic_timestamp', true, 0),
    ('target_missing_count', miss = 0, miss), ('target_min', true, lo), ('target_max', true, hi), ('side_match_rate', rate = 1, rate),
    ('infinite_values', inf = 0, inf), ('duplicate_rows', true, 0)) u(check_name, ok, detail)
""", doubles=["detail"], places=8)
def quality_final_checks(spark, sf):
    """QC-8: check table of a finished panel."""
    return quality.final_checks(views.panel(spark, sf), HOURLY, "y", ["y", "total"], ["total", "n"])


DAMAGED = """(SELECT series_id, ts, y, total, n FROM panel WHERE pos % 97 <> 5 UNION ALL SELECT series_id, ts, y, total, n FROM panel WHERE pos % 89 = 7 AND pos % 97 <> 5
    UNION ALL SELECT series_id, ts, y, total + 1, n FROM panel WHERE pos % 83 = 11 AND pos % 97 <> 5)"""


@query("quality_final_checks_faults", ["panel"], sql=f"""
  WITH d AS {DAMAGED}, copies AS (SELECT series_id, sum(c - 1) AS copies FROM (SELECT series_id, count(*) AS c FROM d GROUP BY series_id, ts, y, total, n) GROUP BY 1),
    uq AS (SELECT series_id, ts, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM (SELECT DISTINCT series_id, ts FROM d)),
    steps AS (SELECT series_id, count(*) AS uq, date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS gone, count(*) FILTER (WHERE gap <> INTERVAL 1 HOUR) AS bad FROM uq GROUP BY 1)
  SELECT series_id, u.check_name, u.ok, u.detail FROM (
    SELECT q.*, copies, q.n - uq AS dup, gone, bad FROM (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS miss, min(y) AS lo, max(y) AS hi,
      avg(CASE WHEN total IS NOT NULL AND n IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate,
      count(*) FILTER (WHERE isinf(y) OR isinf(total)) AS inf FROM d GROUP BY 1) q JOIN copies USING (series_id) JOIN steps USING (series_id)),
  LATERAL (VALUES ('row_count', n > 0, n::DOUBLE), ('duplicate_timestamp', dup = 0, dup), ('missing_timestamp', gone = 0, gone), ('monotonic_timestamp', bad = 0, bad),
    ('target_missing_count', miss = 0, miss), ('target_min', true, lo), ('target_max', true, hi), ('side_match_rate', rate = 1, rate),
    ('infinite_values', inf = 0, inf), ('duplicate_rows', copies = 0, copies)) u(check_name, ok, detail)
""", doubles=["detail"], places=8)
def quality_final_checks_faults(spark, sf):
    """QC-8 on a damaged panel: lost steps, exact copies and second rows of a step, so that the checks fail."""
    rows = views.panel(spark, sf).where("pos % 97 <> 5").select("series_id", "ts", "y", "total", "n", "pos")
    rows = rows.unionByName(rows.where("pos % 89 = 7")).unionByName(rows.where("pos % 83 = 11").withColumn("total", F.col("total") + 1))
    return quality.final_checks(rows.drop("pos"), HOURLY, "y", ["y", "total"], ["total", "n"])


@query("quality_match_rate", ["panel"], sql="""
  SELECT series_id, avg(CASE WHEN y IS NOT NULL AND total IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS match_rate FROM panel GROUP BY 1
""", doubles=["match_rate"], places=8)
def quality_match_rate(spark, sf):
    """QC-9: share of grid rows the side table reached."""
    return quality.match_rate(views.panel(spark, sf), ["y", "total"], ["series_id"])


@query("quality_column_profile", sql=" UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct,
    count(DISTINCT {c}) AS nunique, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS nunique_with_null,
    min({c}) AS min, max({c}) AS max, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std FROM lineitem""" for c in LINE_NUMBERS),
       doubles=["null_pct", "min", "max", "mean", "median", "std"], whole=["nunique_with_null"],
       digits={"mean": 7})
def quality_column_profile(spark, sf):
    """QC-10: column profile with exact median and distinct count."""
    return quality.profile(views.table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("quality_target_stats", ["splits"], sql="""
  SELECT series_id, split, count(y) AS count, count(*) - count(y) AS nulls, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max,
    quantile_cont(y, 0.5) AS median FROM splits GROUP BY 1, 2
""", doubles=["mean", "std", "min", "max", "median"])
def quality_target_stats(spark, sf):
    """QC-11: target statistics per split."""
    return quality.target_stats(chronological_split(views.scored(spark, sf)), ["series_id", "split"], "y")


NULL_SQL = """SELECT split, rows_with_null, null_pct, u.feature, u.null_cells FROM (
  SELECT split, count(*) FILTER (WHERE y IS NULL OR total IS NULL OR n IS NULL) AS rows_with_null,
    (count(*) * 3 - count(y) - count(total) - count(n)) * 100.0::DOUBLE / (count(*) * 3) AS null_pct,
    count(*) - count(y) AS a, count(*) - count(total) AS b, count(*) - count(n) AS c
  FROM (SELECT *, CASE WHEN pos < floor(n_steps * 0.70::DOUBLE) THEN 'train' WHEN pos < floor(n_steps * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM panel)
  GROUP BY 1) q, LATERAL (VALUES ('y', a), ('total', b), ('n', c)) u(feature, null_cells)"""


@query("quality_null_audit", ["panel"], sql=NULL_SQL, doubles=["null_pct"], places=8)
def quality_null_audit(spark, sf):
    """QC-12: missing cells per split and feature."""
    return quality.null_audit(chronological_split(views.panel(spark, sf)), ["split"], ["y", "total", "n"])


@query("quality_key_overlap", ["panel", "cells"], sql="""
  SELECT series_id, count(*) FILTER (WHERE l AND r) AS in_both, count(*) FILTER (WHERE l AND r IS NULL) AS only_left,
    count(*) FILTER (WHERE l IS NULL AND r) AS only_right FROM (
    SELECT coalesce(a.series_id, b.series_id) AS series_id, a.l, b.r FROM (SELECT series_id, ts, true AS l FROM panel) a
    FULL OUTER JOIN (SELECT series_id, ts, true AS r FROM cells) b ON a.series_id = b.series_id AND a.ts = b.ts) GROUP BY 1
""")
def quality_key_overlap(spark, sf):
    """QC-13: key sets of grid and cells."""
    return quality.key_overlap(views.panel(spark, sf), views.cells(spark, sf), ["series_id", "ts"], ["series_id"])


@query("quality_fingerprint")
def quality_fingerprint(spark, sf):
    """QC-14: order-free content fingerprint of a protected table."""
    return quality.fingerprint(views.table(spark, sf, "orders"))


@query("quality_infinities", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE isinf(1.0::DOUBLE / {c}) OR {c} = 0) AS infinite FROM lineitem" for c in ["l_discount", "l_tax"]))
def quality_infinities(spark, sf):
    """QC-16: infinite cells, here reciprocals of zero rates."""
    li = views.table(spark, sf, "lineitem")
    inverse = lambda c: F.when(F.col(c) == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.col(c))
    return quality.infinity_counts(li.select(*[inverse(c).alias(c) for c in ["l_discount", "l_tax"]]), ["l_discount", "l_tax"])
