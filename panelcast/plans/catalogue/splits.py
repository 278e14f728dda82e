"""Chronological splits, folds and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY
from panelcast.operators import prep, splits
from panelcast.plans import views
from panelcast.plans.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("split_chronological", ["splits"], sql="SELECT series_id, ts, y, split FROM splits", doubles=["y"], stamps=["ts"])
def split_chronological(spark, sf):
    """SP-1: 70 / 15 / 15 split by position in time."""
    return splits.chronological_split(views.scored(spark, sf)).select("series_id", "ts", "y", "split")


@query("split_summary", ["splits"], sql="""
  SELECT series_id, split, count(*) AS rows, count(*) * 100.0::DOUBLE / max(n_steps) AS percentage, min(ts) AS start_ts, max(ts) AS end_ts,
    date_diff('day', min(ts), max(ts)) AS duration_steps FROM splits GROUP BY 1, 2
""", doubles=["percentage"], stamps=["start_ts", "end_ts"])
def split_summary(spark, sf):
    """SP-2: rows, share and time range per split."""
    return splits.split_summary(splits.chronological_split(views.scored(spark, sf)), DAILY)


@query("split_overlap_proof", ["splits"], sql="""
  SELECT series_id, max(ts) FILTER (WHERE split = 'train') AS max_train, max(ts) FILTER (WHERE split = 'validation') AS max_validation,
    min(ts) FILTER (WHERE split = 'validation') AS min_validation, min(ts) FILTER (WHERE split = 'test') AS min_test,
    max(ts) FILTER (WHERE split = 'train') < min(ts) FILTER (WHERE split = 'validation')
      AND max(ts) FILTER (WHERE split = 'validation') < min(ts) FILTER (WHERE split = 'test') AS ordered,
    count(*) - count(DISTINCT ts) AS multi_assigned FROM splits GROUP BY 1
""", stamps=["max_train", "max_validation", "min_validation", "min_test"])
def split_overlap_proof(spark, sf):
    """SP-3: boundaries ordered, each key in one split."""
    return splits.overlap_proof(splits.chronological_split(views.scored(spark, sf)), DAILY)


@query("split_expanding_folds", ["folds"], sql="""
  SELECT series_id, fold, role, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM folds GROUP BY 1, 2, 3
""", stamps=["start_ts", "end_ts"], whole=["fold"])
def split_expanding_folds(spark, sf):
    """SP-4: expanding folds."""
    return splits.fold_summary(views.folds(spark, sf), DAILY)


@query("split_fold_checks", ["folds"], sql="""
  SELECT series_id, fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'validation') AS n_val,
    max(ts) FILTER (WHERE role = 'train') < min(ts) FILTER (WHERE role = 'validation') AS ordered FROM folds GROUP BY 1, 2
""", whole=["fold"])
def split_fold_checks(spark, sf):
    """SP-4: folds are ordered and not empty."""
    return splits.fold_checks(views.folds(spark, sf), DAILY)


@query("split_inner_tail", ["folds"], sql="""
  SELECT series_id, fold, CASE WHEN pos < greatest(floor(cut * 0.8::DOUBLE), 24) THEN 'fit' ELSE 'stop' END AS inner_role, count(*) AS rows,
    min(ts) AS start_ts, max(ts) AS end_ts FROM folds WHERE role = 'train' GROUP BY 1, 2, 3
""", stamps=["start_ts", "end_ts"], whole=["fold"])
def split_inner_tail(spark, sf):
    """SP-5: chronological tail inside each train block."""
    train = views.folds(spark, sf).where(F.col("role") == "train")
    tail = splits.inner_tail(train, F.col("cut"))
    return tail.groupBy("series_id", "fold", "inner_role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


@query("split_inner_folds", ["splits"], sql="""
  SELECT series_id, fold, role, count(*) AS rows, max(ts) AS end_ts FROM (
    SELECT *, CASE WHEN pos < floor(m * lo) THEN 'train' WHEN pos < floor(m * hi) THEN 'validation' END AS role
    FROM (SELECT *, floor(n_steps * 0.70::DOUBLE) AS m FROM splits WHERE split = 'train'),
      (VALUES (1, 0.5::DOUBLE, 0.65::DOUBLE), (2, 0.65::DOUBLE, 0.8::DOUBLE), (3, 0.8::DOUBLE, 1.0::DOUBLE)) c(fold, lo, hi)) WHERE role IS NOT NULL GROUP BY 1, 2, 3
""", stamps=["end_ts"], whole=["fold"])
def split_inner_folds(spark, sf):
    """SP-6: inner expanding folds of a train block."""
    train = splits.chronological_split(views.scored(spark, sf)).where(F.col("split") == "train")
    length = splits.cut_at(F.col("n_steps"), splits.TRAIN_FRACTION)
    inner = splits.expanding_folds(train, splits.INNER_FOLD_CUTS, length)
    return inner.groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("end_ts"))


@query("split_development", ["splits"], sql="""
  SELECT series_id, count(*) AS rows, max(ts) AS end_ts, sum(y) AS y FROM splits WHERE split <> 'test' GROUP BY 1
""", stamps=["end_ts"], doubles=["y"], digits={"y": 5})
def split_development(spark, sf):
    """SP-7: development rows precede the locked split."""
    dev = splits.development(splits.chronological_split(views.scored(spark, sf)))
    return dev.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("end_ts"), F.sum("y").alias("y"))


MASKED = "(SELECT l_returnflag, l_linenumber, l_linestatus, " + ", ".join(f"CASE WHEN l_linenumber <> {i + 2} THEN {c} END AS {c}" for i, c in enumerate(NUMBERS)) + " FROM lineitem)"
STATS_SQL = " UNION ALL ".join(f"""
  SELECT l_returnflag, '{c}' AS feature, max(med) AS median, avg(coalesce({c}, med)) AS mean, CASE WHEN stddev_pop(coalesce({c}, med)) > 0 THEN stddev_pop(coalesce({c}, med)) ELSE 1 END AS scale
  FROM (SELECT *, quantile_cont({c}, 0.5) OVER (PARTITION BY l_returnflag) AS med FROM {MASKED}) GROUP BY 1""" for c in NUMBERS)


def masked_lines(spark, sf):
    """Line items where each measure is missing on one line number."""
    li = views.table(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linenumber", "l_linestatus", *[
        F.when(F.col("l_linenumber") != i + 2, F.col(c)).alias(c) for i, c in enumerate(NUMBERS)
    ])


@query("prep_fit_statistics", sql=STATS_SQL, doubles=["median", "mean", "scale"])
def prep_fit_statistics(spark, sf):
    """PP-1 and PP-2: train medians, and mean and deviation after imputing."""
    return prep.fit_scaler_long(masked_lines(spark, sf), ["l_returnflag"], NUMBERS)


PREP_SQL = f"""SELECT l_returnflag, l_linenumber, l_linestatus, {{0}} FROM (SELECT *, {', '.join(f"quantile_cont({c}, 0.5) OVER (PARTITION BY l_returnflag) AS med_{c}" for c in NUMBERS)} FROM {MASKED})"""


@query("prep_impute_only", sql="SELECT l_returnflag, l_linenumber, count(*) AS n, "
       + ", ".join(f"sum({c}) AS {c}" for c in NUMBERS) + " FROM ("
       + PREP_SQL.format(", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in NUMBERS)) + ") GROUP BY 1, 2",
       doubles=NUMBERS, whole=["l_linenumber"], digits=dict.fromkeys(NUMBERS, 3))
def prep_impute_only(spark, sf):
    """PP-3: median imputation without scaling."""
    rows = masked_lines(spark, sf)
    scaler = prep.fit_scaler(rows, ["l_returnflag"], NUMBERS)
    out = prep.transform(rows, scaler, ["l_returnflag"], NUMBERS, scale=False)
    return out.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in NUMBERS])


STD = [f"({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g AS {c}" for c in NUMBERS]


@query("prep_standardise", sql="SELECT l_returnflag, l_linestatus, "
       + ", ".join(f"avg({c}) AS mean_{c}, max({c}) AS max_{c}" for c in NUMBERS) + f" FROM (SELECT l_returnflag, l_linestatus, {', '.join(STD)} FROM ("
       + PREP_SQL.format(", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in NUMBERS)) + ") WINDOW g AS (PARTITION BY l_returnflag)) GROUP BY 1, 2",
       doubles=[f"{s}_{c}" for c in NUMBERS for s in ("mean", "max")])
def prep_standardise(spark, sf):
    """PP-2: standardised columns."""
    rows = masked_lines(spark, sf)
    out = prep.transform(rows, prep.fit_scaler(rows, ["l_returnflag"], NUMBERS), ["l_returnflag"], NUMBERS)
    return out.groupBy("l_returnflag", "l_linestatus").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in NUMBERS], *[F.max(c).alias(f"max_{c}") for c in NUMBERS]
    )


QUANTILES = {"q0_25": 0.25, "q0_5": 0.5, "q0_75": 0.75, "q0_9": 0.9, "q0_95": 0.95}


@query("prep_target_quantiles", ["folds"], sql=f"""
  SELECT series_id, fold, count(y) AS n, {', '.join(f'quantile_cont(y, {p}) AS {c}' for c, p in QUANTILES.items())} FROM folds WHERE role = 'train' GROUP BY 1, 2
""", doubles=list(QUANTILES), whole=["fold"])
def prep_target_quantiles(spark, sf):
    """PP-5: train quantiles per fold."""
    return prep.target_quantiles(views.folds(spark, sf).where(F.col("role") == "train"), views.FOLD)


@query("prep_global_quantiles", sql=f"""
  SELECT count(*) AS n, {', '.join(f'quantile_cont(l_extendedprice, {p}) AS {c}' for c, p in QUANTILES.items())} FROM lineitem
""", doubles=list(QUANTILES))
def prep_global_quantiles(spark, sf):
    """PP-5 over one group that holds every row."""
    return prep.target_quantiles(views.table(spark, sf, "lineitem"), [], "l_extendedprice")
