"""Metrics, slices, selection and shift reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import HOURLY
from panelcast.functions.quantiles import quantiles
from panelcast.functions.timefn import civil
from panelcast.operators import evaluate
from panelcast.operators.features import History
from panelcast.operators.splits import chronological_split
from panelcast.plans import views
from panelcast.plans.registry import query
from panelcast.sources.staging import stage

LOCAL = "timezone('Europe/Madrid', timezone('UTC', ts))"
METRICS = ["mae", "rmse", "r2", "smape", "bias", "residual_std"]
METRIC_SQL = """count(pred - y) AS n, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse,
    1 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)) AS r2,
    100 * avg(CASE WHEN abs(y) + abs(pred) > 0 THEN 2 * abs(pred - y) / (abs(y) + abs(pred)) END) AS smape,
    avg(pred - y) AS bias, stddev_pop(pred - y) AS residual_std"""
VALIDATION = "(SELECT * FROM folds WHERE role = 'validation')"
views.CTES["models"] = f"""models AS (SELECT series_id, fold, ts, y, 'mean_lags' AS model, pred FROM {VALIDATION} UNION ALL
  SELECT series_id, fold, ts, y, 'naive', naive FROM {VALIDATION} UNION ALL SELECT series_id, fold, ts, y, 'last', lag_1d FROM {VALIDATION})"""
views.CTES["fold_metrics"] = f"fold_metrics AS (SELECT series_id, model, fold, {METRIC_SQL} FROM models GROUP BY 1, 2, 3)"
views.CTES["summary"] = """summary AS (SELECT series_id, model, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae, avg(rmse) AS mean_rmse, avg(r2) AS mean_r2,
  avg(smape) AS mean_smape, avg(bias) AS mean_bias, abs(avg(bias)) AS abs_mean_bias, count(*) AS n_folds FROM fold_metrics GROUP BY 1, 2)"""
views.DEPENDS.update({"models": ["folds"], "fold_metrics": ["models"], "summary": ["fold_metrics"]})
SUMMARY = ["mean_mae", "std_mae", "mean_rmse", "mean_r2", "mean_smape", "mean_bias", "abs_mean_bias"]


def validation(spark, sf):
    return views.folds(spark, sf).where(F.col("role") == "validation")


def candidates(spark, sf):
    """Three simple forecasts on the same validation rows, long."""
    names = {"mean_lags": "pred", "naive": "naive", "last": "lag_1d"}
    options = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in names.items()])
    return validation(spark, sf).select("series_id", "fold", "ts", "y", F.inline(options))


def summary(spark, sf, ddof=0):
    return evaluate.summarise_folds(evaluate.metrics(candidates(spark, sf), ["series_id", "model", "fold"]), ["series_id", "model"], ddof)


@query("naive_error_by_hour", ["panel"], sql=f"""
  SELECT hour({LOCAL}) AS hour, count(*) AS n, avg(abs(pred - y)) AS mae, avg(pred - y) AS bias
  FROM (SELECT ts, y, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS pred FROM panel) WHERE pred IS NOT NULL AND y IS NOT NULL GROUP BY 1
""", doubles=["mae", "bias"], whole=["hour"])
def naive_error_by_hour(spark, sf):
    """MD-1 with EV-6: flagship, 24-hour naive forecast scored by local hour."""
    p = History(HOURLY).lag("y", 24, "pred").apply(views.panel(spark, sf)).where(F.col("pred").isNotNull() & F.col("y").isNotNull())
    r = F.col("pred") - F.col("y")
    return p.groupBy(F.hour(civil(F.col("ts"))).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"))


@query("eval_metrics", ["folds"], sql=f"SELECT series_id, fold, {METRIC_SQL} FROM {VALIDATION} GROUP BY 1, 2", doubles=METRICS, whole=["fold"])
def eval_metrics(spark, sf):
    """EV-1: all metrics per fold in one pass."""
    return evaluate.metrics(validation(spark, sf), views.FOLD)


@query("eval_smape_policies", ["folds"], sql=f"""
  SELECT series_id, fold, 100 * avg(CASE WHEN abs(y) + abs(naive) > 0 THEN 2 * abs(naive - y) / (abs(y) + abs(naive)) END) AS excluded,
    100 * avg(CASE WHEN abs(y) + abs(naive) > 0 THEN 2 * abs(naive - y) / (abs(y) + abs(naive)) ELSE 0 END) AS as_zero FROM {VALIDATION} GROUP BY 1, 2
""", doubles=["excluded", "as_zero"], whole=["fold"])
def eval_smape_policies(spark, sf):
    """EV-2: both treatments of rows where actual and prediction are zero."""
    y, p = F.col("y"), F.col("naive")
    return validation(spark, sf).groupBy(*views.FOLD).agg(
        evaluate.smape(y, p).alias("excluded"), evaluate.smape(y, p, "zero").alias("as_zero")
    )


@query("eval_fold_metrics", ["fold_metrics"], sql="SELECT * FROM fold_metrics", doubles=METRICS, whole=["fold"])
def eval_fold_metrics(spark, sf):
    """EV-3: metrics per model and fold."""
    return evaluate.metrics(candidates(spark, sf), ["series_id", "model", "fold"])


@query("eval_fold_summary", ["summary"], sql="SELECT * FROM summary", doubles=SUMMARY)
def eval_fold_summary(spark, sf):
    """EV-3: mean and population deviation over folds."""
    return summary(spark, sf)


@query("eval_fold_summary_sample", ["fold_metrics"], sql="""
  SELECT series_id, model, avg(mae) AS mean_mae, stddev_samp(mae) AS std_mae, count(*) AS n_folds FROM fold_metrics GROUP BY 1, 2
""", doubles=["mean_mae", "std_mae"])
def eval_fold_summary_sample(spark, sf):
    """EV-3: the same with the sample deviation of the tree stages."""
    return summary(spark, sf, ddof=1).select("series_id", "model", "mean_mae", "std_mae", "n_folds")


@query("eval_select_best", ["summary"], sql="""
  SELECT series_id, model AS selected, mean_mae FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_mae, std_mae, abs_mean_bias, model) AS r FROM summary) WHERE r = 1
""", doubles=["mean_mae"])
def eval_select_best(spark, sf):
    """EV-4: lexicographic selection."""
    return evaluate.select_best(summary(spark, sf), "model", ["series_id"])


@query("eval_select_or_keep", ["summary"], sql="""
  SELECT b.series_id, CASE WHEN b.model = 'mean_lags' OR k.mean_mae - b.mean_mae < 0.01 THEN 'mean_lags' ELSE b.model END AS selected, b.model AS best, k.mean_mae - b.mean_mae AS gain
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_mae, std_mae, abs_mean_bias, model) AS r FROM summary) b
  JOIN summary k ON k.series_id = b.series_id AND k.model = 'mean_lags' WHERE r = 1
""", doubles=["gain"])
def eval_select_or_keep(spark, sf):
    """EV-5: keep the baseline unless the gain is large enough."""
    return evaluate.select_or_keep(summary(spark, sf), "model", "mean_lags", ["series_id"])


FIELDS = {"weekday": "isodow(ts) - 1", "month": "month(ts)", "quarter": "quarter(ts)"}


@query("eval_error_by_calendar", ["folds"], sql=" UNION ALL ".join(
    f"SELECT series_id, '{n}' AS field, {e} AS bucket, avg(abs(pred - y)) AS mae, count(*) AS n FROM {VALIDATION} GROUP BY 1, 3" for n, e in FIELDS.items()),
       doubles=["mae"], whole=["bucket"])
def eval_error_by_calendar(spark, sf):
    """EV-6: error by calendar fields in one grouping-sets pass."""
    fields = {"weekday": F.weekday("ts"), "month": F.month("ts"), "quarter": F.quarter("ts")}
    return evaluate.error_by(validation(spark, sf), fields, by=["series_id"])


SLICES = ["mae", "bias", "residual_std", "y_mean"]
SLICE_SQL = """CASE WHEN v.y <= q1 THEN 'P25_below' WHEN v.y <= q2 THEN 'P25_P50' WHEN v.y <= q3 THEN 'P50_P75' ELSE 'P75_above' END AS level,
    avg(abs(pred - y)) AS mae, avg(pred - y) AS bias, stddev_pop(pred - y) AS residual_std, avg(y) AS y_mean, count(*) AS n"""


@query("eval_error_by_level", ["folds"], sql=f"""
  SELECT v.series_id, v.fold, {SLICE_SQL} FROM {VALIDATION} v JOIN (SELECT series_id, fold, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3
    FROM folds WHERE role = 'train' GROUP BY 1, 2) e ON e.series_id = v.series_id AND e.fold = v.fold GROUP BY 1, 2, 3
""", doubles=SLICES, whole=["fold"])
def eval_error_by_level(spark, sf):
    """EV-7: error per level slice with train edges."""
    f = stage(views.folds(spark, sf))  # read three times
    edges = quantiles(f.where(F.col("role") == "train"), views.FOLD, "y", [0.25, 0.5, 0.75])
    return evaluate.error_by_level(f.where(F.col("role") == "validation"), edges, views.FOLD)


@query("eval_error_by_quartile", ["folds"], sql=f"""
  SELECT v.series_id, {SLICE_SQL} FROM {VALIDATION} v JOIN (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3
    FROM {VALIDATION} GROUP BY 1) e ON e.series_id = v.series_id GROUP BY 1, 2
""", doubles=SLICES)
def eval_error_by_quartile(spark, sf):
    """EV-8: error per quartile of the pooled actuals."""
    return evaluate.error_by_quartile(validation(spark, sf), ["series_id"])


REGIME = ["mae", "rmse", "bias", "y_mean", "pred_mean", "threshold"]
PROBS = {"P50+": 0.5, "P75+": 0.75, "P90+": 0.9, "P95+": 0.95}
EDGE_SQL = ", ".join(f"quantile_cont(y, {p}) AS t{i}" for i, p in enumerate(PROBS.values()))
REGIME_AGG = "count(*) AS n, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(pred - y) AS bias, avg(y) AS y_mean, avg(pred) AS pred_mean"


@query("eval_regimes_pooled", ["splits"], sql=" UNION ALL ".join(f"""
  SELECT s.series_id, '{n}' AS regime, {REGIME_AGG}, max(t{i}) AS threshold FROM splits s
  JOIN (SELECT series_id, {EDGE_SQL} FROM splits WHERE split <> 'test' GROUP BY 1) e ON e.series_id = s.series_id AND s.y >= t{i} WHERE split = 'test' GROUP BY 1""" for i, n in enumerate(PROBS)),
       doubles=REGIME)
def eval_regimes_pooled(spark, sf):
    """EV-9: test metrics at or above development thresholds."""
    s = stage(chronological_split(views.scored(spark, sf)))  # read three times
    thresholds = quantiles(s.where(F.col("split") != "test"), ["series_id"], "y", list(PROBS.values()))
    return evaluate.regime_metrics(s.where(F.col("split") == "test"), thresholds, ["series_id"], list(PROBS.values()))


@query("eval_regimes_by_fold", ["folds"], sql=" UNION ALL ".join(f"""
  SELECT s.series_id, s.fold, '{n}' AS regime, {REGIME_AGG}, {'NULL::DOUBLE' if i is None else f'max(t{i})'} AS threshold FROM {VALIDATION} s
  JOIN (SELECT series_id, fold, {EDGE_SQL} FROM folds WHERE role = 'train' GROUP BY 1, 2) e ON e.series_id = s.series_id AND e.fold = s.fold {'' if i is None else f'AND s.y >= t{i}'} GROUP BY 1, 2"""
    for i, n in [*enumerate(PROBS), (None, "ALL")]), doubles=REGIME, whole=["fold"])
def eval_regimes_by_fold(spark, sf):
    """EV-10: regimes per fold with thresholds of the fold's own train rows."""
    f = stage(views.folds(spark, sf))  # read three times
    thresholds = quantiles(f.where(F.col("role") == "train"), views.FOLD, "y", list(PROBS.values()))
    return evaluate.regime_metrics(f.where(F.col("role") == "validation"), thresholds, views.FOLD, list(PROBS.values()), with_all=True)


DRIVERS = ["y", "pred", "lag_7d", "orders"]
PLACES = {"train": "role = 'train'", "val": "role = 'validation'", "val_high": "role = 'validation' AND y >= t", "val_rest": "role = 'validation' AND y < t"}


@query("eval_association", ["folds"], sql=f"""
  SELECT f.series_id, f.fold, {', '.join(f'avg({d}) FILTER (WHERE {w}) AS {p}_{d}' for d in DRIVERS for p, w in PLACES.items())},
    count(*) FILTER (WHERE role = 'validation' AND y >= t) AS val_high_n FROM folds f
  JOIN (SELECT series_id, fold, quantile_cont(y, 0.75) AS t FROM folds WHERE role = 'train' GROUP BY 1, 2) e ON e.series_id = f.series_id AND e.fold = f.fold GROUP BY 1, 2
""", doubles=[f"{p}_{d}" for d in DRIVERS for p in PLACES], whole=["fold"])
def eval_association(spark, sf):
    """EV-11: driver means in train, validation, high and remaining rows."""
    f = stage(views.folds(spark, sf))  # read three times
    thresholds = quantiles(f.where(F.col("role") == "train"), views.FOLD, "y", [0.75])
    return evaluate.association(f, thresholds, views.FOLD, DRIVERS)


SHIFT = ["train_mean", "train_std", "other_mean", "other_std", "shift"]


def _shift_sql(source: str, by: str, column: str, role: str, base: str, other: str, std: str) -> str:
    return f"""SELECT {by}, '{column}' AS feature, avg({column}) FILTER (WHERE {role} = '{base}') AS train_mean, {std}({column}) FILTER (WHERE {role} = '{base}') AS train_std,
    avg({column}) FILTER (WHERE {role} = '{other}') AS other_mean, {std}({column}) FILTER (WHERE {role} = '{other}') AS other_std FROM {source} GROUP BY {by}"""


def _flagged(parts: list[str]) -> str:
    return f"""SELECT *, coalesce(shift >= 0.5, false) AS flag FROM (SELECT *, CASE WHEN train_std > 0 THEN abs(other_mean - train_mean) / train_std END AS shift FROM ({' UNION ALL '.join(parts)}))"""


@query("eval_distribution_shift", ["folds"], sql=_flagged([_shift_sql("folds", "series_id, fold", c, "role", "train", "validation", "stddev_pop") for c in DRIVERS]),
       doubles=SHIFT, whole=["fold"])
def eval_distribution_shift(spark, sf):
    """EV-12: mean shift in units of the train deviation."""
    return evaluate.distribution_shift(views.folds(spark, sf), views.FOLD, DRIVERS)


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
AUDIT = ["mean", "std", "min", "max"]


@query("eval_distribution_audit", sql=" UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY 1" for c in LINES),
       doubles=AUDIT, digits={"mean": 7})
def eval_distribution_audit(spark, sf):
    """EV-13: feature distributions per group."""
    return evaluate.distribution_audit(views.table(spark, sf, "lineitem"), ["l_returnflag"], LINES)


@query("eval_distribution_shift_sample", sql=_flagged([_shift_sql("lineitem", "l_linestatus", c, "l_returnflag", "A", "R", "stddev_samp") for c in LINES]),
       doubles=SHIFT, digits={"train_mean": 7, "other_mean": 7})
def eval_distribution_shift_sample(spark, sf):
    """EV-13: the shift list with the sample deviation."""
    return evaluate.distribution_shift(views.table(spark, sf, "lineitem"), ["l_linestatus"], LINES, "l_returnflag", "A", "R", ddof=1)


@query("eval_residual_histogram", ["folds"], sql=f"""
  SELECT series_id, least(CASE WHEN hi > lo THEN floor((r - lo) / ((hi - lo) / 40)) ELSE 0 END, 39) AS bin, max(lo) + least(CASE WHEN hi > lo THEN floor((r - lo) / ((hi - lo) / 40)) ELSE 0 END, 39) * max((hi - lo) / 40) AS left_edge, count(*) AS n
  FROM (SELECT series_id, pred - y AS r, min(pred - y) OVER (PARTITION BY series_id) AS lo, max(pred - y) OVER (PARTITION BY series_id) AS hi FROM {VALIDATION}) GROUP BY 1, 2
""", doubles=["left_edge"], whole=["bin"])
def eval_residual_histogram(spark, sf):
    """EV-14: 40-bin residual histogram."""
    return evaluate.residual_histogram(validation(spark, sf), ["series_id"])


@query("eval_versus_naive", ["folds"], sql=f"""
  SELECT *, model_mae < naive_mae AS beats_naive, (naive_mae - model_mae) * 100 / naive_mae AS reduction_pct FROM (
    SELECT series_id, fold, avg(abs(pred - y)) AS model_mae, avg(abs(naive - y)) AS naive_mae FROM {VALIDATION} GROUP BY 1, 2)
""", doubles=["model_mae", "naive_mae", "reduction_pct"], whole=["fold"])
def eval_versus_naive(spark, sf):
    """EV-15: model against naive on the same rows."""
    return evaluate.versus_naive(validation(spark, sf), views.FOLD)


@query("eval_peer_table", ["summary"], sql="""
  SELECT series_id, model, mean_mae, std_mae, 'this_run' AS source FROM summary WHERE model = 'mean_lags' UNION ALL
  SELECT series_id, model, mean_mae, NULL::DOUBLE, 'stored_baselines' FROM summary WHERE model <> 'mean_lags'
""", doubles=["mean_mae", "std_mae"])
def eval_peer_table(spark, sf):
    """EV-16: current and stored results in one table."""
    s = summary(spark, sf).select("series_id", "model", "mean_mae", "std_mae")
    return evaluate.peer_table(
        s.where(F.col("model") == "mean_lags"), {"stored_baselines": s.where(F.col("model") != "mean_lags").drop("std_mae")}
    )


@query("eval_phase_deltas", ["splits"], sql=" UNION ALL ".join(f"""
  SELECT series_id, '{c}' AS feature, avg({c}) FILTER (WHERE split <> 'test') AS first_mean, avg({c}) FILTER (WHERE split = 'test') AS second_mean,
    avg({c}) FILTER (WHERE split = 'test') - avg({c}) FILTER (WHERE split <> 'test') AS delta FROM splits GROUP BY 1""" for c in DRIVERS),
       doubles=["first_mean", "second_mean", "delta"])
def eval_phase_deltas(spark, sf):
    """EV-19: development against test means."""
    s = chronological_split(views.scored(spark, sf))
    s = s.withColumn("phase", F.when(F.col("split") == "test", "test").otherwise("development"))
    return evaluate.phase_deltas(s, ["series_id"], "phase", "development", "test", DRIVERS)
