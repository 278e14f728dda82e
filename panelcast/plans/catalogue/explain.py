"""Explanations and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY, HOURLY
from panelcast.functions.quantiles import quantiles
from panelcast.operators import explain, forecast, linear, residual
from panelcast.operators.features import History, add_calendar
from panelcast.operators.grid import INDEX
from panelcast.operators.manifest import FeatureSpec, Manifest, availability_audit
from panelcast.plans import views
from panelcast.plans.catalogue.models import BASE, FLAG, X, fold_table, lines
from panelcast.plans.registry import query
from panelcast.sources.staging import stage

# A fixed linear model per return flag with the scaler of the data, so SQL can follow it.
WEIGHTS = {"l_quantity": 25.0, "l_discount": -0.5}
TERMS = {c: f"{w}::DOUBLE * (l.{c} - m{i}) / s{i}" for i, (c, w) in enumerate(WEIGHTS.items(), start=1)}
BOTH = " + ".join(TERMS.values())
SHAP_FROM = "FROM lineitem l JOIN moments m ON m.l_returnflag = l.l_returnflag"


def fixed_model(df, by):
    from panelcast.operators.prep import fit_scaler

    scaler = fit_scaler(df, FLAG, X)
    model = scaler.withColumn("coef", F.array(*[F.lit(w) for w in WEIGHTS.values()])).withColumn("intercept", F.lit(38.0))
    # staged, so that its measured size picks the join: three rows are broadcast, and no row of a flag is shuffled or sorted
    return stage(model)


@query("explain_contributions", ["moments"], sql=f"""
  SELECT l.l_returnflag, l.l_linestatus, {', '.join(f'min({t}) AS min_{c}, max({t}) AS max_{c}, sum(abs({t})) AS abs_{c}' for c, t in TERMS.items())} {SHAP_FROM} GROUP BY 1, 2
""", doubles=[f"{s}_{c}" for c in X for s in ("min", "max", "abs")], digits={f"abs_{c}": 3 for c in X})
def explain_contributions(spark, sf):
    """EX-1: exact contributions of a linear model."""
    df = lines(spark, sf)
    out = explain.contributions(df, fixed_model(df, FLAG), FLAG, X)
    aggs = [f(F.col(f"phi_{c}")).alias(f"{n}_{c}") for c in X for n, f in (("min", F.min), ("max", F.max), ("abs", lambda c: F.sum(F.abs(c))))]
    return out.groupBy("l_returnflag", "l_linestatus").agg(*aggs)


@query("explain_additivity", ["moments"], sql="SELECT l_returnflag, 0.0::DOUBLE AS max_gap, n FROM moments", doubles=["max_gap"])
def explain_additivity(spark, sf):
    """EX-2: contributions add up to the prediction."""
    df = lines(spark, sf)
    model = fixed_model(df, FLAG)
    return explain.additivity(linear.score(df, model, FLAG, X), model, FLAG, X)


@query("explain_importance", ["moments"], sql=" UNION ALL ".join(
    f"SELECT l.l_returnflag, '{c}' AS feature, {WEIGHTS[c]}::DOUBLE AS std_coef, avg(abs({t})) AS mean_abs_shap, avg({t}) AS mean_shap {SHAP_FROM} GROUP BY 1" for c, t in TERMS.items()),
       doubles=["std_coef", "mean_abs_shap", "mean_shap"])
def explain_importance(spark, sf):
    """EX-3: mean absolute and mean contribution."""
    df = lines(spark, sf)
    return explain.importance(df, fixed_model(df, FLAG), FLAG, X)


PER_FOLD = "per_fold AS (" + " UNION ALL ".join(
    f"SELECT l_linestatus AS fold, l.l_returnflag, '{c}' AS feature, {WEIGHTS[c]}::DOUBLE * CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS std_coef, avg(abs({t})) AS mean_abs_shap, avg({t}) AS mean_shap {SHAP_FROM} GROUP BY 1, 2"
    for c, t in TERMS.items()) + ")"
views.CTES["per_fold"] = PER_FOLD
views.DEPENDS["per_fold"] = ["moments"]


def per_fold(spark, sf):
    """Importance per (flag, status); the status plays the part of the fold and flips the sign."""
    df = lines(spark, sf)
    keys = ["l_linestatus", "l_returnflag"]
    joined = df.join(fixed_model(df, FLAG), FLAG)
    aggs = []
    terms = linear.linear_terms(X)
    for i, t in enumerate(terms):
        aggs += [F.first(F.col("coef")[i]).alias(f"std_coef__{i}"), F.avg(F.abs(t)).alias(f"mean_abs_shap__{i}"), F.avg(t).alias(f"mean_shap__{i}")]
    from panelcast.operators.quality import wide_to_long

    # the sign comes from the key after the aggregation: a first string inside it would sort all rows of a task
    out = wide_to_long(joined.groupBy(*keys).agg(*aggs), keys, "feature", X, ["std_coef", "mean_abs_shap", "mean_shap"])
    sign = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(-1.0)
    return out.withColumn("std_coef", F.col("std_coef") * sign).withColumnRenamed("l_linestatus", "fold")


@query("explain_cross_fold", ["per_fold"], sql="""
  SELECT *, CASE WHEN n_folds_pos > n_folds_neg THEN '+' WHEN n_folds_neg > n_folds_pos THEN '-' ELSE '0' END AS direction,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY mean_abs_shap DESC, mean_abs_std_coef DESC, feature) AS rank FROM (
    SELECT l_returnflag, feature, avg(mean_abs_shap) AS mean_abs_shap, stddev_pop(mean_abs_shap) AS std_abs_shap, avg(mean_shap) AS mean_shap, avg(std_coef) AS mean_std_coef,
      stddev_pop(std_coef) AS std_std_coef, avg(abs(std_coef)) AS mean_abs_std_coef, count(*) FILTER (WHERE std_coef > 0) AS n_folds_pos, count(*) FILTER (WHERE std_coef < 0) AS n_folds_neg
    FROM per_fold GROUP BY 1, 2)
""", doubles=["mean_abs_shap", "std_abs_shap", "mean_shap", "mean_std_coef", "std_std_coef", "mean_abs_std_coef"], whole=["rank"])
def explain_cross_fold(spark, sf):
    """EX-5: importance over folds with signs, direction and rank."""
    return explain.summarise_importance(per_fold(spark, sf), ["l_returnflag"])


@query("explain_groups", ["per_fold"], sql="""
  SELECT l_returnflag, feature_group, max(k) AS n_features, avg(s) AS mean_abs_shap_sum, coalesce(stddev_samp(s), 0) AS std_abs_shap_sum, avg(m) AS mean_abs_shap_mean FROM (
    SELECT l_returnflag, fold, feature_group, count(*) AS k, sum(mean_abs_shap) AS s, avg(mean_abs_shap) AS m FROM (
      SELECT *, CASE WHEN feature = 'l_quantity' THEN 'volume' ELSE 'price' END AS feature_group FROM per_fold) GROUP BY 1, 2, 3) GROUP BY 1, 2
""", doubles=["mean_abs_shap_sum", "std_abs_shap_sum", "mean_abs_shap_mean"])
def explain_groups(spark, sf):
    """EX-6: importance per feature group."""
    pf = per_fold(spark, sf)
    groups = spark.createDataFrame([("l_quantity", "volume"), ("l_discount", "price")], "feature string, feature_group string")
    return explain.group_importance(pf, groups, ["l_returnflag"])


@query("explain_high_level", ["moments"], sql=" UNION ALL ".join(f"""
  SELECT l.l_returnflag, '{c}' AS feature, avg({t}) FILTER (WHERE l_extendedprice >= t75) AS mean_shap_high, avg({t}) FILTER (WHERE l_extendedprice < t75) AS mean_shap_rest,
    avg({t}) FILTER (WHERE l_extendedprice >= t75) - avg({t}) FILTER (WHERE l_extendedprice < t75) AS delta {SHAP_FROM}
    JOIN (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.75) AS t75 FROM lineitem GROUP BY 1) q ON q.f = l.l_returnflag GROUP BY 1""" for c, t in TERMS.items()),
       doubles=["mean_shap_high", "mean_shap_rest", "delta"])
def explain_high_level(spark, sf):
    """EX-7: contributions in high rows minus the rest."""
    df = lines(spark, sf)
    t75 = quantiles(df, FLAG, "y", [0.75]).select(*FLAG, "q0_75")
    return explain.high_level_difference(df.join(t75, FLAG), fixed_model(df, FLAG), FLAG, X, F.col("y") >= F.col("q0_75"))


@query("explain_permutation")
def explain_permutation(spark, sf):
    """EX-4: permutation importance of the fold models."""
    f = fold_table(spark, sf)
    models = linear.fit_ridge(f.where(F.col("role") == "train"), views.FOLD, BASE).withColumn("addend", F.lit(0.0))
    validation = f.where(F.col("role") == "validation").withColumn("offset", F.col("pos") - F.col("cut"))
    return explain.permutation_importance(validation, models, views.FOLD, BASE, "offset")


REQUIRED = Manifest([
    FeatureSpec("hour", "ts", "calendar", "0", "calendar_extract", "known_in_advance", "Local hour"),
    FeatureSpec("y_lag_24", "y", "historical_load", "24", "shift(+24)", "historical_actual_only", "Value a day ago", 24),
    FeatureSpec("y_lag_168", "y", "historical_load", "168", "shift(+168)", "historical_actual_only", "Value a week ago", 168),
])


@query("forecast_strict", ["cells"], sql=f"""
  SELECT series_id, origin + INTERVAL 1 HOUR * h AS ts, 'h+' || h AS forecast_horizon, NULL::DOUBLE AS y_pred, origin AS forecast_origin, 'ridge' AS model, 'STRICT' AS scenario,
    false AS production_ready, '{forecast.STRICT_REASON}' AS blocking_reason FROM (SELECT series_id, max(ts) AS origin FROM cells GROUP BY 1), (SELECT unnest(generate_series(1, 24)) AS h)
""", stamps=["ts", "forecast_origin"], doubles=["y_pred"])
def forecast_strict(spark, sf):
    """FC-1: no prediction while a required feature is unknown at the origin."""
    ready = forecast.readiness(availability_audit(REQUIRED.to_frame(spark)), "ridge")
    origins = views.cells(spark, sf).groupBy("series_id").agg(F.max("ts").alias("origin"), F.max_by("y", "ts").alias("last_y"))
    return forecast.strict_forecast(origins, HOURLY, ready, F.col("last_y"), "ridge")


@query("forecast_assumed")
def forecast_assumed(spark, sf):
    """FC-2: forecast from 24 hours before the end with stored features, an archived model, its addend and its AR state."""
    from panelcast.sources.models import single_model

    h = History(HOURLY).lag("y", 24).lag("y", 48)
    features = add_calendar(h.apply(views.hourly(spark, sf)))
    columns = ["hour_sin", "hour_cos", "y_lag_24", "y_lag_48", "share_high_1d", "share_high_2d"]
    windows = {"share_high_1d": 24, "share_high_2d": 48}
    origin = F.timestamp_add("HOUR", F.lit(-24), F.max("ts")).cast("timestamp_ntz")
    origins = features.groupBy("series_id").agg(origin.alias("origin"))
    hs = History(HOURLY)
    for name, w in windows.items():
        hs.share_above("y", 60.0, w, 24, name)
    history = features.join(origins, "series_id").where(F.col("ts") <= F.col("origin")).drop("origin")
    by, known = ["series_id"], stage(hs.apply(history).where(F.col("y").isNotNull()))
    fitted = stage(linear.fit_ridge(known, by, columns))
    past = linear.score(known, fitted, by, columns).withColumn("role", F.lit("train"))
    addend = residual.weighted_addend(past, by, F.col(INDEX).cast("double"))
    left = past.join(addend, by).withColumn("error", F.col("y") - F.col("pred") - F.col("addend"))
    model = single_model(fitted.join(addend, by).join(residual.fit_phi(left, by, INDEX), by))
    inputs = forecast.assumed_inputs(origins, history, features, HOURLY, columns, "y", 60.0, windows, 24)
    return forecast.assumed_forecast(inputs, HOURLY, model, "ridge")


@query("forecast_assumed_panel")
def forecast_assumed_panel(spark, sf):
    """FC-2 for a panel: every series with its own archived model, addend and AR state, a week ahead."""
    by, columns, horizon = ["series_id"], ["y_lag_7", "y_lag_14"], 7
    features = stage(History(DAILY).lag("y", 7).lag("y", 14).apply(views.daily(spark, sf)))
    origin = F.timestamp_add("DAY", F.lit(-horizon), F.max("ts")).cast("timestamp_ntz")
    origins = stage(features.groupBy(*by).agg(origin.alias("origin")))
    known = stage(features.join(origins, by).where((F.col("ts") <= F.col("origin")) & F.col("y").isNotNull()).drop("origin"))
    fitted = stage(linear.fit_ridge(known, by, columns))
    past = linear.score(known, fitted, by, columns).withColumn("role", F.lit("train"))
    addend = residual.weighted_addend(past, by, F.col(INDEX) * 24.0)
    left = past.join(addend, by).withColumn("error", F.col("y") - F.col("pred") - F.col("addend"))
    archive = stage(fitted.join(addend, by).join(residual.fit_phi(left, by, INDEX), by))
    inputs = forecast.assumed_inputs(origins, known, features, DAILY, columns, "y", 0.0, {}, horizon, horizon)
    return forecast.assumed_forecasts(inputs, DAILY, archive, columns, "ridge")
