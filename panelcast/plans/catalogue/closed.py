"""The fold models with two features, whose solution SQL can write down: fits, scores, selection, explanations, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY, HOURLY
from panelcast.operators import evaluate, explain, forecast, linear
from panelcast.operators.manifest import FeatureSpec, Manifest, availability_audit, column_roles
from panelcast.plans import views
from panelcast.plans.catalogue.models import CRAMER, FLAG, FROZEN, lines
from panelcast.plans.registry import query
from panelcast.sources.staging import stage

PAIR = ["lag_1d", "lag_7d"]
ALPHAS = (0.001, 1.0, 100.0)

views.CTES["pair"] = """pair AS (SELECT series_id, fold, count(*) AS n, avg(lag_1d) AS m1, avg(lag_7d) AS m2, stddev_pop(lag_1d) AS s1, stddev_pop(lag_7d) AS s2, avg(y) AS my,
  corr(lag_1d, lag_7d) AS r, covar_pop(lag_1d, y) / stddev_pop(lag_1d) AS c1, covar_pop(lag_7d, y) / stddev_pop(lag_7d) AS c2 FROM folds WHERE role = 'train' GROUP BY 1, 2)"""
views.DEPENDS["pair"] = ["folds"]
views.CTES["fitted"] = f"fitted AS (SELECT *, {CRAMER.format(a='0.001')} FROM pair)"
views.DEPENDS["fitted"] = ["pair"]
TERM = {c: f"w{i} * (f.{c} - m{i}) / s{i}" for i, c in enumerate(PAIR, start=1)}
views.CTES["oof"] = f"""oof AS (SELECT f.series_id, f.fold, f.ts, f.pos, f.cut, f.y, my + {' + '.join(TERM.values())} AS p, {', '.join(f'{t} AS t{i}' for i, t in enumerate(TERM.values(), start=1))},
  (f.lag_1d - m1) / s1 AS z1, (f.lag_7d - m2) / s2 AS z2, w1, w2 FROM folds f JOIN fitted w ON w.series_id = f.series_id AND w.fold = f.fold WHERE f.role = 'validation')"""
views.DEPENDS["oof"] = ["fitted"]


def fold_rows(spark, sf):
    return stage(views.folds(spark, sf).drop("pred"))


def fitted(f, alphas=(linear.FINAL_ALPHA,)):
    return linear.fit_ridge(f.where(F.col("role") == "train"), views.FOLD, PAIR, alphas=alphas)


def validation(f):
    return f.where(F.col("role") == "validation")


@query("model_walk_forward_pair", ["pair"], sql=f"""
  SELECT series_id, alpha, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae, avg(rmse) AS mean_rmse, avg(bias) AS mean_bias, count(*) AS n_folds FROM (
    SELECT f.series_id, f.fold, alpha, avg(abs(p - f.y)) AS mae, sqrt(avg((p - f.y) * (p - f.y))) AS rmse, avg(p - f.y) AS bias FROM folds f
    JOIN (SELECT *, {CRAMER.format(a='alpha')} FROM pair, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) g(alpha)) w ON w.series_id = f.series_id AND w.fold = f.fold,
    LATERAL (SELECT my + {' + '.join(TERM.values())} AS p) WHERE f.role = 'validation' GROUP BY 1, 2, 3) GROUP BY 1, 2
""", doubles=["alpha", "mean_mae", "std_mae", "mean_rmse", "mean_bias"])
def model_walk_forward_pair(spark, sf):
    """MD-4 over four folds: every strength fitted on the train block, scored on the validation block, summarised."""
    f = fold_rows(spark, sf)
    scored = linear.score(validation(f), fitted(f, ALPHAS), views.FOLD, PAIR)
    out = evaluate.summarise_folds(evaluate.metrics(scored, [*views.FOLD, "alpha"]), ["series_id", "alpha"])
    return out.select("series_id", "alpha", "mean_mae", "std_mae", "mean_rmse", "mean_bias", "n_folds")


@query("model_out_of_fold_pair", ["oof"], sql="SELECT series_id, fold, ts, y, p AS pred, p - y AS residual FROM oof", doubles=["y", "pred", "residual"], whole=["fold"], stamps=["ts"])
def model_out_of_fold_pair(spark, sf):
    """EV-18: out-of-fold predictions of the fold models."""
    f = fold_rows(spark, sf)
    out = linear.score(validation(f), fitted(f), views.FOLD, PAIR)
    return out.select("series_id", "fold", "ts", "y", "pred", (F.col("pred") - F.col("y")).alias("residual"))


@query("model_top_coefficients_pair", ["fitted"], sql="""
  SELECT series_id, fold, side, 1 AS rank, CASE WHEN (side = 'positive') = (w1 >= w2) THEN 'lag_1d' ELSE 'lag_7d' END AS feature,
    CASE WHEN side = 'positive' THEN greatest(w1, w2) ELSE least(w1, w2) END AS coefficient FROM fitted, (VALUES ('positive'), ('negative')) s(side)
""", doubles=["coefficient"], whole=["fold", "rank"])
def model_top_coefficients_pair(spark, sf):
    """EV-17: the largest and the smallest coefficient of every fold model."""
    return evaluate.top_coefficients(linear.coefficient_table(fitted(fold_rows(spark, sf)), views.FOLD), views.FOLD, k=1)


def model_importance(spark, sf):
    """Fold fits → importance on their validation rows."""
    f = fold_rows(spark, sf)
    return explain.importance(validation(f), fitted(f), views.FOLD, PAIR)


views.CTES["fold_importance"] = "fold_importance AS (" + " UNION ALL ".join(
    f"SELECT series_id, fold, '{c}' AS feature, max(w{i}) AS std_coef, avg(abs(t{i})) AS mean_abs_shap, avg(t{i}) AS mean_shap FROM oof GROUP BY 1, 2" for i, c in enumerate(PAIR, start=1)) + ")"
views.DEPENDS["fold_importance"] = ["oof"]


@query("explain_fold_models", ["fold_importance"], sql="""
  SELECT *, CASE WHEN n_folds_pos > n_folds_neg THEN '+' WHEN n_folds_neg > n_folds_pos THEN '-' ELSE '0' END AS direction,
    row_number() OVER (PARTITION BY series_id ORDER BY mean_abs_shap DESC, mean_abs_std_coef DESC, feature) AS rank FROM (
    SELECT series_id, feature, avg(mean_abs_shap) AS mean_abs_shap, stddev_pop(mean_abs_shap) AS std_abs_shap, avg(mean_shap) AS mean_shap, avg(std_coef) AS mean_std_coef,
      stddev_pop(std_coef) AS std_std_coef, avg(abs(std_coef)) AS mean_abs_std_coef, count(*) FILTER (WHERE std_coef > 0) AS n_folds_pos, count(*) FILTER (WHERE std_coef < 0) AS n_folds_neg
    FROM fold_importance GROUP BY 1, 2)
""", doubles=["mean_abs_shap", "std_abs_shap", "mean_shap", "mean_std_coef", "std_std_coef", "mean_abs_std_coef"], whole=["rank"])
def explain_fold_models(spark, sf):
    """EX-5 on real folds: fits, contributions on validation rows, summary with signs and ranks."""
    return explain.summarise_importance(model_importance(spark, sf), ["series_id"])


@query("explain_fold_groups", ["fold_importance"], sql="""
  SELECT series_id, feature_group, max(k) AS n_features, avg(s) AS mean_abs_shap_sum, coalesce(stddev_samp(s), 0) AS std_abs_shap_sum, avg(m) AS mean_abs_shap_mean FROM (
    SELECT series_id, fold, CASE feature WHEN 'lag_1d' THEN 'recent' ELSE 'weekly' END AS feature_group, count(*) AS k, sum(mean_abs_shap) AS s, avg(mean_abs_shap) AS m
    FROM fold_importance GROUP BY 1, 2, 3) GROUP BY 1, 2
""", doubles=["mean_abs_shap_sum", "std_abs_shap_sum", "mean_abs_shap_mean"])
def explain_fold_groups(spark, sf):
    """EX-6 on real folds: sums per feature group of a manifest."""
    specs = Manifest([FeatureSpec(c, "y", g, str(k), f"shift(+{k})", "prior_auction_only", c, k) for c, g, k in (("lag_1d", "recent", 1), ("lag_7d", "weekly", 7))])
    groups = specs.to_frame(spark).select(F.col("feature_name").alias("feature"), "feature_group")
    return explain.group_importance(model_importance(spark, sf), groups, ["series_id"])


@query("explain_additivity_frozen", sql="SELECT l_returnflag, 0.125::DOUBLE AS max_gap, count(*) AS n FROM lineitem GROUP BY 1", doubles=["max_gap"])
def explain_additivity_frozen(spark, sf):
    """EX-2 against the archived scorer: contributions and intercept fall short of it by the addend, and by nothing else."""
    rows = linear.score_frozen(lines(spark, sf), FROZEN)
    model = {k: F.array(*[F.lit(v) for v in FROZEN[k]]) for k in ("names", "medians", "means", "scales", "coef")}
    models = rows.select(*FLAG).distinct().withColumns({**model, "intercept": F.lit(FROZEN["intercept"])})
    return explain.additivity(rows, models, FLAG, FROZEN["names"])


PRIME = explain.PRIMES


@query("explain_permutation_pair", ["oof"], sql=f"""
  WITH placed AS (SELECT o.*, pos - cut AS i, count(*) OVER g AS n, ('0x' || substr(md5(series_id || '|' || fold || '|{explain.SEED}'), 1, 8))::BIGINT AS h FROM oof o WINDOW g AS (PARTITION BY series_id, fold)),
    moved AS (SELECT *, (CASE WHEN n % {PRIME[0]} <> 0 THEN {PRIME[0]} WHEN n % {PRIME[1]} <> 0 THEN {PRIME[1]} ELSE {PRIME[2]} END * i + h % n) % n AS donor, p - y AS e FROM placed)
  SELECT a.series_id, a.fold, u.feature, avg(abs(u.moved)) - avg(abs(a.e)) AS mae_increase FROM moved a JOIN moved b ON b.series_id = a.series_id AND b.fold = a.fold AND b.i = a.donor,
  LATERAL (VALUES ('lag_1d', a.e + a.w1 * (b.z1 - a.z1)), ('lag_7d', a.e + a.w2 * (b.z2 - a.z2))) u(feature, moved) GROUP BY 1, 2, 3
""", doubles=["mae_increase"], whole=["fold"])
def explain_permutation_pair(spark, sf):
    """EX-4: permutation importance; the index map i → a·i + b mod n can be repeated by SQL."""
    f = fold_rows(spark, sf)
    models = fitted(f).withColumn("addend", F.lit(0.0))
    return explain.permutation_importance(validation(f).withColumn("offset", F.col("pos") - F.col("cut")), models, views.FOLD, PAIR, "offset")


READY = Manifest([
    FeatureSpec("hour", "ts", "calendar", "0", "calendar_extract", "known_in_advance", "Local hour"),
    FeatureSpec("y_lag_48", "y", "historical_target", "48", "shift(+48)", "prior_auction_only", "Value two days ago", 48),
])


@query("forecast_strict_ready", ["cells"], sql="""
  SELECT series_id, origin + INTERVAL 1 HOUR * h AS ts, 'h+' || h AS forecast_horizon, last_y AS y_pred, origin AS forecast_origin, 'ready' AS model, 'STRICT' AS scenario,
    true AS production_ready, NULL::VARCHAR AS blocking_reason FROM (SELECT series_id, max(ts) AS origin, arg_max(y, ts) AS last_y FROM cells GROUP BY 1), (SELECT unnest(generate_series(1, 24)) AS h)
""", stamps=["ts", "forecast_origin"], doubles=["y_pred"])
def forecast_strict_ready(spark, sf):
    """FC-1 with a model whose features are all known at the origin: the prediction is given."""
    ready = forecast.readiness(availability_audit(READY.to_frame(spark)), "ready")
    origins = views.cells(spark, sf).groupBy("series_id").agg(F.max("ts").alias("origin"), F.max_by("y", "ts").alias("last_y"))
    return forecast.strict_forecast(origins, HOURLY, ready, F.col("last_y"), "ready")


# Roles by name, first match wins.
LINE_RULES = {r"extendedprice": "target", r"key$|linenumber": "identifier", r"date$": "timestamp", r"quantity|discount|tax": "driver"}


@query("feature_column_roles", sql="SELECT u.* FROM (SELECT " + ", ".join(f"count({c}) AS {c}" for c in (
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")) + """ FROM lineitem) q, LATERAL (VALUES
    ('l_orderkey', 'identifier', l_orderkey), ('l_linenumber', 'identifier', l_linenumber), ('l_quantity', 'driver', l_quantity), ('l_extendedprice', 'target', l_extendedprice),
    ('l_discount', 'driver', l_discount), ('l_tax', 'driver', l_tax), ('l_returnflag', 'ambiguous', l_returnflag), ('l_linestatus', 'ambiguous', l_linestatus), ('l_shipdate', 'timestamp', l_shipdate)) u(column_name, role, present)""")
def feature_column_roles(spark, sf):
    """FE-21: role of every column by name rules, next to how often it is present."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    counts = views.table(spark, sf, "lineitem").agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "present")
    return column_roles(spark, columns, LINE_RULES).join(counts, "column_name")


@query("forecast_panel_pair", ["daily"], sql="""
  WITH known AS (SELECT d.*, lag(y, 7) OVER w AS a, lag(y, 14) OVER w AS b, n_steps - 8 AS origin FROM daily d WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
  fit AS (SELECT series_id, count(*) AS n, avg(a) AS m1, avg(b) AS m2, stddev_pop(a) AS s1, stddev_pop(b) AS s2, avg(y) AS my, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS c1, covar_pop(b, y) / stddev_pop(b) AS c2
    FROM (SELECT * FROM known WHERE pos <= origin AND b IS NOT NULL) GROUP BY 1),
  w AS (SELECT *, """ + CRAMER.format(a="0.001") + """ FROM fit)
  SELECT k.series_id, k.ts, 'h+' || (k.pos - k.origin) AS forecast_horizon, my + w1 * (a - m1) / s1 + w2 * (b - m2) / s2 AS y_pred FROM known k JOIN w ON w.series_id = k.series_id WHERE k.pos > k.origin
""", stamps=["ts"], doubles=["y_pred"])
def forecast_panel_pair(spark, sf):
    """FC-2 for a panel, two features and a neutral state: inputs looked up after the origin, each series with its own model."""
    by, columns, horizon = ["series_id"], ["y_lag_7", "y_lag_14"], 7
    features = stage(forecast_features(spark, sf))
    origin = F.timestamp_add("DAY", F.lit(-horizon), F.max("ts")).cast("timestamp_ntz")
    origins = stage(features.groupBy(*by).agg(origin.alias("origin")))
    known = features.join(origins, by).where((F.col("ts") <= F.col("origin")) & F.col("y_lag_14").isNotNull()).drop("origin")
    archive = linear.fit_ridge(known, by, columns).withColumns({c: F.lit(0.0) for c in ("addend", "phi", "last_error")})
    inputs = forecast.assumed_inputs(origins, known, features, DAILY, columns, "y", 0.0, {}, horizon, horizon)
    return forecast.assumed_forecasts(inputs, DAILY, archive, columns, "ridge").select("series_id", "ts", "forecast_horizon", "y_pred")


def forecast_features(spark, sf):
    from panelcast.operators.features import History

    return History(DAILY).lag("y", 7).lag("y", 14).apply(views.daily(spark, sf))
