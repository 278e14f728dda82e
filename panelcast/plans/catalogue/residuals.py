"""Residual corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY
from panelcast.functions.quantiles import quantiles
from panelcast.operators import residual
from panelcast.operators.grid import future_steps
from panelcast.plans import views
from panelcast.plans.registry import query


def hours():
    return F.col("pos") * 24.0


VALIDATION = "(SELECT * FROM folds WHERE role = 'validation')"
JOIN = "ON e.series_id = v.series_id AND e.fold = v.fold"


def _corrected(edges: str, expr: str) -> str:
    return f"SELECT v.series_id, v.fold, v.ts, v.pred, {expr} AS corrected FROM {VALIDATION} v JOIN ({edges}) e {JOIN}"


def _register(method: str, name: str, edges: str, expr: str) -> None:
    @query(name, ["folds"], sql=_corrected(edges, expr), doubles=["pred", "corrected"], whole=["fold"], stamps=["ts"])
    def job(spark, sf):
        out = residual.correct(views.folds(spark, sf), views.FOLD, method, hours())
        return out.where(F.col("role") == "validation").select("series_id", "fold", "ts", "pred", "corrected")

    job.__doc__ = f"Residual correction {method}."


TRAIN_MEAN = "SELECT series_id, fold, avg(y - pred) AS a FROM folds WHERE role = 'train' GROUP BY 1, 2"
_register("no_correction", "residual_no_correction", TRAIN_MEAN, "v.pred")
_register("fold_train_bias", "residual_train_bias", TRAIN_MEAN, "v.pred + e.a")
_register("expanding_historical", "residual_time_weighted", """SELECT series_id, fold, sum(w * (y - pred)) / sum(w) AS a FROM (
    SELECT *, exp((pos - max(pos) OVER (PARTITION BY series_id, fold)) * 24 / 720.0::DOUBLE) AS w FROM folds WHERE role = 'train') GROUP BY 1, 2""", "v.pred + e.a")
EDGES = "SELECT series_id, fold, quantile_cont(y, 0.25) AS e1, quantile_cont(y, 0.5) AS e2, quantile_cont(y, 0.75) AS e3 FROM folds WHERE role = 'train' GROUP BY 1, 2"
REGIME = "CASE WHEN {0} > e3 THEN 3 WHEN {0} > e2 THEN 2 WHEN {0} > e1 THEN 1 ELSE 0 END"
_register("regime_aware", "residual_regime_aware", f"""SELECT q.*, {', '.join(f"coalesce(avg(y - pred) FILTER (WHERE {REGIME.format('pred')} = {r}), avg(y - pred)) AS a{r}" for r in range(4))}
    FROM (SELECT * FROM folds WHERE role = 'train') t JOIN ({EDGES}) q USING (series_id, fold) GROUP BY ALL""",
          f"v.pred + CASE {REGIME.format('v.pred')} WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END")
_register("linear_calibration", "residual_linear_calibration", """SELECT series_id, fold, regr_slope(y, pred) AS b, regr_intercept(y, pred) AS a
    FROM folds WHERE role = 'train' GROUP BY 1, 2""", "e.a + e.b * v.pred")


@query("residual_specialist", ["folds"], sql=f"""
  SELECT v.series_id, v.fold, v.ts, v.pred + CASE WHEN v.lag_7d > t OR v.lag_1d > t THEN extra ELSE 0 END AS corrected FROM {VALIDATION} v JOIN (
    SELECT f.series_id, f.fold, t, coalesce(avg(y - pred) FILTER (WHERE role = 'train' AND (lag_7d > t OR lag_1d > t)), 0) AS extra FROM folds f
    JOIN (SELECT series_id, fold, quantile_cont(y, 0.75) AS t FROM folds WHERE role = 'train' GROUP BY 1, 2) q ON q.series_id = f.series_id AND q.fold = f.fold GROUP BY ALL) e {JOIN}
""", doubles=["corrected"], whole=["fold"], stamps=["ts"])
def residual_specialist(spark, sf):
    """RC-6: extra addend where recent values are high."""
    f = views.folds(spark, sf)
    t = quantiles(f.where(F.col("role") == "train"), views.FOLD, "y", [0.75]).select(*views.FOLD, F.col("q0_75").alias("t"))
    high = (F.col("lag_7d") > F.col("t")) | (F.col("lag_1d") > F.col("t"))
    flagged = f.join(t, views.FOLD).withColumn("high", high)
    out = flagged.join(residual.specialist_addend(flagged, views.FOLD, F.col("high")), views.FOLD)
    corrected = F.col("pred") + F.when(F.col("high"), F.col("extra")).otherwise(0.0)
    return out.where(F.col("role") == "validation").select("series_id", "fold", "ts", corrected.alias("corrected"))


views.CTES["phis"] = """phis AS (SELECT series_id, fold, CASE WHEN count(*) >= 3 AND sum(p * p) > 0 THEN greatest(-0.999, least(0.999, sum(r * p) / sum(p * p))) ELSE 0 END AS phi,
  arg_max(r, pos) AS last_error FROM (SELECT *, lag(r) OVER (PARTITION BY series_id, fold ORDER BY pos) AS p FROM (
    SELECT *, y - pred AS r, max(pos) OVER (PARTITION BY series_id, fold) AS last FROM folds WHERE role = 'train') WHERE pos > last - 1440) GROUP BY 1, 2)"""
views.CTES["offsets"] = "offsets AS (SELECT *, pos - cut AS o FROM folds WHERE role = 'validation')"
views.DEPENDS.update({"phis": ["folds"], "offsets": ["folds"]})


def state(spark, sf):
    train = views.folds(spark, sf).where(F.col("role") == "train").withColumn("error", F.col("y") - F.col("pred"))
    return residual.fit_phi(train, views.FOLD, "pos")


def scored_block(spark, sf):
    return residual.with_offset(views.folds(spark, sf)).where(F.col("role") == "validation")


@query("residual_ar1_fit", ["phis"], sql="SELECT * FROM phis", doubles=["phi", "last_error"], whole=["fold"])
def residual_ar1_fit(spark, sf):
    """RC-7: AR(1) coefficient on the last 1,440 errors."""
    return state(spark, sf)


@query("residual_ar1_blocks", ["offsets", "phis"], sql="""
  SELECT v.series_id, v.fold, v.ts, pow(phi, o % 24 + 1) * CASE WHEN o < 24 THEN last_error ELSE s.y - s.pred END AS ar_add,
    v.pred + pow(phi, o % 24 + 1) * CASE WHEN o < 24 THEN last_error ELSE s.y - s.pred END AS corrected
  FROM (SELECT *, o // 24 * 24 - 1 AS so FROM offsets) v JOIN phis e ON e.series_id = v.series_id AND e.fold = v.fold
  LEFT JOIN (SELECT series_id AS sid, fold AS fid, o AS oo, y, pred FROM offsets) s ON s.sid = v.series_id AND s.fid = v.fold AND s.oo = v.so
""", doubles=["ar_add", "corrected"], whole=["fold"], stamps=["ts"])
def residual_ar1_blocks(spark, sf):
    """RC-8: AR(1) correction in 24-step blocks."""
    out = residual.block_correction(scored_block(spark, sf), views.FOLD, state(spark, sf), "offset")
    return out.select("series_id", "fold", "ts", "ar_add", "corrected")


@query("residual_ar1_blocks_delayed", ["offsets", "phis"], sql="""
  SELECT v.series_id, v.fold, v.ts, v.pred + pow(phi, o % 24 + 1 + CASE WHEN o < 24 THEN 0 ELSE 12 END) * CASE WHEN o < 24 THEN last_error ELSE s.y - s.pred END AS corrected
  FROM (SELECT *, o // 24 * 24 - 1 - 12 AS so FROM offsets) v JOIN phis e ON e.series_id = v.series_id AND e.fold = v.fold
  LEFT JOIN (SELECT series_id AS sid, fold AS fid, o AS oo, y, pred FROM offsets) s ON s.sid = v.series_id AND s.fid = v.fold AND s.oo = v.so
""", doubles=["corrected"], whole=["fold"], stamps=["ts"])
def residual_ar1_blocks_delayed(spark, sf):
    """RC-8 with the state half a block earlier, as an origin at noon of the day before would have it."""
    out = residual.block_correction(scored_block(spark, sf), views.FOLD, state(spark, sf), "offset", state_delay=12)
    return out.select("series_id", "fold", "ts", "corrected")


@query("residual_ar1_horizon", ["phis"], sql="""
  SELECT series_id, fold, h, pow(phi, h) * last_error AS ar_add FROM phis, (SELECT unnest(generate_series(1, 24)) AS h)
""", doubles=["ar_add"], whole=["fold", "h"])
def residual_ar1_horizon(spark, sf):
    """RC-9: decaying addend over the next 24 steps."""
    steps = future_steps(state(spark, sf).withColumn("origin", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), DAILY, 24)
    return steps.select("series_id", "fold", "h", residual.horizon_addend(F.col("phi"), F.col("last_error"), F.col("h")).alias("ar_add"))


@query("residual_ar1_one_step", ["offsets", "phis"], sql="""
  SELECT v.series_id, v.fold, v.ts, v.pred + phi * coalesce(lag(v.y - v.pred) OVER (PARTITION BY v.series_id, v.fold ORDER BY v.pos), last_error) AS corrected
  FROM offsets v JOIN phis e ON e.series_id = v.series_id AND e.fold = v.fold
""", doubles=["corrected"], whole=["fold"], stamps=["ts"])
def residual_ar1_one_step(spark, sf):
    """RC-10: one-step diagnostic."""
    out = residual.one_step(scored_block(spark, sf), DAILY, views.FOLD, state(spark, sf))
    return out.select("series_id", "fold", "ts", "corrected")


@query("residual_lag_correlation", ["folds"], sql="""
  SELECT series_id, fold, corr(r, p) AS lag1_corr FROM (SELECT *, lag(r) OVER (PARTITION BY series_id, fold ORDER BY pos) AS p
    FROM (SELECT *, y - pred AS r FROM folds WHERE role = 'train')) GROUP BY 1, 2
""", doubles=["lag1_corr"], whole=["fold"])
def residual_lag_correlation(spark, sf):
    """RC-12: lag-1 autocorrelation of train errors."""
    return residual.lag_one_correlation(views.folds(spark, sf).where(F.col("role") == "train"), views.FOLD)


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_G = [["g11", "g12", "g13"], ["g12", "g22", "g23"], ["g13", "g23", "g33"]]
_R = ["r1", "r2", "r3"]
_W = [f"{_det([[_R[i] if j == k else _G[i][j] for j in range(3)] for i in range(3)])} / {_det(_G)}" for k in range(3)]
_AIC = "n * (ln(2 * pi() * sse / n) + 1) + 2 * (n_params + 1)"
LADDER_SQL = f"""SELECT series_id, fold, model, n_params, {_AIC} AS aic, coef_lag_1 FROM (
    SELECT series_id, fold, 'AR1' AS model, 1 AS n_params, n, r1 / g11 AS coef_lag_1, g00 - r1 * r1 / g11 AS sse FROM ar_sums UNION ALL
    SELECT series_id, fold, 'SAR1x24', 3, n, w1, g00 - (w1 * r1 + w2 * r2 + w3 * r3) FROM (SELECT *, {', '.join(f'{w} AS w{k}' for k, w in enumerate(_W, start=1))} FROM ar_sums))"""
views.CTES["ar_sums"] = """ar_sums AS (SELECT series_id, fold, count(*) AS n, sum(a * a) AS g00, sum(a * b) AS r1, sum(a * c) AS r2, sum(a * d) AS r3, sum(b * b) AS g11, sum(b * c) AS g12,
  sum(b * d) AS g13, sum(c * c) AS g22, sum(c * d) AS g23, sum(d * d) AS g33 FROM (
    SELECT series_id, fold, r AS a, lag(r, 1) OVER w AS b, lag(r, 24) OVER w AS c, lag(r, 25) OVER w AS d FROM (
      SELECT *, y - pred AS r, max(pos) OVER (PARTITION BY series_id, fold) AS last FROM folds WHERE role = 'train') WHERE pos > last - 1440
    WINDOW w AS (PARTITION BY series_id, fold ORDER BY pos)) WHERE d IS NOT NULL GROUP BY 1, 2)"""
views.DEPENDS["ar_sums"] = ["folds"]


@query("residual_ar_ladder", ["ar_sums"], sql=LADDER_SQL, doubles=["aic", "coef_lag_1"], whole=["fold", "n_params"])
def residual_ar_ladder(spark, sf):
    """RC-11: AR(1) and seasonal AR by conditional least squares with AIC."""
    train = views.folds(spark, sf).where(F.col("role") == "train").withColumn("error", F.col("y") - F.col("pred"))
    ladder = residual.fit_ar_ladder(residual.ar_equations(train, views.FOLD, "pos"), views.FOLD)
    return ladder.select("series_id", "fold", "model", "n_params", "aic", F.element_at("coef", 1).alias("coef_lag_1"))


@query("residual_ar_choice", ["ar_sums"], sql=f"""
  SELECT series_id, model FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_aic, n_params) AS r FROM (
    SELECT series_id, model, n_params, avg(aic) AS mean_aic FROM ({LADDER_SQL}) GROUP BY 1, 2, 3)) WHERE r = 1
""")
def residual_ar_choice(spark, sf):
    """RC-11: candidate with the lowest mean AIC over folds, then fewer parameters."""
    train = views.folds(spark, sf).where(F.col("role") == "train").withColumn("error", F.col("y") - F.col("pred"))
    ladder = residual.fit_ar_ladder(residual.ar_equations(train, views.FOLD, "pos"), views.FOLD)
    return residual.choose_ar(ladder, ["series_id"])


@query("residual_ar_ladder_scores")
def residual_ar_ladder_scores(spark, sf):
    """RC-11: both candidates scored in 24-step blocks."""
    f = residual.with_offset(views.folds(spark, sf))
    train = f.where(F.col("role") == "train").withColumn("error", F.col("y") - F.col("pred"))
    ladder = residual.fit_ar_ladder(residual.ar_equations(train, views.FOLD, "pos"), views.FOLD)
    out = residual.ar_block_forecast(f, views.FOLD, ladder, "offset")
    return out.groupBy("series_id", "fold", "model").agg(F.avg(F.abs(F.col("corrected") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))


