"""Linear models, ensembles, stacking and the pipelines built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.contract import DAILY
from panelcast.operators import boosting, evaluate, linear, splits, trees
from panelcast.operators.features import History, add_calendar
from panelcast.plans import views, walk_forward
from panelcast.plans.registry import query
from panelcast.sources.staging import stage

X = ["l_quantity", "l_discount"]
FLAG = ["l_returnflag"]


def hours():
    return F.col("pos") * 24.0


def lines(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *X, "l_tax", (F.col("l_extendedprice") / 1000.0).alias("y"))


MOMENTS = """moments AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, avg(y) AS my,
  corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, y) / stddev_pop(l_quantity) AS c1, covar_pop(l_discount, y) / stddev_pop(l_discount) AS c2
  FROM (SELECT *, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem) GROUP BY 1)"""
views.CTES["moments"] = MOMENTS
CRAMER = """(n * c1 * (n + {a}) - n * r * n * c2) / ((n + {a}) * (n + {a}) - n * r * n * r) AS w1,
  (n * c2 * (n + {a}) - n * r * n * c1) / ((n + {a}) * (n + {a}) - n * r * n * r) AS w2"""


@query("model_naive", ["scored"], sql="SELECT series_id, ts, lag_7d AS pred FROM scored", doubles=["pred"], stamps=["ts"])
def model_naive(spark, sf):
    """MD-1: last known value of the same weekday; NULLs rejected."""
    return linear.naive_forecast(views.scored(spark, sf).drop("pred"), "lag_7d").select("series_id", "ts", "pred")


@query("model_mean_of_lags", ["daily"], sql="""
  SELECT series_id, ts, (a + b) / 2 AS pred_2, (a + b + c) / 3 AS pred_3 FROM (SELECT series_id, ts, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 7) OVER w AS c
    FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts))
""", doubles=["pred_2", "pred_3"], stamps=["ts"])
def model_mean_of_lags(spark, sf):
    """MD-2: mean of two and of three lags."""
    out = History(DAILY).lag("y", 1, "a").lag("y", 2, "b").lag("y", 7, "c").apply(views.daily(spark, sf))
    return out.select("series_id", "ts", linear.mean_of_lags(["a", "b"]).alias("pred_2"), linear.mean_of_lags(["a", "b", "c"]).alias("pred_3"))


@query("model_ridge", ["moments"], sql=f"SELECT l_returnflag, {CRAMER.format(a='0.001')}, my AS intercept, n FROM moments",
       doubles=["w1", "w2", "intercept"])
def model_ridge(spark, sf):
    """MD-3: ridge per group through the distributed Gram."""
    df = lines(spark, sf)
    from panelcast.operators.prep import fit_scaler

    scaler = fit_scaler(df, FLAG, X)
    gram = linear.gram(df, FLAG, X, scaler=scaler)
    solved = linear.solve_ridge(gram, FLAG, 2, [0.001]).join(gram.select(*FLAG, "n"), FLAG)
    return solved.select(*FLAG, F.col("coef")[0].alias("w1"), F.col("coef")[1].alias("w2"), "intercept", "n")


GRID = [0.001, 1.0, 10.0, 1000.0]


@query("model_ridge_grid", ["moments"], sql=f"""
  SELECT s.l_returnflag, s.alpha, avg(abs(p - l.l_extendedprice / 1000)) AS mae, count(*) AS n FROM (
    SELECT *, {CRAMER.format(a='alpha')} FROM moments, (VALUES {', '.join(f'({a}::DOUBLE)' for a in GRID)}) g(alpha)) s
  JOIN lineitem l ON l.l_returnflag = s.l_returnflag, LATERAL (SELECT my + w1 * (l_quantity - m1) / s1 + w2 * (l_discount - m2) / s2 AS p) GROUP BY 1, 2
""", doubles=["alpha", "mae"])
def model_ridge_grid(spark, sf):
    """MD-4: all regularisation strengths from one Gram and one scoring scan."""
    df = lines(spark, sf)
    scored = linear.score(df, linear.fit_ridge(df, FLAG, X, alphas=GRID), FLAG, X)
    return scored.groupBy(*FLAG, "alpha").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("model_weighted_ridge", ["moments"], sql="""
  SELECT l_returnflag, (b1 * (a22 + 0.001) - a12 * b2) / ((a11 + 0.001) * (a22 + 0.001) - a12 * a12) AS w1,
    (b2 * (a11 + 0.001) - a12 * b1) / ((a11 + 0.001) * (a22 + 0.001) - a12 * a12) AS w2, ym AS intercept FROM (
    SELECT l_returnflag, sum(w * z1 * z1) AS a11, sum(w * z2 * z2) AS a22, sum(w * z1 * z2) AS a12, sum(w * z1 * (y - ym)) AS b1, sum(w * z2 * (y - ym)) AS b2, max(ym) AS ym FROM (
      SELECT *, sum(w * y) OVER g / sum(w) OVER g AS ym FROM (
        SELECT l.l_returnflag, (l_quantity - m1) / s1 AS z1, (l_discount - m2) / s2 AS z2, l_extendedprice / 1000.0::DOUBLE AS y, CASE WHEN l_extendedprice >= 75000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
        FROM lineitem l JOIN moments m ON m.l_returnflag = l.l_returnflag) WINDOW g AS (PARTITION BY l_returnflag)) GROUP BY 1)
""", doubles=["w1", "w2", "intercept"])
def model_weighted_ridge(spark, sf):
    """MD-5: weighted ridge, X not centred again."""
    df = lines(spark, sf).withColumn("w", F.when(F.col("y") >= 75, 2.0).otherwise(1.0))
    m = linear.fit_ridge(df, FLAG, X, weight="w")
    return m.select(*FLAG, F.col("coef")[0].alias("w1"), F.col("coef")[1].alias("w2"), "intercept")


ENET = [(0.1, 0.5), (1.0, 0.9)]


@query("model_elastic_net_one", ["moments"], sql=f"""
  SELECT l_returnflag, alpha, l1_ratio, sign(c1) * greatest(abs(c1) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) AS w, my AS intercept
  FROM moments, (VALUES {', '.join(f'({a}::DOUBLE, {r}::DOUBLE)' for a in (0.1, 1.0) for r in (0.5, 0.9))}) g(alpha, l1_ratio)
""", doubles=["alpha", "l1_ratio", "w", "intercept"])
def model_elastic_net_one(spark, sf):
    """MD-7: one feature, where the solution is a soft threshold."""
    m = linear.fit_elastic_net(lines(spark, sf), FLAG, X[:1], alphas=[0.1, 1.0], l1_ratios=[0.5, 0.9])
    return m.select(*FLAG, "alpha", "l1_ratio", F.col("coef")[0].alias("w"), "intercept")


@query("model_two_variable_ols", sql="""
  SELECT l_returnflag, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS w1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS w2,
    my - (ay * bb - byy * ab) / (aa * bb - ab * ab) * ma - (byy * aa - ay * ab) / (aa * bb - ab * ab) * mb AS intercept FROM (
    SELECT l_returnflag, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, y) AS ay, covar_pop(l_discount, y) AS byy,
      avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(y) AS my FROM (SELECT *, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem) GROUP BY 1)
""", doubles=["w1", "w2", "intercept"])
def model_two_variable_ols(spark, sf):
    """MD-14: unscaled two-variable least squares."""
    return linear.two_variable_ols(lines(spark, sf), FLAG, *X)


@query("model_average", ["scored"], sql="SELECT series_id, ts, (pred + naive) / 2 AS averaged FROM scored", doubles=["averaged"], stamps=["ts"])
def model_average(spark, sf):
    """MD-15: equal-weight average of two predictions."""
    return views.scored(spark, sf).select("series_id", "ts", linear.average(["pred", "naive"]).alias("averaged"))


FROZEN = {"names": ["l_quantity", "l_discount", "l_tax"], "medians": [25.0, 0.05, 0.04], "means": [25.5, 0.05, 0.04], "scales": [14.4, 0.03, 0.025],
          "coef": [25.0, -0.5, 0.25], "intercept": 38.0, "addend": 0.125}


@query("model_frozen_scoring", sql="""
  SELECT l_returnflag, l_linestatus, count(*) AS n, avg(p) AS mean_pred, min(p) AS min_pred, max(p) AS max_pred FROM (SELECT *, 38.0::DOUBLE + 0.125::DOUBLE
    + 25.0 * (CASE WHEN l_linenumber = 3 THEN 25.0 ELSE l_quantity END - 25.5) / 14.4::DOUBLE - 0.5 * (l_discount - 0.05) / 0.03::DOUBLE + 0.25 * (l_tax - 0.04) / 0.025::DOUBLE AS p FROM lineitem) GROUP BY 1, 2
""", doubles=["mean_pred", "min_pred", "max_pred"])
def model_frozen_scoring(spark, sf):
    """MD-16: archived linear model applied by column name."""
    df = lines(spark, sf).withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    out = linear.score_frozen(df, FROZEN)
    return out.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.min("pred").alias("min_pred"), F.max("pred").alias("max_pred")
    )


# --- walk-forward on the daily panel ------------------------------------------------------------

LAGS = (1, 2, 7, 14)
BASE = [*[f"y_lag_{k}" for k in LAGS], "orders_lag_7", "dow_sin", "dow_cos", "month_sin", "month_cos"]
LEVELS = {"7d": 7, "14d": 14}
SHARES = {"7d": 7, "14d": 14, "30d": 30}
PAIRS = [("y_lag_1", "dow_sin", "lag1_x_dow"), ("y_lag_7", "dow_sin", "lag7_x_dow"), ("y_lag_1", "orders_lag_7", "lag1_x_orders")]


def model_table(spark, sf):
    """Daily panel with history and calendar features."""
    h = History(DAILY).lag("orders", 7)
    for k in LAGS:
        h.lag("y", k)
    return add_calendar(h.apply(views.daily(spark, sf)), zone="UTC")


def fold_table(spark, sf):
    """Staged once: scaler, Gram and scoring all read it."""
    return splits.expanding_folds(stage(model_table(spark, sf)))


def fold_scores(df):
    validation = df.where(F.col("role") == "validation")
    return evaluate.metrics(validation, views.FOLD)


@query("model_walk_forward_ridge")
def model_walk_forward_ridge(spark, sf):
    """MD-4 over folds: summary of the α grid and the selected α per series (EV-3, EV-4)."""
    f = fold_table(spark, sf)
    models = linear.fit_ridge(f.where(F.col("role") == "train"), views.FOLD, BASE, alphas=linear.ALPHA_GRID)
    scored = linear.score(f.where(F.col("role") == "validation"), models, views.FOLD, BASE)
    return evaluate.summarise_folds(evaluate.metrics(scored, [*views.FOLD, "alpha"]), ["series_id", "alpha"])


@query("model_elastic_net")
def model_elastic_net(spark, sf):
    """MD-7: all elastic-net configurations per fold from one Gram."""
    f = fold_table(spark, sf)
    models = linear.fit_elastic_net(f.where(F.col("role") == "train"), views.FOLD, BASE)
    scored = linear.score(f.where(F.col("role") == "validation"), models, views.FOLD, BASE)
    return evaluate.summarise_folds(evaluate.metrics(scored, [*views.FOLD, "alpha", "l1_ratio"]), ["series_id", "alpha", "l1_ratio"])


@query("model_choose_weight")
def model_choose_weight(spark, sf):
    """MD-6: weight for high rows chosen on the inner tail."""
    from panelcast.functions.quantiles import quantiles

    train = splits.inner_tail(fold_table(spark, sf).where(F.col("role") == "train"), F.col("cut"))
    p75 = quantiles(train.where(F.col("inner_role") == "fit"), views.FOLD, "y", [0.75]).select(*views.FOLD, F.col("q0_75").alias("p75"))
    return linear.choose_weight(train.join(p75, views.FOLD), views.FOLD, BASE, "p75")


@query("model_linear_booster")
def model_linear_booster(spark, sf):
    """MD-11: all 36 configurations of the L2 coordinate booster, rounds stopped with patience 40 on the inner tail."""
    f = fold_table(spark, sf)
    train = splits.inner_tail(f.where(F.col("role") == "train"), F.col("cut"))
    models = linear.fit_booster(train, views.FOLD, BASE)
    config = [*linear.BOOSTER_KEYS, "rounds", "stop_mae"]
    scored = linear.score(f.where(F.col("role") == "validation"), models, views.FOLD, BASE)
    return evaluate.metrics(scored, [*views.FOLD, *config]).select(*views.FOLD, *config, "mae", "n")


@query("model_out_of_fold_predictions")
def model_out_of_fold_predictions(spark, sf):
    """EV-18: out-of-fold prediction table of the ridge model."""
    f = fold_table(spark, sf)
    models = linear.fit_ridge(f.where(F.col("role") == "train"), views.FOLD, BASE)
    scored = linear.score(f.where(F.col("role") == "validation"), models, views.FOLD, BASE)
    return scored.select("series_id", "ts", "y", "pred", (F.col("pred") - F.col("y")).alias("residual"), "fold", "alpha", "hour", "day_of_week", "month")


@query("model_top_coefficients")
def model_top_coefficients(spark, sf):
    """EV-17: largest and smallest coefficients per fold."""
    models = linear.fit_ridge(fold_table(spark, sf).where(F.col("role") == "train"), views.FOLD, BASE)
    return evaluate.top_coefficients(linear.coefficient_table(models, views.FOLD), views.FOLD, k=3)


def strategy_predictions(spark, sf, history="joined"):
    return walk_forward.strategies(fold_table(spark, sf), views.FOLD, DAILY, BASE, LEVELS, SHARES, 1, PAIRS, "y_lag_1", hours(), history=history)


@query("model_strategy_comparison")
def model_strategy_comparison(spark, sf):
    """RC-13: all strategies on the same folds."""
    return walk_forward.compare(strategy_predictions(spark, sf), views.FOLD, ["series_id"])


@query("model_strategy_block_history")
def model_strategy_block_history(spark, sf):
    """RC-13 with shares computed on each block alone."""
    return walk_forward.compare(strategy_predictions(spark, sf, "block"), views.FOLD, ["series_id"])


@query("model_frozen_pipeline")
def model_frozen_pipeline(spark, sf):
    """FC-3: development fit, one locked test score, model against naive."""
    rows = splits.chronological_split(model_table(spark, sf))
    test = walk_forward.frozen_pipeline(rows, DAILY, BASE, SHARES, 1, hours())["test"]
    model = evaluate.metrics(test, ["series_id"]).withColumn("model", F.lit("ridge_shares_ar1"))
    naive = evaluate.metrics(test, ["series_id"], pred="y_lag_7").withColumn("model", F.lit("naive"))
    return model.unionByName(naive)


PIPELINE_SQL = f"""SELECT series_id, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, avg(abs(naive - y)) AS naive_mae, max(ph) AS phi, max(addend) AS addend FROM (
    SELECT t.*, ar.phi AS ph, t.p1 + pow(ar.phi, o % 24 + 1) * CASE WHEN o < 24 THEN last_error ELSE s.err END - t.y AS e FROM (SELECT *, o // 24 * 24 - 1 AS so FROM tested) t JOIN ar ON ar.series_id = t.series_id
    LEFT JOIN (SELECT series_id AS sid, o AS oo, err FROM tested) s ON s.sid = t.series_id AND s.oo = t.so) GROUP BY 1"""
views.CTES["pipeline"] = f"""dev AS (SELECT series_id, count(*) AS n, avg(lag_1d) AS m1, avg(lag_7d) AS m2, stddev_pop(lag_1d) AS s1, stddev_pop(lag_7d) AS s2, avg(y) AS my, corr(lag_1d, lag_7d) AS r,
  covar_pop(lag_1d, y) / stddev_pop(lag_1d) AS c1, covar_pop(lag_7d, y) / stddev_pop(lag_7d) AS c2, max(pos) AS last FROM splits WHERE split <> 'test' GROUP BY 1),
raw AS (SELECT s.*, d.last, my + w1 * (lag_1d - m1) / s1 + w2 * (lag_7d - m2) / s2 AS p0 FROM splits s JOIN (SELECT *, {CRAMER.format(a='0.001')} FROM dev) d ON d.series_id = s.series_id),
adds AS (SELECT series_id, sum(exp((pos - last) * 24 / 720.0::DOUBLE) * (y - p0)) / sum(exp((pos - last) * 24 / 720.0::DOUBLE)) AS addend FROM raw WHERE split <> 'test' GROUP BY 1),
shifted AS (SELECT *, p0 + addend AS p1, y - p0 - addend AS err FROM raw JOIN adds USING (series_id)),
ar AS (SELECT series_id, sum(err * p) / sum(p * p) AS phi, arg_max(err, pos) AS last_error FROM (
  SELECT *, lag(err) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM shifted WHERE split <> 'test' AND pos > last - 1440) GROUP BY 1),
tested AS (SELECT *, pos - CAST(floor(n_steps * 0.85::DOUBLE) AS BIGINT) AS o FROM shifted WHERE split = 'test')"""
views.DEPENDS["pipeline"] = ["splits"]


@query("model_frozen_pipeline_small", ["pipeline"], sql=PIPELINE_SQL, doubles=["mae", "rmse", "bias", "naive_mae", "phi", "addend"])
def model_frozen_pipeline_small(spark, sf):
    """FC-3 with two features, end to end against SQL: fit, addend, AR state, blocks, one test score."""
    rows = splits.chronological_split(views.scored(spark, sf).drop("pred"))
    out = walk_forward.frozen_pipeline(rows, DAILY, ["lag_1d", "lag_7d"], {}, 1, hours())
    e = F.col("pred") - F.col("y")
    scores = out["test"].groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(F.abs(F.col("naive") - F.col("y"))).alias("naive_mae"),
    )
    return scores.join(out["model"].select("series_id", "phi", "addend"), "series_id")


META_ROWS = """meta_rows AS (SELECT * FROM (SELECT f.series_id, f.fold AS outer_fold, i.k AS inner_fold, f.pred, f.naive, f.y,
    CASE WHEN f.pos < floor(f.cut * i.lo) THEN 'train' WHEN f.pos < floor(f.cut * i.hi) THEN 'validation' END AS part
    FROM folds f, (VALUES (1, 0.5::DOUBLE, 0.65::DOUBLE), (2, 0.65::DOUBLE, 0.8::DOUBLE), (3, 0.8::DOUBLE, 1.0::DOUBLE)) i(k, lo, hi) WHERE f.role = 'train') WHERE part = 'validation'),
meta AS (SELECT series_id, outer_fold, count(*) AS n, avg(pred) AS m1, avg(naive) AS m2, stddev_pop(pred) AS s1, stddev_pop(naive) AS s2, avg(y) AS my, corr(pred, naive) AS r,
    covar_pop(pred, y) / stddev_pop(pred) AS c1, covar_pop(naive, y) / stddev_pop(naive) AS c2 FROM meta_rows GROUP BY 1, 2)"""
views.CTES["meta"], views.DEPENDS["meta"] = META_ROWS, ["folds"]


@query("model_stacking_meta", ["meta"], sql=f"""SELECT f.series_id, CAST(f.fold AS BIGINT) AS fold, count(*) AS n, max(w.n) AS n_oof, max(w1) AS w1, max(w2) AS w2,
    avg(abs(my + w1 * (f.pred - m1) / s1 + w2 * (f.naive - m2) / s2 - f.y)) AS stacked_mae, avg(abs((f.pred + f.naive) / 2 - f.y)) AS averaged_mae
    FROM folds f JOIN (SELECT *, {CRAMER.format(a='0.001')} FROM meta) w ON w.series_id = f.series_id AND w.outer_fold = f.fold WHERE f.role = 'validation' GROUP BY 1, 2
""", doubles=["w1", "w2", "stacked_mae", "averaged_mae"])
def model_stacking_meta(spark, sf):
    """MD-13, the meta step alone: ridge over two given bases' predictions on the inner folds of every outer fold."""
    nested = walk_forward.nested_folds(views.scored(spark, sf)).where(F.col("role") == "validation")
    by, bases = ["series_id", "outer"], ["pred", "naive"]
    nested = stage(nested.select("series_id", "outer", "nest", "pred", "naive", "y"))
    oof, fresh = nested.where("nest % 10 > 0"), nested.where("nest % 10 = 0")
    meta = linear.fit_ridge(oof, by, bases, alphas=[linear.META_ALPHA])
    out = walk_forward.apply_meta(fresh, meta, by, bases).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("stacked") - F.col("y"))).alias("stacked_mae"), F.avg(F.abs(F.col("averaged") - F.col("y"))).alias("averaged_mae")
    )
    weights = meta.select(*by, F.col("coef")[0].alias("w1"), F.col("coef")[1].alias("w2")).join(oof.groupBy(*by).agg(F.count(F.lit(1)).alias("n_oof")), by)
    return out.join(weights, by).withColumnRenamed("outer", "fold")


@query("model_stacking")
def model_stacking(spark, sf):
    """MD-13: ridge with shares and boosted trees over four folds, stacked; scores of all four and the meta weights of every fold."""
    out, meta = walk_forward.stacking(stage(model_table(spark, sf)), DAILY, BASE, SHARES, 1, QUERY_ROUNDS)
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("y"))).alias(f"{c}_mae")
    scores = out.groupBy("series_id", "outer").agg(*[mae(c) for c in ("ridge_shares", "trees", "stacked", "averaged")], F.count(F.lit(1)).alias("n"))
    weights = meta.select("series_id", "outer", F.col("coef")[0].alias("w_ridge_shares"), F.col("coef")[1].alias("w_trees"), "intercept", "n_oof")
    return scores.join(weights, ["series_id", "outer"]).withColumnRenamed("outer", "fold")


# --- trees: no SQL to compare with; tests/test_boosting.py replays ensembles one by one --------------

#: Rounds of the ensembles that early stopping does not end (library: 200); README gives the time of the full size.
QUERY_ROUNDS = 20
#: Leaf-wise and depth-wise boosting with fixed rounds.
BOOSTERS = [boosting.Config("leaves_31", 0.05, leaves=31, min_rows=20), boosting.Config("depth_6", 0.05, depth=6)]


def validation_metrics(predicted, by):
    return evaluate.metrics(predicted.where(F.col("part") == boosting.OTHER), by)


@query("model_boosted_trees")
def model_boosted_trees(spark, sf):
    """MD-8: leaf-wise and depth-wise boosting on pooled series over four folds."""
    data = boosting.prepared(fold_table(spark, sf), DAILY.key, BASE, {"train": boosting.FIT}, len(BOOSTERS))
    grown, _ = boosting.grow(data, BOOSTERS, QUERY_ROUNDS)
    return validation_metrics(boosting.predictions(grown, BOOSTERS), ["config", "fold"])


@query("model_random_forest")
def model_random_forest(spark, sf):
    """MD-9: random forest (80 trees of depth 12) on pooled series over four folds."""
    rows, out = stage(fold_table(spark, sf)), None
    for fold in range(1, len(splits.FOLD_CUTS) + 1):
        part = rows.where(F.col("fold") == fold)
        _, va = trees.fit_predict(part.where(F.col("role") == "train"), part.where(F.col("role") == "validation"), BASE, trees.forest())
        out = va if out is None else out.unionByName(va)
    return evaluate.metrics(out, ["series_id", "fold"])


@query("model_boosted_shares")
def model_boosted_shares(spark, sf):
    """MD-12: boosting with and without share columns, plain and tuned, with and without the addend, over four folds."""
    rows = walk_forward.with_shares(model_table_folds(spark, sf), views.FOLD, DAILY, SHARES, 1)
    out = walk_forward.boosting_with_shares(rows, DAILY, BASE, [f"share_high_{n}" for n in SHARES], hours(), QUERY_ROUNDS, search_rounds=QUERY_ROUNDS)
    out = out.where(F.col("role") == "validation")
    high = out.groupBy("model", "fold").agg(F.avg(F.when(F.col("y") >= F.col("p75"), F.col("pred") - F.col("y"))).alias("p75_bias"))
    return evaluate.metrics(out, ["model", "fold"]).join(high, ["model", "fold"])


def model_table_folds(spark, sf):
    return splits.expanding_folds(stage(model_table(spark, sf)))


def searched(spark, sf, configs, rounds=trees.SEARCH_ROUNDS, patience=trees.PATIENCE):
    """Configurations × folds: validation scores, rounds chosen on the tail, mean over folds and the choice."""
    rows = splits.inner_tail(fold_table(spark, sf), F.col("cut"))
    rows = rows.withColumn("inner_role", F.when(F.col("role") == "train", F.col("inner_role")).otherwise("validation"))
    pred, report = boosting.search(rows, DAILY.key, BASE, configs, rounds, patience)
    return boosting.choose(validation_metrics(pred, ["fold", "config"]), report)


@query("model_tuned_boosting")
def model_tuned_boosting(spark, sf):
    """MD-10: the whole search, 24 configurations × 4 folds with 500 rounds, patience 40 and a refit; one row each and the choice."""
    return searched(spark, sf, boosting.search_grid())
