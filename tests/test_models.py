"""Splits, models, corrections, explanations and the archive against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.contract import DAILY, HOURLY, ContractError, LockedSplitError
from panelcast.operators import evaluate, explain, linear, prep, residual, splits, trees
from panelcast.operators.quality import fingerprint
from panelcast.sources.models import read_model, single_model, write_model
from panelcast.sources.tables import SplitCatalog, read_csv, write_splits, write_summary

COLUMNS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def small():
    """400 rows: a nearly collinear pair, a constant column, an empty column, gaps."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6))
    x[:, 1] = x[:, 0] + 1e-4 * rng.normal(size=400)
    x[:, 2] = 0.1
    x[::7, 3] = np.nan
    x[:, 5] = np.nan
    y = 3 * x[:, 0] - 2 * np.nan_to_num(x[:, 3]) + rng.normal(size=400) + 50
    return pd.DataFrame(x, columns=COLUMNS).assign(y=y, g=np.where(np.arange(400) < 250, "a", "b"), i=np.arange(400))


@pytest.fixture(scope="module")
def frame(spark, small):
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLUMNS]
    return spark.createDataFrame(small).select("g", "i", "y", *cols)


def scaler_of(x):
    with np.errstate(all="ignore"):
        med = np.array([np.nanmedian(c) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    filled = np.where(np.isnan(x), med, x)
    sd = filled.std(axis=0)
    sd[sd == 0] = 1
    sd[np.ptp(filled, axis=0) == 0] = 1
    return med, filled.mean(axis=0), sd, (filled - filled.mean(axis=0)) / sd


def test_scaler(frame, small):
    got = {r["g"]: r for r in prep.fit_scaler(frame, ["g"], COLUMNS).collect()}
    for g, part in small.groupby("g"):
        med, mean, sd, _ = scaler_of(part[COLUMNS].to_numpy())
        np.testing.assert_allclose(got[g]["medians"], med, atol=1e-12)
        np.testing.assert_allclose(got[g]["means"], mean, atol=1e-12)
        np.testing.assert_allclose(got[g]["scales"], sd, atol=1e-12)


def test_ridge_matches_closed_form(frame, small):
    alphas = [0.001, 0.3, 10.0]
    got = {(r["g"], r["alpha"]): r for r in linear.fit_ridge(frame, ["g"], COLUMNS, alphas=alphas).collect()}
    for g, part in small.groupby("g"):
        *_, z = scaler_of(part[COLUMNS].to_numpy())
        yc = part["y"] - part["y"].mean()
        for a in alphas:
            want = np.linalg.solve(z.T @ z + a * np.eye(6), z.T @ yc)
            np.testing.assert_allclose(z @ np.array(got[g, a]["coef"]), z @ want, atol=1e-7)
            assert abs(got[g, a]["intercept"] - part["y"].mean()) < 1e-9


def test_subsets_equal_separate_fits(frame):
    scaler = prep.fit_scaler(frame, ["g"], COLUMNS)
    gram = linear.gram(frame, ["g"], COLUMNS, scaler=scaler)
    nested = linear.solve_ridge(gram, ["g"], 6, [0.1], {"part": [0, 3]}).collect()
    alone = {r["g"]: r for r in linear.fit_ridge(frame, ["g"], ["x0", "x3"], alphas=[0.1]).collect()}
    for r in nested:
        np.testing.assert_allclose(np.array(r["coef"])[[0, 3]], alone[r["g"]]["coef"], atol=1e-9)
        assert np.count_nonzero(r["coef"]) == 2


def test_partitioning_does_not_change_the_fit(frame):
    one = linear.fit_ridge(frame.coalesce(1), ["g"], COLUMNS[:1] + COLUMNS[3:5]).orderBy("g").collect()
    many = linear.fit_ridge(frame.repartition(13), ["g"], COLUMNS[:1] + COLUMNS[3:5]).orderBy("g").collect()
    for a, b in zip(one, many):
        np.testing.assert_allclose(a["coef"], b["coef"], atol=1e-10)


def test_weighted_ridge(frame, small):
    got = linear.fit_ridge(frame.withColumn("w", F.when(F.col("y") > 50, 3.0).otherwise(1.0)), ["g"], COLUMNS, alphas=[0.5], weight="w")
    for r in got.collect():
        part = small[small["g"] == r["g"]]
        *_, z = scaler_of(part[COLUMNS].to_numpy())
        w = np.where(part["y"] > 50, 3.0, 1.0)
        ym = np.average(part["y"], weights=w)
        want = np.linalg.solve((z * w[:, None]).T @ z + 0.5 * np.eye(6), (z * w[:, None]).T @ (part["y"] - ym))
        np.testing.assert_allclose(z @ np.array(r["coef"]), z @ want, atol=1e-7)
        assert abs(r["intercept"] - ym) < 1e-9


def test_elastic_net_optimality(frame, small):
    """At the solution the gradient of each zero weight is within the L1 bound, of each other weight on it."""
    cols = ["x0", "x3", "x4"]
    for r in linear.fit_elastic_net(frame, ["g"], cols, alphas=[0.1], l1_ratios=[0.5]).collect():
        part = small[small["g"] == r["g"]]
        *_, z = scaler_of(part[cols].to_numpy())
        w = np.array(r["coef"])
        grad = z.T @ (part["y"] - part["y"].mean() - z @ w) / len(part) - 0.05 * w
        for j in range(3):
            assert abs(grad[j]) <= 0.05 + 1e-3 if w[j] == 0 else abs(grad[j] - 0.05 * np.sign(w[j])) < 1e-3


def test_booster_approaches_ridge(frame, small):
    rows = frame.select("g", "y", "x0", "x4", (F.col("i") - F.when(F.col("g") == "b", 250).otherwise(0)).alias("pos"))
    rows = rows.withColumn("n", F.when(F.col("g") == "a", 250).otherwise(150))
    tail = splits.inner_tail(rows, F.col("n"))
    for r in linear.fit_booster(tail, ["g"], ["x0", "x4"], lambdas=[1e-6], rates=[1.0], rounds=[10, 100]).collect():
        part = small[small["g"] == r["g"]]
        *_, z = scaler_of(part[["x0", "x4"]].to_numpy())
        want = np.linalg.lstsq(z, part["y"] - part["y"].mean(), rcond=None)[0]
        np.testing.assert_allclose(r["coef"], want, atol=1e-4)


def test_frozen_scoring_and_archive(spark, frame, tmp_path):
    model = linear.fit_ridge(frame.where("g = 'a'"), ["g"], COLUMNS)
    write_model(model, str(tmp_path / "model"))
    archived = single_model(read_model(spark, str(tmp_path / "model")))
    a = linear.score(frame.where("g = 'a'"), model, ["g"], COLUMNS).orderBy("i").toPandas()["pred"]
    shuffled = frame.where("g = 'a'").select("i", *COLUMNS[::-1])
    b = linear.score_frozen(shuffled, archived).orderBy("i").toPandas()["pred"]
    np.testing.assert_allclose(a, b, atol=1e-9)
    with pytest.raises(ContractError):
        linear.score_frozen(frame.drop("x3"), archived)


def test_shap_adds_up(frame):
    model = linear.fit_ridge(frame, ["g"], COLUMNS)
    gaps = explain.additivity(linear.score(frame, model, ["g"], COLUMNS), model, ["g"], COLUMNS).collect()
    assert max(r["max_gap"] for r in gaps) < 1e-8


def test_permutation_importance(frame, small):
    model = linear.fit_ridge(frame, ["g"], ["x0", "x4"]).withColumn("addend", F.lit(0.0))
    rows = frame.withColumn("o", F.col("i") - F.when(F.col("g") == "b", 250).otherwise(0))
    out = explain.permutation_importance(rows, model, ["g"], ["x0", "x4"], "o").toPandas()
    assert len(out) == 4
    top = out[out["feature"] == "x0"]["mae_increase"]
    assert (top > 0.5).all() and (out[out["feature"] == "x4"]["mae_increase"] < top.min()).all()


def test_fold_arithmetic(spark):
    """Cuts of a 29,804-step series and of the 35,064-step split."""
    n = 29804
    df = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("n_steps"))
    folds = splits.expanding_folds(df).groupBy("fold", "role").count().toPandas().set_index(["fold", "role"])["count"]
    assert [(folds[i, "train"], folds[i, "validation"]) for i in (1, 2, 3, 4)] == [(14902, 2980), (17882, 2980), (20862, 2981), (23843, 5961)]
    inner = splits.expanding_folds(df.where("pos < 14902"), splits.INNER_FOLD_CUTS, F.lit(14902))
    assert inner.where("role = 'validation'").count() == 7451
    m = 35064
    full = spark.range(m).select(F.col("id").alias("pos"), F.lit(m).cast("long").alias("n_steps"))
    sizes = splits.chronological_split(full).groupBy("split").count().toPandas().set_index("split")["count"]
    assert (sizes["train"], sizes["validation"], sizes["test"]) == (24544, 5260, 5260)


def error_rows(spark, errors, fold=1, start=0):
    rows = [("s", fold, start + i, float(100 + e), 100.0) for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "series_id string, fold int, pos long, y double, pred double")


def test_ar1_fit_and_blocks(spark):
    rng = np.random.default_rng(4)
    r = np.zeros(2000)
    for t in range(1, 2000):
        r[t] = 0.8 * r[t - 1] + rng.normal()
    df = error_rows(spark, r).withColumn("error", F.col("y") - F.col("pred"))
    got = residual.fit_phi(df, ["series_id", "fold"], "pos").first()
    tail = r[-1440:]
    assert abs(got["phi"] - tail[1:] @ tail[:-1] / (tail[:-1] @ tail[:-1])) < 1e-9 and abs(got["last_error"] - r[-1]) < 1e-9
    few = residual.fit_phi(df.where("pos < 2"), ["series_id", "fold"], "pos").first()
    assert few["phi"] == 0.0

    e = rng.normal(size=60)
    state = spark.createDataFrame([("s", 1, 0.9, 2.0)], "series_id string, fold int, phi double, last_error double")
    block = error_rows(spark, e).withColumn("offset", F.col("pos"))
    out = residual.block_correction(block, ["series_id", "fold"], state, "offset").orderBy("pos").toPandas()["ar_add"]
    want, s = [], 2.0
    for b in range(0, 60, 24):
        part = e[b:b + 24]
        want += [0.9 ** k * s for k in range(1, len(part) + 1)]
        s = part[-1]
    np.testing.assert_allclose(out, want, atol=1e-9)


def test_ar_ladder_and_block_forecast(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(size=400)
    for t in range(25, 400):
        r[t] += 0.5 * r[t - 1] + 0.3 * r[t - 24]
    cut = 350
    df = error_rows(spark, r).withColumn("offset", F.col("pos") - cut)
    train = df.where("offset < 0").withColumn("error", F.col("y") - F.col("pred"))
    by = ["series_id", "fold"]
    ladder = residual.fit_ar_ladder(residual.ar_equations(train, by, "pos"), by)
    fitted = {x["model"]: np.array(x["coef"]) for x in ladder.collect()}
    z = r[:cut]
    design = np.column_stack([z[25 - k: cut - k] for k in (1, 24, 25)])
    np.testing.assert_allclose(fitted["SAR1x24"], np.linalg.lstsq(design, z[25:], rcond=None)[0], atol=1e-8)
    out = residual.ar_block_forecast(df, by, ladder, "offset").toPandas()
    for model, lags in residual.AR_CANDIDATES.items():
        got = out[out["model"] == model].sort_values("pos")["ar_add"].to_numpy()
        path = []
        for start in range(cut, 400, 24):
            known = list(r[:start])
            for _ in range(min(24, 400 - start)):
                known.append(sum(c * known[-k] for c, k in zip(fitted[model], lags)))
            path += known[start:]
        np.testing.assert_allclose(got, path, atol=1e-8)


def test_weighted_addend_far_from_the_epoch(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=3000)
    df = error_rows(spark, e, start=10_000_000).withColumn("role", F.lit("train"))
    got = residual.weighted_addend(df, ["series_id"], F.col("pos").cast("double")).first()["addend"]
    w = np.exp((np.arange(3000) - 2999) / 720.0)
    assert abs(got - np.average(e, weights=w)) < 1e-9


def test_levels_at_the_edges(spark):
    df = spark.createDataFrame([("s", float(v), float(v)) for v in (1, 2, 3, 4, 5)], "g string, y double, pred double")
    edges = spark.createDataFrame([("s", 2.0, 3.0, 4.0)], "g string, q0_25 double, q0_5 double, q0_75 double")
    got = {r["level"]: r["n"] for r in evaluate.error_by_level(df, edges, ["g"]).collect()}
    assert got == {"P25_below": 2, "P25_P50": 1, "P50_P75": 1, "P75_above": 1}


def test_smape_without_denominator(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "y double, pred double")
    assert evaluate.metrics(df, []).first()["smape"] is None
    assert evaluate.metrics(df, [], zero_policy="zero").first()["smape"] == 0.0


def test_locked_split(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.0), ("validation", 2.0), ("test", 3.0)], "split string, y double")
    write_splits(df, str(tmp_path / "splits"), ["y"], forbidden=["price actual"])
    with pytest.raises(ContractError):
        write_splits(df.withColumn("price actual", F.lit(1)), str(tmp_path / "other"), ["y"], forbidden=["price actual"])
    catalog = SplitCatalog(spark, str(tmp_path / "splits"))
    dev = catalog.read("train", "validation")
    catalog.assert_not_scanned(spark.read.parquet(str(tmp_path / "splits" / "split=train")))
    assert dev.count() == 2
    with pytest.raises(LockedSplitError):
        catalog.read("test")
    assert catalog.locked_reads == 1
    catalog.release()
    assert catalog.read("test").first()["y"] == 3.0
    with pytest.raises(LockedSplitError):
        catalog.assert_not_scanned(spark.read.parquet(str(tmp_path / "splits" / "split=test")))


def test_csv_and_summary(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,v\na,1.5\nb,NaN\nc,\n")
    rows = read_csv(spark, str(tmp_path / "in.csv"), "name string, v double").orderBy("name").collect()
    assert [r["v"] for r in rows] == [1.5, None, None]
    write_summary(spark.createDataFrame([(2,), (1,)], "k int"), str(tmp_path / "out"), ["k"])
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().split()
    assert text == ["k", "1", "2"]


def test_fingerprint_ignores_order(spark, frame):
    a = fingerprint(frame.select("i", "y")).first()
    b = fingerprint(frame.select("i", "y").repartition(7)).first()
    c = fingerprint(frame.select("i", (F.col("y") + 1e-9).alias("y"))).first()
    assert a == b and a != c


def test_tree_round_choice():
    assert trees.best_rounds([5, 4, 3, 4, 5, 6], patience=2, minimum=1) == 3
    assert trees.best_rounds([5, 4, 3], patience=2, minimum=20) == 20
    assert len(trees.depth_grid()) == 12 and len(trees.leaf_grid()) == 12


def test_trees_learn(frame):
    rows = frame.select("y", "x0", "x3", "i")
    fit, stop, val = rows.where("i < 250"), rows.where("i >= 250 and i < 320"), rows.where("i >= 320")
    pred, n = trees.tuned_boosting(fit, stop, val, ["x0", "x3"], {"rate": 0.3, "depth": 2}, rounds=6, patience=3)
    assert n >= trees.MIN_ROUNDS or n <= 6
    m = evaluate.metrics(pred, []).first()
    assert m["n"] == 80 and m["r2"] > 0.3


def test_specs_are_units():
    assert (HOURLY.step_seconds, DAILY.step_seconds) == (3600, 86400)


def test_gram_of_many_groups_holds_few(spark, monkeypatch):
    """10,000 groups in a batch with room for 40 matrices; NULL keys, a hot group and several key columns."""
    monkeypatch.setattr(linear, "HELD_CELLS", 40 * 10)
    rng = np.random.default_rng(12)
    n = 30_000
    key = np.where(np.arange(n) % 3 == 0, 7, np.arange(n) % 10_000)  # one group holds a third of all rows
    pdf = pd.DataFrame({"g": key, "side": np.where(key % 2 == 0, "a", None), "x1": rng.normal(size=n), "x2": rng.normal(size=n), "y": rng.normal(size=n)})
    df = spark.createDataFrame(pdf, "g long, side string, x1 double, x2 double, y double")
    df = df.coalesce(1)
    got = {(r.g, r.side): r for r in linear.gram(df, ["g", "side"], ["x1", "x2"]).collect()}
    want = pdf.groupby(["g", "side"], dropna=False)
    assert len(got) == want.ngroups
    for (g, side), rows in [*list(want)[:300], ((7, None), pdf[pdf.g == 7])]:
        side = side if isinstance(side, str) else None
        z = np.column_stack([rows[["x1", "x2", "y"]].to_numpy(), np.ones(len(rows))])
        np.testing.assert_allclose(got[g, side].cells, (z.T @ z)[np.triu_indices(4)], rtol=1e-9, atol=1e-9)
        assert got[g, side].n == len(rows)


def test_weights_from_two_grams_equal_separate_weighted_fits(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 200), "x1": rng.normal(size=400), "x2": rng.normal(size=400)})
    pdf["y"] = pdf.x1 + rng.normal(size=400) + np.where(pdf.x2 > 1, 4.0, 0.0)
    df = spark.createDataFrame(pdf).withColumn("_high", F.col("y") >= 1.5)
    from panelcast.operators.prep import fit_scaler

    scaler = fit_scaler(df, ["k"], ["x1", "x2"])
    grams = linear.gram(df, ["k", "_high"], ["x1", "x2"], scaler=scaler, scaler_by=["k"])
    got = {(r.k, r.high_weight): r for r in linear.solve_weights(grams, ["k"], 2, (1.0, 2.0, 3.0)).collect()}
    for w in (1.0, 2.0, 3.0):
        one = linear.fit_ridge(df.withColumn("w", F.when(F.col("_high"), w).otherwise(1.0)), ["k"], ["x1", "x2"], weight="w")
        for r in one.collect():
            np.testing.assert_allclose(got[r.k, w].coef, r.coef, rtol=1e-9)
            assert got[r.k, w].intercept == pytest.approx(r.intercept)


def test_booster_stops_where_a_replay_stops(spark):
    from panelcast.operators.prep import fit_scaler
    from panelcast.operators.trees import best_rounds

    rng = np.random.default_rng(21)
    n = 240
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], n // 2), "i": np.tile(np.arange(n // 2), 2), **{f"x{j}": rng.normal(size=n) for j in range(3)}})
    pdf["y"] = pdf.x0 - 2 * pdf.x1 + np.where(pdf.k == "a", 0.1, 3.0) * rng.normal(size=n)
    pdf["inner_role"] = np.where(pdf.i < 90, "fit", "stop")
    pdf.loc[(pdf.k == "a") & (pdf.i >= 90), "y"] *= 0.4  # the tail wants smaller weights: stops early
    columns, grid = ["x0", "x1", "x2"], linear.booster_grid((1e-6, 1e-2, 0.5), (0.05, 0.3))
    assert len(linear.booster_grid()) == 36
    df = spark.createDataFrame(pdf)
    got = linear.fit_booster(df, ["k"], columns, lambdas=(1e-6, 1e-2, 0.5), rates=(0.05, 0.3), rounds=60, patience=5, least=3).collect()
    assert len(got) == 2 * len(grid) and len({(r.k, r.reg_lambda, r.rate, r.selector) for r in got}) == len(got)
    scalers = {r.k: r for r in fit_scaler(df, ["k"], columns).collect()}
    stopped = set()
    for r in got:
        part, s = pdf[pdf.k == r.k], scalers[r.k]
        z = (part[columns].to_numpy() - np.array(s.means)) / np.array(s.scales)
        y, fit = part.y.to_numpy(), (part.inner_role == "fit").to_numpy()

        def path(rows):
            yc = y[rows] - y[rows].mean()
            return linear.booster_path(z[rows].T @ z[rows] / rows.sum(), z[rows].T @ yc / rows.sum() - z[rows].mean(axis=0) * yc.mean(), (r.reg_lambda, r.rate, r.selector), 60)

        losses = [np.abs(z[~fit] @ w + y[fit].mean() - y[~fit]).mean() for w in path(fit)]
        assert r.rounds == best_rounds(losses, patience=5, minimum=3)
        assert r.stop_mae == pytest.approx(min(losses))
        np.testing.assert_allclose(r.coef, path(np.ones(len(part), bool))[r.rounds - 1], rtol=1e-7, atol=1e-9)
        stopped.add(r.rounds)
    assert len(stopped) > 2


def test_stopping_round_in_sql(spark):
    from panelcast.operators.trees import best_rounds

    rng = np.random.default_rng(22)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=30).cumsum() ** 2, 1)]) for i in range(40)] + [(40, [1.0] * 30), (41, [2.0])]
    got = spark.createDataFrame(rows, "i int, losses array<double>").select("i", linear.stopping_round(F.col("losses"), 6, 1).alias("at")).collect()
    assert {r.i: r["at"] for r in got} == {i: best_rounds(v, 6, 1) for i, v in rows}
