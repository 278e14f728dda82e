"""Checks and defaults that must not depend on which columns are read or how large a group is."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.contract import HOURLY, ContractError
from panelcast.functions.quantiles import keyed_quantiles
from panelcast.operators import clean, forecast, linear, residual
from panelcast.operators.grid import densify
from panelcast.sources.tables import nan_as_null

AT = dt.datetime(2020, 1, 1)


def panel(spark, offsets, key="a"):
    rows = [(key, None if m is None else AT + dt.timedelta(minutes=m), 1.0) for m in offsets]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_quantiles_see_finite_values_at_any_size(spark, hot_rows):
    values = [1.0, 2.0, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    (row,) = keyed_quantiles(df, ["k"], "v", [0.5], hot_rows).collect()
    assert (row.n, row.q0_5) == (2, 1.5)


@pytest.mark.parametrize("bad", [[0, 60, 90, 120], [0, None, 60]])
def test_densify_refuses_rows_without_a_place(spark, bad):
    for read in (lambda d: d.count(), lambda d: d.select("series_id").collect()):
        with pytest.raises(PySparkException):
            read(densify(panel(spark, bad), HOURLY))
    with pytest.raises(PySparkException):
        densify(panel(spark, [0, 60], key=None), HOURLY).count()
    assert densify(panel(spark, [0, 180]), HOURLY).count() == 4


def test_one_to_one_join_refuses_duplicates_whatever_is_read(spark):
    once = panel(spark, [0, 60]).withColumnRenamed("y", "l")
    twice = panel(spark, [0, 60, 60]).withColumnRenamed("y", "r")
    for join in (clean.one_to_one_left(once, twice, ["series_id", "ts"]), clean.one_to_one_left(twice.withColumnRenamed("r", "x"), once, ["series_id", "ts"])):
        for read in (lambda d: d.count(), lambda d: d.select("ts").collect(), lambda d: d.collect()):
            with pytest.raises(PySparkException):
                read(join)
    assert clean.one_to_one_left(once, once.withColumnRenamed("l", "r"), ["series_id", "ts"]).count() == 2


def errors(spark):
    rows = [("a", i, float(i % 3) - 1.0) for i in range(50)] + [("none", i, None) for i in range(50)]
    return spark.createDataFrame(rows, "series_id string, pos long, error double")


def test_group_without_errors_keeps_its_forecasts(spark):
    state = residual.fit_phi(errors(spark), ["series_id"], "pos")
    by = {r.series_id: r for r in state.collect()}
    assert (by["none"].phi, by["none"].last_error) == (0.0, 0.0) and by["a"].phi != 0.0
    scored = spark.createDataFrame([(s, i, 5.0, 4.0) for s in ("a", "none", "unseen") for i in range(30)], "series_id string, offset long, pred double, y double")
    out = residual.block_correction(scored, ["series_id"], state, "offset").groupBy("series_id").agg(F.count("corrected").alias("n"), F.max(F.abs(F.col("corrected") - 5.0)).alias("moved"))
    got = {r.series_id: (r.n, r.moved) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 30, "none": 30, "unseen": 30} and got["none"][1] == 0.0 and got["unseen"][1] == 0.0


@pytest.mark.parametrize("method", residual.METHODS)
def test_corrections_keep_groups_without_train_rows(spark, method):
    rows = [("a", "train", i, 2.0 + i % 4, 1.0 + i % 4) for i in range(40)] + [(s, "validation", 50, 3.0, 2.0) for s in ("a", "new")]
    df = spark.createDataFrame(rows, "series_id string, role string, h int, y double, pred double")
    got = {(r.series_id, r.role): r.corrected for r in residual.correct(df, ["series_id"], method, F.col("h").cast("double")).collect()}
    assert got["new", "validation"] == 2.0 and ("a", "validation") in got


def test_scores_of_a_group_without_model_are_null(spark):
    rows = [("a", float(i), 2.0 * i) for i in range(30)]
    models = linear.fit_ridge(spark.createDataFrame(rows, "series_id string, x double, y double"), ["series_id"], ["x"])
    got = linear.score(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "series_id string, x double"), models, ["series_id"], ["x"]).collect()
    assert {r.series_id: r.pred is None for r in got} == {"a": False, "b": True}


def test_short_tail_keeps_weight_one(spark):
    rows = [(s, i, float(i % 7), float(i % 7) + (5.0 if i % 11 == 0 else 0.0), "fit" if i < cut else "stop") for s, cut in (("long", 60), ("short", 90), ("none", 100)) for i in range(100)]
    df = spark.createDataFrame(rows, "series_id string, pos int, x double, y double, inner_role string").withColumn("t", F.lit(6.0))
    got = {r.series_id: r.high_weight for r in linear.choose_weight(df, ["series_id"], ["x"], "t").collect()}
    assert set(got) == {"long", "short", "none"} and got["short"] == got["none"] == 1.0


def test_nan_becomes_null_at_the_scan(spark):
    df = nan_as_null(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, v double"))
    assert [r.v for r in df.orderBy("i").collect()] == [None, 1.0]


def test_forecast_refuses_an_incomplete_archive(spark):
    model = {"names": ["x"], "medians": [0.0], "means": [0.0], "scales": [1.0], "coef": [1.0], "intercept": 0.0, "addend": 1.0, "phi": 0.5}
    with pytest.raises(ContractError):
        forecast.assumed_forecast(panel(spark, [0]), HOURLY, model, "m")


def test_forecasts_of_a_panel_equal_single_models(spark):
    rows = [(s, AT + dt.timedelta(hours=h), f"h+{h}", h, AT, float(h), 2.0 - h) for s in ("a", "b") for h in (1, 2, 3)]
    inputs = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, forecast_horizon string, h int, origin timestamp_ntz, x1 double, x2 double")
    past = spark.createDataFrame([(s, float(i % 5), float(i % 3), k * (i % 5) - (i % 3) + k) for s, k in (("a", 1.0), ("b", 3.0)) for i in range(40)], "series_id string, x1 double, x2 double, y double")
    models = linear.fit_ridge(past, ["series_id"], ["x1", "x2"])
    archive = models.withColumns({"addend": F.lit(0.5), "phi": F.when(F.col("series_id") == "a", 0.5).otherwise(-0.5), "last_error": F.lit(2.0)})
    got = {(r.series_id, r.forecast_horizon): r.y_pred for r in forecast.assumed_forecasts(inputs, HOURLY, archive, ["x1", "x2"], "m").collect()}
    for row in archive.collect():
        one = forecast.assumed_forecast(inputs.where(F.col("series_id") == row.series_id), HOURLY, row.asDict(), "m").collect()
        assert {(r.series_id, r.forecast_horizon): pytest.approx(r.y_pred) for r in one} == {k: v for k, v in got.items() if k[0] == row.series_id}
    with pytest.raises(PySparkException):
        forecast.assumed_forecasts(inputs, HOURLY, archive.where("series_id = 'a'"), ["x1", "x2"], "m").collect()
