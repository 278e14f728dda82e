"""Lineage carried by columns and the guard that compares it with declarations (FE-18)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.contract import HOURLY, LeakageError
from panelcast.operators import lineage
from panelcast.operators.declared import Declared
from panelcast.operators.features import History
from panelcast.operators.manifest import FeatureSpec, Manifest, guard_features
from panelcast.sources.staging import stage

IDS = ["series_id", "ts"]


@pytest.fixture(scope="module")
def panel(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(hours=i), float(i), float(-i), 1.0) for i in range(60)]
    return lineage.observed(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double, load double, n double"), ["y", "load", "n"])


def declare(name, group="historical_target", steps=24):
    return Manifest([FeatureSpec(name, "y", group, str(steps), "shift", "prior_auction_only", name, steps)])


def matrix(panel, history):
    return history.apply(panel).select(*IDS, *history.lineage)


def test_lag_shorter_than_declared_is_refused(panel):
    short, right = (matrix(panel, History(HOURLY).lag("y", k, "x")) for k in (1, 24))
    assert guard_features(right, declare("x"), IDS) == ["x"]
    with pytest.raises(LeakageError, match="x reads y 1 steps back, declared are 24"):
        guard_features(short, declare("x"), IDS)
    window = matrix(panel, History(HOURLY).rolling("y", 7, 2, "x"))
    with pytest.raises(LeakageError, match="2 steps back"):
        guard_features(window, declare("x"), IDS)
    share = matrix(panel, History(HOURLY).share_above("y", 1.0, 7, 24, "x"))
    assert guard_features(share, declare("x", "target_level"), IDS) == ["x"]


def test_lineage_survives_selection_renames_joins_and_staging(panel):
    df = matrix(panel, History(HOURLY).lag("y", 1, "x"))
    for other in (df.withColumnRenamed("x", "z"), df.select(*IDS, F.col("x").alias("z")), stage(df.withColumnRenamed("x", "z")), df.join(panel.select(*IDS), IDS).withColumnRenamed("x", "z")):
        assert lineage.of(other, "z") == {"y": 1}
        with pytest.raises(LeakageError):
            guard_features(other.select(*IDS, "z"), declare("z"), IDS)


def test_history_without_lineage_and_renamed_measurements_are_refused(panel):
    with pytest.raises(LeakageError, match="has no lineage"):
        guard_features(panel.select(*IDS, (F.col("y") * 2).alias("x")), declare("x"), IDS)
    with pytest.raises(LeakageError, match="reads load 0 steps back"):
        guard_features(panel.select(*IDS, F.col("load").alias("hour")), declare("hour", "calendar", 0), IDS)
    calendar = panel.select(*IDS, F.hour("ts").alias("hour"))
    assert guard_features(calendar, declare("hour", "calendar", 0), IDS) == ["hour"]


def test_derived_columns_take_the_least_offset_of_what_they_refer_to(panel):
    h = History(HOURLY).lag("y", 24, "a").lag("y", 1, "b").lag("load", 48, "c")
    df = lineage.derived(h.apply(panel), {"mean": (F.col("a") + F.col("b")) / 2, "far": F.col("c") - F.col("a"), "free": F.lit(1.0)})
    assert lineage.of(df, "mean") == {"y": 1} and lineage.of(df, "far") == {"load": 48, "y": 24} and lineage.of(df, "free") == {}
    assert guard_features(df.select(*IDS, "far"), declare("far"), IDS) == ["far"]
    with pytest.raises(LeakageError):
        guard_features(df.select(*IDS, "mean"), declare("mean"), IDS)
    assert lineage.references(panel, F.col("y") + F.sin("n")) == ["y", "n"]


def test_declared_once(panel):
    plan = Declared(HOURLY)
    plan.lags("y", "y", (24, 48), "y", "historical_target", "shift", "prior_auction_only", "value")
    plan.rolling("m", "y", 6, 24, "historical_target", "prior_auction_only", "mean")
    plan.share("s", "y", 3.0, 6, 24, "target_level", "prior_auction_only", "share")
    df = plan.history.apply(panel).select(*IDS, *plan.manifest.names)
    assert guard_features(df, plan.manifest, IDS, ["y", "load", "n"]) == ["y_lag_24", "y_lag_48", "m", "s"]
    assert {s.feature_name: s.lag_steps for s in plan.manifest.specs} == {k: v[1] for k, v in plan.history.lineage.items()}
