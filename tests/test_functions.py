"""Quantiles, chunked windows, cleaning and time rules against NumPy and pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.contract import HOURLY, ContractError, LeakageError
from panelcast.functions.numeric import circular_mean, safe_ratio, strict_max, total_skip_null
from panelcast.functions.quantiles import keyed_quantiles, quantiles
from panelcast.functions.timefn import civil, parse_instant
from panelcast.operators import clean, features, grid, quality
from panelcast.operators.features import History

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
EPOCH = dt.datetime(2020, 1, 1)


def series_frame(spark, values, name="s", start=0):
    rows = [(name, EPOCH + dt.timedelta(hours=start + i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


@SLOW
@given(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.sampled_from([0.0, -0.0, 1e-300, -5.0, 7.0, 1e12])), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", None)], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    row = quantiles(df, ["g"], "v", probs).collect()
    assert [r["g"] for r in row] == ["a"]
    np.testing.assert_allclose([row[0][c] for c in row[0].__fields__[2:]], np.quantile(values, probs), rtol=1e-12, atol=1e-9)


def test_hot_groups_take_the_distributed_path(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot"] * 500 + [f"c{i}" for i in range(40)] * 3, "v": rng.normal(size=620)})
    got = keyed_quantiles(spark.createDataFrame(pdf), ["k"], "v", [0.5], hot_rows=100).toPandas().set_index("k")["q0_5"]
    want = pdf.groupby("k")["v"].median()
    np.testing.assert_allclose(got.sort_index(), want.sort_index(), rtol=1e-12)


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_history_does_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(2)
    y = pd.Series(rng.normal(size=90))
    y[[5, 40]] = np.nan
    df = series_frame(spark, [None if np.isnan(v) else v for v in y])
    h = History(HOURLY).lag("y", 4).rolling("y", 6, 4, "m", "s").share_above("y", 0.1, 5, 4, "f")
    out = h.apply(df, chunk=chunk).toPandas().sort_values("ts").reset_index(drop=True)
    hist = y.shift(4)
    flag = (hist > 0.1).astype(float).where(hist.notna())
    np.testing.assert_allclose(out["y_lag_4"], hist)
    np.testing.assert_allclose(out["m"], hist.rolling(6, min_periods=6).mean(), atol=1e-12)
    np.testing.assert_allclose(out["s"], hist.rolling(6, min_periods=6).std(ddof=0), atol=1e-12)
    np.testing.assert_allclose(out["f"], flag.rolling(5, min_periods=5).mean(), atol=1e-12)
    assert len(out) == 90


def test_future_values_never_change_a_feature(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=80)
    changed = y.copy()
    changed[60:] += 100
    h = lambda: History(HOURLY).lag("y", 24).rolling("y", 10, 24, "m", "s").share_above("y", 0.0, 10, 24, "f")
    a, b = (h().apply(series_frame(spark, v)).toPandas().sort_values("ts").reset_index(drop=True) for v in (y, changed))
    cols = ["y_lag_24", "m", "s", "f"]
    # hour t only knows values up to t − 24
    pd.testing.assert_frame_equal(a.loc[: 60 + 23, cols], b.loc[: 60 + 23, cols])


def test_lag_must_look_back(spark):
    for k in (0, -1):
        with pytest.raises(LeakageError):
            History(HOURLY).lag("y", k)


def brute_runs(values):
    out, i = [], 0
    while i < len(values):
        if values[i] is None:
            j = i
            while j < len(values) and values[j] is None:
                j += 1
            out.append((i, j, j - i, i == 0 or j == len(values)))
            i = j
        else:
            i += 1
    return out


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=2, max_size=40).filter(lambda v: any(x is not None for x in v)), st.sampled_from([2, 5, 4096]))
def test_missing_runs_and_filling(spark, values, chunk):
    df = grid.densify(series_frame(spark, values), HOURLY)
    runs = clean.missing_runs(df, HOURLY, ["y"], chunk).collect()
    assert sorted((r["start_pos"], r["end_pos"], r["length"], r["is_edge"]) for r in runs) == brute_runs(values)
    got = [r["y"] for r in clean.fill_short_gaps(df, HOURLY, ["y"], 3).orderBy("ts").collect()]
    want = pd.Series([np.nan if v is None else float(v) for v in values])
    line = want.interpolate(limit_area="inside")
    for a, b, n, edge in brute_runs(values):
        if not edge and n <= 3:
            want[a:b] = line[a:b]
    np.testing.assert_allclose(np.array([np.nan if v is None else v for v in got]), want, atol=1e-9)


def test_densify_steps_and_gaps(spark):
    df = series_frame(spark, [1, 2, 3]).unionByName(series_frame(spark, [4], start=6))
    out = grid.densify(df, HOURLY).orderBy("ts").collect()
    assert [r["pos"] for r in out] == list(range(7)) and [r["y"] for r in out] == [1, 2, 3, None, None, None, 4]
    assert grid.missing_steps(df, HOURLY).count() == 3
    assert grid.step_report(df, HOURLY, chunk=2).collect()[0]["bad_steps"] == 1
    half = df.unionByName(spark.createDataFrame([("s", EPOCH + dt.timedelta(minutes=30), 9.0)], df.schema))
    assert grid.off_grid_rows(half, HOURLY).count() == 1
    assert grid.step_report(half, HOURLY).collect()[0]["bad_steps"] == 3


def test_index_checks_find_problems(spark):
    df = series_frame(spark, [1, 2]).unionByName(series_frame(spark, [3], start=3)).unionByName(series_frame(spark, [3], start=3))
    df = df.unionByName(spark.createDataFrame([("s", None, 1.0)], df.schema))
    got = {r["check_name"]: (r["ok"], r["detail"]) for r in quality.index_checks(df, HOURLY, 4).collect()}
    assert got == {"unparsed": (False, 1), "duplicates": (False, 1), "unique_count": (False, 3), "step": (False, 1), "missing": (False, 1)}


def test_daylight_saving(spark):
    text = ["2015-01-01 00:00:00+01:00", "2015-03-29 01:00:00+01:00", "2015-03-29 03:00:00+02:00", "2015-10-25 02:00:00+02:00",
            "2015-10-25 02:00:00+01:00", "2018-10-28 02:00:00+01:00", "not a time", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").withColumn("utc", parse_instant(F.col("t")))
    rows = df.withColumn("local", civil(F.col("utc"))).collect()
    for r in rows[:6]:
        stamp = pd.Timestamp(r["t"])
        assert r["utc"] == stamp.tz_convert("UTC").tz_localize(None).to_pydatetime()
        assert r["local"] == stamp.tz_convert("Europe/Madrid").tz_localize(None).to_pydatetime()
    assert rows[6]["utc"] is None and rows[7]["utc"] is None


@SLOW
@given(st.lists(st.floats(0, 359), min_size=1, max_size=6), st.floats(0, 359))
def test_circular_mean_turns_with_its_input(spark, angles, turn):
    x, y = np.mean(np.cos(np.deg2rad(angles))), np.mean(np.sin(np.deg2rad(angles)))
    if np.hypot(x, y) < 1e-3:
        return
    df = spark.createDataFrame([(float(a), float((a + turn) % 360)) for a in angles] + [(None, None)], "a double, b double")
    r = df.agg(circular_mean(F.col("a")).alias("a"), circular_mean(F.col("b")).alias("b")).first()
    assert 0 <= r["a"] < 360 + 1e-9
    gap = (r["a"] + turn - r["b"]) % 360
    assert min(gap, 360 - gap) < 1e-6


def test_collapse_rules(spark):
    rows = [("a", 350.0, 9, 1.0), ("a", 10.0, 10, 2.0), ("a", None, 9, 9.0), ("a", None, 10, 3.0), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "k string, d double, code int, v double").withColumn("w", F.col("v"))
    out = {r["k"]: r for r in clean.collapse(df, ["k"], {"d": "circular_mean", "code": "mode", "v": "median", "w": "max"}).collect()}
    assert min(out["a"]["d"], 360 - out["a"]["d"]) < 1e-9
    # "10" sorts before "9"
    assert out["a"]["code"] == 10 and out["a"]["v"] == 2.5 and out["a"]["w"] == 9.0
    assert out["b"]["code"] is None and out["b"]["v"] is None
    again = clean.collapse(spark.createDataFrame([(k, r["v"]) for k, r in out.items()], "k string, v double"), ["k"], {"v": "median"})
    assert {r["k"]: r["v"] for r in again.collect()} == {k: r["v"] for k, r in out.items()}


def test_duplicate_classes(spark):
    rows = [(1, 1.0, "x", "p"), (1, 1.0, "x", "p"), (2, 1.0, "x", "p"), (2, 1.0, "y", "p"), (3, 1.0, "x", "p"), (3, None, "x", "p"),
            (4, None, "x", "p"), (4, None, "x", "q"), (5, 2.0, "x", "p")]
    df = spark.createDataFrame(rows, "k int, v double, c string, o string")
    got = {r["kind"]: r["groups"] for r in quality.duplicate_classes(df, ["k"], ["v"], ["c"], ["o"]).collect()}
    assert got == {"exact_copy": 1, "numeric_same_category_differs": 1, "numeric_differs": 1, "other": 1}


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None), (1.0, 0.0), (1.0, -1.0), (float("inf"), 2.0)], "a double, b double")
    out = df.select(safe_ratio(F.col("a"), F.col("b")).alias("r"), total_skip_null([F.col("a"), F.col("b")]).alias("t"), strict_max([F.col("a"), F.col("b")]).alias("m")).collect()
    assert [r["r"] for r in out] == [0.5, None, None, None, None, None]
    assert [r["t"] for r in out][:4] == [3.0, 2.0, None, 1.0]
    assert [r["m"] for r in out][:3] == [2.0, None, None]


def test_one_to_one_join_rejects_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 5.0)], "k int, z double")
    assert clean.one_to_one_left(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key on the right"):
        clean.one_to_one_left(left, right.unionByName(right), ["k"]).collect()
    with pytest.raises(ContractError):
        clean.assert_same_keys(left, right, ["k"])


def test_clean_measures_protects_the_target(spark):
    df = grid.densify(series_frame(spark, [1, None, 3]), HOURLY)
    with pytest.raises(ContractError):
        clean.clean_measures(df, HOURLY, ["y"], ["y"])
    with pytest.raises(ContractError):
        clean.pivot_entities(df, ["ts"], "series_id", ["New York"], ["y"])


def test_shares_at_equal_the_grid_feature(spark):
    rng = np.random.default_rng(5)
    hist = series_frame(spark, rng.normal(size=70))
    times = series_frame(spark, [0] * 10, start=65).select("series_id", "ts")
    got = features.shares_at(hist, times, HOURLY, "y", 0.0, {"f": 20}, 24).orderBy("ts").toPandas()["f"]
    y = hist.orderBy("ts").toPandas()["y"]
    want = [np.mean(y[t - 24 - 19: t - 24 + 1] > 0.0) for t in range(65, 75)]
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("chunk", [None, 40])
def test_windows_of_every_length(spark, chunk):
    """Moments merged from block ends and shares from counts equal pandas, with gaps, missing steps, spikes and long windows."""
    rng = np.random.default_rng(9)
    n = 400
    y = rng.normal(size=n)
    y[50] = 1e12  # a spike must not cost later windows their digits
    y[200:240] = 3.25  # constant stretch: deviation exactly 0
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = pd.DataFrame({"series_id": "s", "ts": ts, "y": y})
    pdf = pdf.drop(index=[120, 121, 300])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("y", F.when(F.hour("ts") + F.dayofyear("ts") * 24 != 90 + 24, F.col("y")))
    h = History(HOURLY)
    for w in (1, 2, 7, 30, 100):
        for d in (1, 24):
            h.rolling("y", w, d, f"m_{w}_{d}", f"s_{w}_{d}").share_above("y", 0.2, w, d, f"f_{w}_{d}")
    assert h.lineage["m_7_24"] == ("y", 24, 30)
    got = h.apply(df, chunk).orderBy("ts").toPandas().set_index("ts").reindex(ts)
    full = got["y"]
    for w in (1, 2, 7, 30, 100):
        for d in (1, 24):
            parts = [full.shift(d + k) for k in range(w)]
            table = pd.concat(parts, axis=1)
            whole = table.notna().all(axis=1)
            here = got["series_id"].notna()
            for name, want in (("m", table.mean(axis=1)), ("s", table.std(axis=1, ddof=0)), ("f", (table > 0.2).mean(axis=1))):
                a, b = got[f"{name}_{w}_{d}"][here], want.where(whole)[here]
                assert (a.isna() == b.isna()).all()
                np.testing.assert_allclose(a.dropna(), b.dropna(), rtol=1e-9, atol=1e-12)
            if w == 7:
                assert got[f"s_{w}_{d}"][ts[200 + w + d] : ts[239]].eq(0.0).all()
