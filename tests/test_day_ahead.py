"""The full energy + weather job on small CSVs in the original column layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelcast.contract import LeakageError
from panelcast.operators.manifest import availability_audit, column_roles, guard_features
from panelcast.plans import day_ahead as da

HOURS = 260


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(7)
    ts = pd.date_range("2015-03-25 00:00", periods=HOURS, freq="h", tz="UTC")
    local = ts.tz_convert("Europe/Madrid")
    stamp = [t.strftime("%Y-%m-%d %H:%M:%S") + t.strftime("%z")[:3] + ":00" for t in local]
    energy = pd.DataFrame({"time": stamp})
    for c in [f.name for f in da.energy_schema()][1:]:
        energy[c] = np.nan if c in da.EMPTY_COLUMNS else rng.uniform(1, 100, HOURS).round(2)
    energy.loc[50:52, "generation solar"] = np.nan  # filled
    energy.loc[100:105, "generation solar"] = np.nan  # too long
    energy.loc[0, "total load actual"] = np.nan  # edge
    rows = []
    for city in da.CITIES:
        w = pd.DataFrame({"dt_iso": stamp, "city_name": " Barcelona" if city == "Barcelona" else city})
        for c in ("temp", "temp_min", "temp_max", "rain_1h", "rain_3h", "snow_3h"):
            w[c] = rng.uniform(0, 300, HOURS).round(3)
        for c in ("pressure", "humidity", "wind_speed", "wind_deg", "clouds_all", "weather_id"):
            w[c] = rng.integers(0, 360, HOURS)
        w["weather_main"], w["weather_description"], w["weather_icon"] = "rain", "light rain", "10n"
        rows.append(w)
    weather = pd.concat(rows)
    again = weather.iloc[[3]].copy()
    again["weather_main"], again["weather_id"] = "mist", 9
    return energy, pd.concat([weather, again])[[f.name for f in da.weather_schema()]]


@pytest.fixture(scope="module")
def built(spark, frames, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    energy, weather = frames
    energy.to_csv(folder / "energy.csv", index=False)
    weather.to_csv(folder / "weather.csv", index=False)
    merged = da.merge(da.load_energy(spark, str(folder / "energy.csv")), da.load_weather(spark, str(folder / "weather.csv")))
    merged = spark.createDataFrame(merged.toPandas(), merged.schema)
    features, manifest = da.build_features(merged)
    table = da.model_table(features, merged, manifest)
    return merged, manifest, table, table.toPandas().sort_values("ts").reset_index(drop=True)


def test_feature_groups(built):
    _, manifest, _, out = built
    sizes = pd.Series(manifest.groups()).value_counts().to_dict()
    assert sizes == {
        "calendar": 20, "day_ahead_forecast": 6, "historical_target": 8, "historical_load": 4, "historical_generation": 36,
        "historical_weather": 100, "weather_aggregate": 10,
    }
    assert len(manifest.names) == 184 and len(out) == HOURS


def test_values_follow_the_source(built, frames):
    merged, _, _, out = built
    m = merged.toPandas().sort_values("ts").reset_index(drop=True)
    price = frames[0]["price day ahead"]
    np.testing.assert_allclose(out["y"], price)
    np.testing.assert_allclose(out["price_day_ahead_lag_24"][24:], price[:-24])
    assert out["price_day_ahead_lag_24"][:24].isna().all()
    triple = pd.concat([price.shift(k) for k in (24, 48, 168)], axis=1)
    np.testing.assert_allclose(out["price_std_lag24_lag48_lag168"], triple.std(axis=1, ddof=0, skipna=False))
    solar = m["generation_solar"]
    assert solar[50:53].notna().all() and solar[100:106].isna().all()
    assert m["total_load_actual"].isna().sum() == 1
    production = [da.plain(c) for c in da.GENERATION if c not in da.NOT_PRODUCTION]
    np.testing.assert_allclose(out["total_generation_lag_24"], m[production].sum(axis=1, min_count=1).shift(24))
    np.testing.assert_allclose(out["wind_deg_sin_madrid_lag_24"], np.sin(np.deg2rad(m["wind_deg_Madrid"].astype(float))).shift(24))
    temps = m[[f"temp_{c}" for c in da.CITIES]].astype(float).mean(axis=1)
    np.testing.assert_allclose(out["temp_national_mean_lag_168"], temps.shift(168))
    local = pd.DatetimeIndex(out["ts"]).tz_localize("UTC").tz_convert("Europe/Madrid")
    assert (out["hour"].to_numpy() == local.hour).all() and (out["day_of_week"].to_numpy() == local.dayofweek).all()


def test_mode_tie_is_by_string(built):
    m = built[0].toPandas().sort_values("ts").reset_index(drop=True)
    assert m["weather_main_Barcelona"][3] == "mist"


def test_availability_counts(spark, built):
    audit = availability_audit(da.model_manifest(built[1]).to_frame(spark)).toPandas()
    assert audit["classification_strict"].value_counts().to_dict() == {"SAFE": 106, "FORBIDDEN": 75, "UNKNOWN": 6}
    assert audit["classification_assumed"].value_counts().to_dict() == {"SAFE": 106, "CONDITIONAL": 81}


def test_guard_rejects_leaks(built):
    merged, manifest, table, _ = built
    ids = ["series_id", "ts", "idx", "pos", "n_steps"]
    features = table.drop("y")
    from pyspark.sql import functions as F

    for bad in ("price_actual", "generation_solar", "temp_Madrid", "future_load", "price_lag_1"):
        with pytest.raises(LeakageError):
            guard_features(features.withColumn(bad, F.lit(1.0)), manifest, ids, merged.columns)
    with pytest.raises(LeakageError):
        guard_features(features.drop("hour"), manifest, ids)


def test_column_roles(spark, built):
    merged = built[0]
    roles = column_roles(spark, merged.columns, da.ROLE_RULES).groupBy("role").count().toPandas().set_index("role")["count"]
    assert roles["target"] == 1 and roles["forbidden_leakage"] == 22 and roles["potentially_valid_day_ahead"] == 3
    assert roles["ambiguous"] >= 75
