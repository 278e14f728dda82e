"""The hourly energy + city weather job: raw CSVs → model table with 184 features and its manifest."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from panelcast.contract import HOURLY
from panelcast.functions.numeric import safe_ratio, strict_mean, total, total_skip_null
from panelcast.functions.timefn import parse_instant
from panelcast.operators import clean
from panelcast.operators.declared import Declared
from panelcast.operators.features import add_calendar, direction_parts, lag_summary
from panelcast.operators.grid import INDEX, LENGTH, POSITION, densify
from panelcast.operators.lineage import derived, observed
from panelcast.operators.manifest import FeatureSpec, Manifest, guard_features
from panelcast.sources.tables import read_csv

# Source columns, entities and feature choices.
TARGET = "price day ahead"
EMPTY_COLUMNS = ("generation hydro pumped storage aggregated", "forecast wind offshore eday ahead")
GENERATION = (
    "generation biomass", "generation fossil brown coal/lignite", "generation fossil gas", "generation fossil hard coal",
    "generation fossil oil", "generation hydro pumped storage consumption", "generation hydro run-of-river and poundage",
    "generation hydro water reservoir", "generation nuclear", "generation other", "generation other renewable",
    "generation solar", "generation waste", "generation wind onshore",
)
ZERO_ONLY_GENERATION = (
    "generation fossil coal-derived gas", "generation fossil oil shale", "generation fossil peat", "generation geothermal",
    "generation marine", "generation wind offshore",
)
RENEWABLE = (
    "generation biomass", "generation hydro run-of-river and poundage", "generation hydro water reservoir",
    "generation other renewable", "generation solar", "generation wind onshore",
)
FOSSIL = ("generation fossil brown coal/lignite", "generation fossil gas", "generation fossil hard coal", "generation fossil oil")
NOT_PRODUCTION = ("generation hydro pumped storage consumption",)
FORECASTS = ("total load forecast", "forecast solar day ahead", "forecast wind onshore day ahead")
OTHER_MEASURES = ("total load actual", "price actual")
CITIES = ("Barcelona", "Bilbao", "Madrid", "Seville", "Valencia")
WEATHER_RULES = {
    "temp": "mean", "temp_min": "mean", "temp_max": "mean", "pressure": "median", "humidity": "mean", "wind_speed": "mean",
    "wind_deg": "circular_mean", "rain_1h": "max", "rain_3h": "max", "snow_3h": "max", "clouds_all": "mean",
    "weather_id": "mode", "weather_main": "mode", "weather_description": "mode", "weather_icon": "mode",
}
WEATHER_LAG_FIELDS = ("temp", "humidity", "pressure", "wind_speed", "clouds_all", "rain_1h", "rain_3h", "snow_3h")
SPATIAL = {
    "temp_national_mean": ("temp", "mean"), "humidity_national_mean": ("humidity", "mean"), "wind_speed_national_mean": ("wind_speed", "mean"),
    "clouds_all_national_mean": ("clouds_all", "mean"), "rain_1h_national_max": ("rain_1h", "max"),
}
TARGET_LAGS, LOAD_LAGS, OTHER_LAGS = (24, 48, 168), (24, 48, 168), (24, 168)
SHARE_WINDOWS = {"fraction_high_price_last_7d": 168, "fraction_high_price_last_14d": 336, "fraction_high_price_last_30d": 720}
DELAY_HOURS = 24
MAX_GAP_HOURS = 3
# Role of every source column by name pattern, first match wins.
ROLE_RULES = {
    r"^price_day_ahead$": "target",
    r"^(price_actual|total_load_actual)$|^generation_": "forbidden_leakage",
    r"^(total_load_forecast|forecast_solar_day_ahead|forecast_wind_onshore_day_ahead)$": "potentially_valid_day_ahead",
    r"^(time|ts|timestamp_utc|series_id)$": "identifier",
}


def plain(name: str) -> str:
    """Column name without blanks, slashes and hyphens."""
    return re.sub(r"[\s/-]", "_", name.strip()).lower()


def energy_schema(columns: Sequence[str] = (*GENERATION, *ZERO_ONLY_GENERATION, *EMPTY_COLUMNS, *FORECASTS, *OTHER_MEASURES, TARGET)) -> StructType:
    return StructType([StructField("time", StringType()), *[StructField(c, DoubleType()) for c in columns]])


def weather_schema() -> StructType:
    whole = ("pressure", "humidity", "wind_speed", "wind_deg", "clouds_all", "weather_id")
    text = ("weather_main", "weather_description", "weather_icon")
    order = ("temp", "temp_min", "temp_max", "pressure", "humidity", "wind_speed", "wind_deg", "rain_1h", "rain_3h", "snow_3h", "clouds_all",
             "weather_id", "weather_main", "weather_description", "weather_icon")
    kind = lambda c: LongType() if c in whole else StringType() if c in text else DoubleType()
    return StructType([StructField("dt_iso", StringType()), StructField("city_name", StringType()), *[StructField(c, kind(c)) for c in order]])


def load_energy(spark: SparkSession, path: str, schema: StructType | None = None, series: str = "ES") -> DataFrame:
    raw = read_csv(spark, path, schema or energy_schema())
    named = raw.select(*[F.col(f"`{c}`").alias(plain(c)) for c in raw.columns])
    return named.withColumn("ts", parse_instant(F.col("time"))).withColumn("series_id", F.lit(series))


def load_weather(spark: SparkSession, path: str, series: str = "ES") -> DataFrame:
    raw = read_csv(spark, path, weather_schema())
    return raw.withColumn("ts", parse_instant(F.col("dt_iso"))).withColumn("city_name", F.trim("city_name")).withColumn("series_id", F.lit(series))


def clean_energy(energy: DataFrame) -> DataFrame:
    """Dense hourly panel with short gaps of generation and actual load filled; prices are never filled."""
    fillable = [plain(c) for c in (*GENERATION, *ZERO_ONLY_GENERATION, "total load actual")]
    fillable = [c for c in fillable if c in energy.columns]
    return clean.clean_measures(
        densify(energy, HOURLY), HOURLY, fillable, [plain(TARGET), "price_actual"], [plain(c) for c in EMPTY_COLUMNS], MAX_GAP_HOURS
    )


def weather_long(weather: DataFrame) -> DataFrame:
    return clean.collapse(weather, ["series_id", "ts", "city_name"], WEATHER_RULES).drop("n_rows")


def merge(energy: DataFrame, weather: DataFrame) -> DataFrame:
    """Energy joined one-to-one with the wide weather of the same hours.

    Action: refuses key sets that differ; an hour without weather, or the other way round, is a fault of the inputs.
    """
    keys = ["series_id", "ts"]
    wide = clean.pivot_entities(weather_long(weather), keys, "city_name", CITIES, list(WEATHER_RULES))
    panel = clean_energy(energy)
    clean.assert_same_keys(panel, wide, keys)
    return clean.one_to_one_left(panel, wide, keys)


def raw_columns(merged: DataFrame) -> list[str]:
    """Realised measurements: everything but keys, positions and published forecasts."""
    return [c for c in merged.columns if c not in ("series_id", "ts", INDEX, POSITION, LENGTH, *[plain(c) for c in FORECASTS])]


def build_features(merged: DataFrame) -> tuple[DataFrame, Manifest]:
    """Identifier, 184 features and nothing else, together with the manifest they were declared in."""
    plan = Declared(HOURLY)
    calendar = [c for c in add_calendar(merged.select("ts")).columns if c != "ts"]
    for c in calendar:
        cyclic = c.endswith(("_sin", "_cos"))
        plan.known(c, "ts", "calendar", "cyclic_encoding" if cyclic else "calendar_field", "known_in_advance", f"{c} of the local hour")

    load, solar, wind = (F.col(plain(c)) for c in FORECASTS)
    same_time = {plain(c): F.col(plain(c)) for c in FORECASTS}
    same_time["renewable_forecast_total"] = total([solar, wind])
    same_time["forecast_wind_share_of_load"] = safe_ratio(wind, load)
    same_time["forecast_solar_share_of_load"] = safe_ratio(solar, load)
    for c in same_time:
        plan.known(c, c, "day_ahead_forecast", "column arithmetic", "named_day_ahead_forecast_for_t", f"{c} for hour t")

    price = plan.lags("price_day_ahead", "price_day_ahead", TARGET_LAGS, "price_day_ahead", "historical_target", "shift", "prior_auction_only", "auction price")
    summaries = {"price_mean_lag24_lag48": strict_mean([F.col(c) for c in price[:2]])}
    triple = lag_summary("price", price)
    summaries |= {f"price_{s}_lag24_lag48_lag168": triple[f"price_{s}"] for s in ("mean", "std", "min", "max")}
    for name in summaries:
        span = "24+48" if name == "price_mean_lag24_lag48" else "24+48+168"
        plan.manifest.add(FeatureSpec(name, ", ".join(price), "historical_target", span, "statistic across lags", "prior_auction_only", name, 24))

    actual = F.col("total_load_actual")
    plan.lags("total_load_actual", actual, LOAD_LAGS, "total_load_actual", "historical_load", "shift", "historical_actual_only", "realised load")
    plan.lags("load_forecast_error", actual - load, (24,), "total_load_actual - total_load_forecast", "historical_load", "difference then shift", "historical_actual_and_forecast", "load surprise")

    present = [c for c in GENERATION if plain(c) in merged.columns]
    for c in present:
        plan.lags(plain(c), plain(c), OTHER_LAGS, c, "historical_generation", "shift", "historical_actual_only", c)
    columns = lambda names: [F.col(plain(c)) for c in names if c in present]
    produced = total_skip_null(columns([c for c in GENERATION if c not in NOT_PRODUCTION]))
    renewable, fossil = total_skip_null(columns(RENEWABLE)), total_skip_null(columns(FOSSIL))
    for name, column, how in (
        ("total_generation", produced, "sum then shift"), ("renewable_generation", renewable, "sum then shift"),
        ("fossil_generation", fossil, "sum then shift"), ("renewable_share", safe_ratio(renewable, produced), "ratio then shift"),
    ):
        plan.lags(name, column, OTHER_LAGS, name, "historical_generation", how, "historical_actual_only", name)

    for city in CITIES:
        sine, cosine = direction_parts(F.col(f"wind_deg_{city}").cast("double"))
        for part, column in (("sin", sine), ("cos", cosine)):
            plan.lags(f"wind_deg_{part}_{city.lower()}", column, OTHER_LAGS, f"wind_deg_{city}", "historical_weather", f"{part} then shift", "historical_observation_only", f"{city} wind direction {part}")
        for field in WEATHER_LAG_FIELDS:
            plan.lags(f"{field}_{city.lower()}", f"{field}_{city}", OTHER_LAGS, f"{field}_{city}", "historical_weather", "shift", "historical_observation_only", f"{city} {field}")

    wide = observed(merged, raw_columns(merged))
    for name, (field, how) in SPATIAL.items():
        cells = [F.col(f"{field}_{city}").cast("double") for city in CITIES]
        count = total([c.isNotNull().cast("int") for c in cells])
        value = F.greatest(*cells) if how == "max" else F.when(count > 0, total_skip_null(cells) / count)
        wide = wide.withColumn(f"_{name}", value)
        plan.lags(name, f"_{name}", OTHER_LAGS, f"{field}_*", "weather_aggregate", f"{how} over cities then shift", "historical_observation_only", name)

    # position columns come along so that splits need no second pass
    out = add_calendar(plan.history.apply(wide.withColumns({f"_known_{c}": e for c, e in same_time.items()})))
    out = derived(out, summaries)
    known = [F.col(f"_known_{c}").alias(c) for c in same_time]
    rest = [c for c in plan.manifest.names if c not in same_time]
    features = out.select("series_id", "ts", INDEX, POSITION, LENGTH, *rest, *known)
    return features.select("series_id", "ts", INDEX, POSITION, LENGTH, *plan.manifest.names), plan.manifest


def model_manifest(manifest: Manifest) -> Manifest:
    """The manifest of the fitted model: the features plus the three high-level shares."""
    shares = [
        FeatureSpec(n, "price_day_ahead", "target_level", "24+", f"share above train P75 over {w} h, delayed 24 h", "prior_auction_only", n, DELAY_HOURS)
        for n, w in SHARE_WINDOWS.items()
    ]
    return Manifest([*manifest.specs, *shares])


def model_table(features: DataFrame, merged: DataFrame, manifest: Manifest) -> DataFrame:
    """Guarded features joined with the target as ``y``."""
    guard_features(features, manifest, ["series_id", "ts", INDEX, POSITION, LENGTH], raw_columns(merged))
    target = merged.select("series_id", "ts", F.col(plain(TARGET)).alias("y"))
    return clean.one_to_one_left(features, target, ["series_id", "ts"])
