"""Forecasts under an availability rule (FC-1, FC-2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.contract import ContractError, PanelSpec
from panelcast.functions.numeric import all_present
from panelcast.operators.features import add_calendar, lookup, shares_at
from panelcast.operators.grid import future_steps
from panelcast.operators.linear import score, score_frozen
from panelcast.operators.residual import horizon_addend

# Reasons given with a forecast.
STRICT_REASON = "required UNKNOWN/FORBIDDEN features at forecast origin"
ASSUMED_REASON = "inputs assumed published; their publication times are not in the data"


def readiness(audit: DataFrame, model: str) -> DataFrame:
    """One row per model: are all of its features usable at the origin?"""
    blocked = F.count_if(~F.col("strict_usable"))
    return audit.groupBy(F.lit(model).alias("model")).agg(
        (blocked == 0).alias("production_ready"), blocked.alias("blocked_features"), F.count(F.lit(1)).alias("features")
    )


def strict_forecast(origins: DataFrame, spec: PanelSpec, ready: DataFrame, prediction: Column, model: str, horizon: int = 24) -> DataFrame:
    """Rows for h+1 … h+n; the prediction stays NULL while a required feature is not usable (FC-1)."""
    # the readiness of one model is one row
    steps = future_steps(origins, spec, horizon).withColumn("model", F.lit(model))
    out = steps.join(F.broadcast(ready.where(F.col("model") == model).drop("model")), F.lit(True), "left")
    ok = F.coalesce(F.col("production_ready"), F.lit(False))
    return out.select(
        *spec.keys, spec.ts, "forecast_horizon", F.when(ok, prediction).alias("y_pred"), F.col("origin").alias("forecast_origin"), "model",
        F.lit("STRICT").alias("scenario"), ok.alias("production_ready"), F.when(~ok, STRICT_REASON).alias("blocking_reason"),
    )


def assumed_inputs(
    origins: DataFrame, history: DataFrame, features: DataFrame, spec: PanelSpec, columns: Sequence[str], target: str, threshold: float,
    windows: Mapping[str, int], delay: int, horizon: int = 24,
) -> DataFrame:
    """Feature rows after an origin that lies ``horizon`` steps before the end of the data (FC-2):
    stored lags by lookup, recomputed calendar, high-level shares straight from history."""
    steps = future_steps(origins, spec, horizon)
    stored = [c for c in columns if c not in windows and c in features.columns]
    rows = lookup(features, steps, spec, stored)
    calendar = [c for c in add_calendar(steps, spec.ts).columns if c in columns]
    if calendar:
        rows = add_calendar(rows.drop(*calendar), spec.ts)
    if windows:
        rows = rows.join(shares_at(history, steps, spec, target, threshold, windows, delay), spec.key, "left")
    return rows


def assumed_forecast(inputs: DataFrame, spec: PanelSpec, model: dict, name: str) -> DataFrame:
    """Score prepared inputs with the archived model and its decaying residual state (FC-2).

    The archive must hold the addend and the state; a missing one is refused, not taken for zero.
    """
    absent = [f for f in ("addend", "phi", "last_error") if model.get(f) is None]
    if absent:
        raise ContractError(f"archived model without {absent}")
    scored = score_frozen(inputs, model, "base")
    return _assumed(scored, spec, F.col("base"), F.lit(float(model["phi"])), F.lit(float(model["last_error"])), name)


def assumed_forecasts(inputs: DataFrame, spec: PanelSpec, archive: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """As ``assumed_forecast`` for every series of a panel: model rows are joined by series.

    A series without a whole archive row (model, addend, state) fails the job.
    """
    state = ["addend", "phi", "last_error"]
    keys = list(spec.keys)
    scored = score(inputs, archive.drop(*state), keys, columns, "base").join(archive.select(*keys, *state), keys, "left")
    whole = all_present([F.col(c) for c in ("base", *state)])
    scored = scored.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("series without a whole archive row")).cast("boolean")))
    return _assumed(scored, spec, F.col("base") + F.col("addend"), F.col("phi"), F.col("last_error"), name)


def _assumed(scored: DataFrame, spec: PanelSpec, base: Column, phi: Column, last_error: Column, name: str) -> DataFrame:
    return scored.select(
        *spec.keys, spec.ts, "forecast_horizon", (base + horizon_addend(phi, last_error, F.col("h"))).alias("y_pred"), F.col("origin").alias("forecast_origin"),
        F.lit(name).alias("model"), F.lit("DATASET_ASSUMED").alias("scenario"), F.lit(False).alias("production_ready"),
        F.lit(ASSUMED_REASON).alias("blocking_reason"),
    )
