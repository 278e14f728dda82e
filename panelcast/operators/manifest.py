"""Feature specs, the manifest they produce, and the leakage rules (FE-16, FE-18, FE-20, FE-21)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.contract import LeakageError, require_unique_names
from panelcast.functions.timefn import CIVIL_ZONE, civil, from_civil, truncate
from panelcast.operators import lineage

SAFE, CONDITIONAL, UNKNOWN, FORBIDDEN = "SAFE", "CONDITIONAL", "UNKNOWN", "FORBIDDEN"

# Groups whose members are realised measurements.
OBSERVED_GROUPS = ("historical_load", "historical_generation", "historical_weather", "weather_aggregate")
# Groups whose members are known before the step they belong to.
KNOWN_GROUPS = ("calendar", "day_ahead_forecast")
# Names that may never enter a feature matrix.
FORBIDDEN_NAMES = ("price day ahead", "price actual", "price_actual", "total load actual", "total_load_actual", "time")
# Fixed value: name shape of a one-step lag, which the audit classes as forbidden.
SHORT_LAG_NAME = re.compile(r"(^|_)lag_1(_|$)")
#: Steps a realised measurement must lie back to enter the feature matrix.
LEAST_REALISED_LAG = 2


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature is made of.  ``lag_steps`` is the smallest offset into the past it reads."""

    feature_name: str
    source_column: str
    feature_group: str
    lag: str
    transformation: str
    availability: str
    description: str
    lag_steps: int = 0
    leakage_status: str = SAFE


MANIFEST_FIELDS = (
    "feature_name", "source_column", "feature_group", "lag", "transformation", "availability", "leakage_status", "description",
)


class Manifest:
    """Ordered feature specs: the single source of truth for the feature matrix."""

    def __init__(self, specs: Iterable[FeatureSpec] = ()):
        self.specs: list[FeatureSpec] = []
        for s in specs:
            self.add(s)

    def add(self, spec: FeatureSpec) -> None:
        if spec.leakage_status != SAFE:
            raise LeakageError(f"{spec.feature_name} is not {SAFE}")
        require_unique_names([*self.names, spec.feature_name])
        self.specs.append(spec)

    @property
    def names(self) -> list[str]:
        return [s.feature_name for s in self.specs]

    def groups(self) -> dict[str, str]:
        return {s.feature_name: s.feature_group for s in self.specs}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(s)[f] for f in MANIFEST_FIELDS) + (s.lag_steps,) for s in self.specs]
        schema = ", ".join(f"{f} string" for f in MANIFEST_FIELDS) + ", lag_steps int"
        return spark.createDataFrame(rows, schema)


def fault(spec: FeatureSpec, sources: Iterable[str]) -> str | None:
    """Why a declared feature may not be used, from what it says it reads; None if nothing speaks against it."""
    if spec.feature_name in sources:
        return "is a source column itself"
    if spec.lag_steps < 0:
        return f"reads {-spec.lag_steps} steps ahead"
    if spec.feature_group in OBSERVED_GROUPS and spec.lag_steps < LEAST_REALISED_LAG:
        return f"reads a realised value {spec.lag_steps} steps back, {LEAST_REALISED_LAG} at least are asked for"
    return None


def untrue(df: DataFrame, spec: FeatureSpec) -> str | None:
    """Why the lineage of a declared column contradicts its declaration; None if it does not."""
    read = lineage.of(df, spec.feature_name)
    if not read:
        return None if spec.feature_group in KNOWN_GROUPS else "has no lineage"
    source, steps = min(read.items(), key=lambda r: (r[1], r[0]))
    if steps < spec.lag_steps or (spec.feature_group in KNOWN_GROUPS and steps <= 0):
        return f"reads {source} {steps} steps back, declared are {spec.lag_steps}"
    return None


def guard_features(df: DataFrame, manifest: Manifest, identifiers: Sequence[str], raw: Sequence[str] = ()) -> list[str]:
    """Raise unless the feature columns are exactly the declared ones and no declaration leaks (FE-18).

    Declarations are compared with the lineage that the columns carry: a column built with a shorter lag than
    declared is refused, so is a historical feature without lineage, or a copy of a measurement declared as known in
    advance.  A column nobody declared is refused whatever its name.
    """
    columns = [c for c in df.columns if c not in identifiers]
    declared = {s.feature_name: s for s in manifest.specs}
    faults = {c: "is not declared" for c in columns if c not in declared}
    faults |= {c: "is declared but absent" for c in declared if c not in columns}
    sources = {*raw, *FORBIDDEN_NAMES}
    faults |= {c: why for c, s in declared.items() if c in columns and (why := untrue(df, s))}
    faults |= {c: why for c, s in declared.items() if (why := fault(s, sources))}
    if faults:
        raise LeakageError("; ".join(f"{c} {why}" for c, why in sorted(faults.items())))
    return columns


def classify(name: Column, group: Column, lag_steps: Column) -> dict[str, Column]:
    """Is a feature known at noon of the day before delivery?  Strict and assumed view (FE-20)."""
    observed = group.isin(*OBSERVED_GROUPS)
    old_enough = lag_steps >= 48
    forbidden = name.isin(*FORBIDDEN_NAMES) | name.rlike(SHORT_LAG_NAME.pattern)
    published = group.isin("calendar", "historical_target", "target_level")

    def view(forecast_class: str, recent_class: str) -> Column:
        return (
            F.when(forbidden, FORBIDDEN)
            .when(published, SAFE)
            .when(group == "day_ahead_forecast", forecast_class)
            .when(observed & old_enough, SAFE)
            .when(observed, recent_class)
            .otherwise(UNKNOWN)
        )

    strict = view(UNKNOWN, FORBIDDEN)
    return {
        "classification_strict": strict,
        "classification_assumed": view(CONDITIONAL, CONDITIONAL),
        "known_at_origin": F.when(strict == SAFE, "yes").when(forbidden, "no")
        .when(observed, "not for all hours of the delivery day").otherwise("unverified"),
        "future_leakage_risk": F.when(group == "calendar", "none").when(strict == SAFE, "low")
        .when(group == "day_ahead_forecast", "medium").otherwise("high"),
        "strict_usable": strict == SAFE,
    }


def availability_audit(manifest: DataFrame) -> DataFrame:
    """One row per feature with its availability class in both views."""
    cols = classify(F.col("feature_name"), F.col("feature_group"), F.col("lag_steps"))
    return manifest.select(F.col("feature_name").alias("feature"), "feature_group", *[c.alias(n) for n, c in cols.items()])


def day_ahead_origin(ts: Column, zone: str = CIVIL_ZONE, hour: int = 12) -> Column:
    """Forecast origin of a delivery step: noon of the civil day before."""
    day = truncate(civil(ts, zone), "day")
    return from_civil(day - F.make_dt_interval(F.lit(1), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(hour)), zone)


def known_at_origin(ts: Column, lag_seconds: int, publish_delay_seconds: int = 0, zone: str = CIVIL_ZONE) -> Column:
    """Row-wise availability: was the value of ``ts - lag`` published by the origin of ``ts``?"""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(publish_delay_seconds - lag_seconds)))
    return ts + shift <= day_ahead_origin(ts, zone)


def column_roles(spark: SparkSession, columns: Sequence[str], rules: Mapping[str, str], default: str = "ambiguous") -> DataFrame:
    """Role of every source column: the first rule (name pattern -> role) that matches wins (FE-21)."""
    rows = [(c,) for c in columns]
    names = spark.createDataFrame(rows, "column_name string")
    role = F.lit(default)
    for pattern, value in reversed(list(rules.items())):
        role = F.when(F.col("column_name").rlike(pattern), value).otherwise(role)
    return names.withColumn("role", role)
