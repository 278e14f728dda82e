"""Model archive: one Parquet row per model, the only object passed from fitting to scoring (IO-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.contract import require_columns

MODEL_FIELDS = ("names", "medians", "means", "scales", "coef", "intercept")


def write_model(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Action: archive model rows with their parameters and feature names."""
    require_columns(model, MODEL_FIELDS).write.mode(mode).parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), MODEL_FIELDS)


def single_model(model: DataFrame) -> dict:
    """Action: the one archived model as a dict (a few arrays of feature-count length)."""
    rows = model.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one model row, found {len(rows)}")
    return rows[0].asDict()
