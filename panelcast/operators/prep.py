"""Train-only preprocessing (PP-1, PP-2, PP-3, PP-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import all_present
from panelcast.functions.quantiles import quantiles
from panelcast.operators.quality import column_stats

SCALER_FIELDS = ("names", "medians", "means", "scales")


def fit_scaler_long(train: DataFrame, by: Sequence[str], columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Per group and feature: median, and mean / population deviation after median imputation.

    Imputed moments follow from the moments of the present values, so the data is scanned once for
    moments and once for medians, never a third time after imputing.  A column without values gets
    median 0, a constant column scale 1.
    """
    stats = {
        "n_rows": lambda c: F.count(F.lit(1)),
        "present": lambda c: F.count(c),
        "mu": lambda c: F.avg(c.cast("double")),
        "var": lambda c: F.var_pop(c.cast("double")),
    }
    if approximate:
        stats["median"] = lambda c: F.percentile_approx(c.cast("double"), 0.5, 10000)
        table = column_stats(train, by, columns, stats)
    else:
        table = column_stats(train, by, columns, stats)
        # the NULL-key filter goes below the unpivot, where both readers of the value counts share it
        keyed = train.where(all_present([F.col(c) for c in by]))
        long = keyed.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            list(by), list(columns), "feature", "_v"
        )
        medians = quantiles(long, [*by, "feature"], "_v", [0.5], keys_present=True).select(*by, "feature", F.col("q0_5").alias("median"))
        table = table.join(medians, [*by, "feature"], "left")
    n, k = F.col("n_rows"), F.col("n_rows") - F.col("present")
    median = F.coalesce(F.col("median"), F.lit(0.0))
    mu, var = F.coalesce(F.col("mu"), median), F.coalesce(F.col("var"), F.lit(0.0))
    # written as a shift from mu so that a constant column keeps exactly zero variance
    mean = mu + (median - mu) * k / n
    spread = (F.col("present") * (var + (mu - mean) * (mu - mean)) + k * (median - mean) * (median - mean)) / n
    return table.select(
        *by, "feature", median.alias("median"), mean.alias("mean"),
        F.when(spread > 0, F.sqrt(spread)).otherwise(F.lit(1.0)).alias("scale"),
    )


def fit_scaler(train: DataFrame, by: Sequence[str], columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """The same as one row per group with aligned arrays (at most ``len(columns)`` elements)."""
    long = fit_scaler_long(train, by, columns, approximate)
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    rows = long.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("i"), "feature", "median", "mean", "scale"))).alias("_f")
    )
    return rows.select(
        *by, F.col("_f.feature").alias("names"), F.col("_f.median").alias("medians"),
        F.col("_f.mean").alias("means"), F.col("_f.scale").alias("scales"),
    )


def imputed(columns: Sequence[str]) -> list[Column]:
    """Imputed columns of a row that carries ``medians`` in the same order (PP-3)."""
    return [F.coalesce(F.col(c).cast("double"), F.col("medians")[i]) for i, c in enumerate(columns)]


def standardised(columns: Sequence[str]) -> list[Column]:
    """Imputed and standardised columns of a row that carries the scaler arrays (PP-2)."""
    return [(x - F.col("means")[i]) / F.col("scales")[i] for i, x in enumerate(imputed(columns))]


def transform(df: DataFrame, scaler: DataFrame, by: Sequence[str], columns: Sequence[str], scale: bool = True) -> DataFrame:
    """Replace the feature columns by their imputed (and standardised) values."""
    joined = df.join(scaler, list(by))
    exprs = standardised(columns) if scale else imputed(columns)
    return joined.withColumns(dict(zip(columns, exprs))).drop(*SCALER_FIELDS)


def target_quantiles(train: DataFrame, by: Sequence[str], target: str = "y", probs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Train quantiles of the target with linear interpolation (PP-5)."""
    return quantiles(train, by, target, probs)
