"""Error metrics, slices and selection (EV-1 … EV-19).  Residual = prediction − actual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import safe_ratio
from panelcast.functions.quantiles import quantile_name, quantiles
from panelcast.operators.quality import column_stats

# Labels of the four level slices and selection thresholds.
LEVEL_LABELS = ("P25_below", "P25_P50", "P50_P75", "P75_above")
MIN_IMPROVEMENT = 0.01
SHIFT_FLAG = 0.5


def smape(y: Column, pred: Column, zero_policy: str = "exclude") -> Column:
    """Aggregate: symmetric percentage error; rows with both values zero are left out, or count as
    zero under ``zero_policy="zero"`` (EV-2)."""
    den = F.abs(y) + F.abs(pred)
    term = F.when(den > 0, F.lit(2.0) * F.abs(pred - y) / den)
    if zero_policy == "zero":
        term = F.when(den == 0, F.lit(0.0)).otherwise(term)
    return F.avg(term) * 100.0


def metric_columns(y: Column, pred: Column, zero_policy: str = "exclude") -> dict[str, Column]:
    """All metrics as aggregates of one pass (EV-1)."""
    r = pred - y
    spread = F.count(r) * F.var_pop(F.when(r.isNotNull(), y))
    return {
        "n": F.count(r),
        "mae": F.avg(F.abs(r)),
        "rmse": F.sqrt(F.avg(r * r)),
        "r2": F.when(spread > 0, F.lit(1.0) - F.sum(r * r) / spread),
        "smape": smape(y, pred, zero_policy),
        "bias": F.avg(r),
        "residual_std": F.stddev_pop(r),
    }


def metrics(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred", zero_policy: str = "exclude") -> DataFrame:
    cols = metric_columns(F.col(y), F.col(pred), zero_policy)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def summarise_folds(fold_metrics: DataFrame, by: Sequence[str], ddof: int = 0) -> DataFrame:
    """Mean and deviation of the metrics over folds (EV-3)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return fold_metrics.groupBy(*by).agg(
        F.avg("mae").alias("mean_mae"), std("mae").alias("std_mae"), F.avg("rmse").alias("mean_rmse"),
        F.avg("r2").alias("mean_r2"), F.avg("smape").alias("mean_smape"), F.avg("bias").alias("mean_bias"),
        F.abs(F.avg("bias")).alias("abs_mean_bias"), F.count(F.lit(1)).alias("n_folds"),
    )


def select_best(summary: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Lowest mean MAE, then its deviation, then absolute bias, then the name (EV-4)."""
    rank = F.struct("mean_mae", "std_mae", "abs_mean_bias", name)
    return summary.groupBy(*by).agg(F.min_by(F.col(name), rank).alias("selected"), F.min("mean_mae").alias("mean_mae"))


def select_or_keep(summary: DataFrame, name: str, baseline: str, by: Sequence[str] = (), improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """The best candidate only where it beats the baseline by the margin, else the baseline (EV-5)."""
    rank = F.struct("mean_mae", "std_mae", "abs_mean_bias", name)
    best = summary.groupBy(*by).agg(
        F.min_by(F.col(name), rank).alias("best"), F.min("mean_mae").alias("best_mae"),
        F.max(F.when(F.col(name) == baseline, F.col("mean_mae"))).alias("baseline_mae"),
    )
    gain = F.col("baseline_mae") - F.col("best_mae")
    keep = (F.col("best") == baseline) | (gain < improvement)
    return best.select(*by, F.when(keep, baseline).otherwise(F.col("best")).alias("selected"), "best", gain.alias("gain"))


def error_by(df: DataFrame, fields: Mapping[str, Column], y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """MAE per value of each field as ``(by, field, bucket, mae, n)`` in one GROUPING SETS pass (EV-6)."""
    names = list(fields)
    base = df.select(*by, *[c.cast("long").alias(n) for n, c in fields.items()], F.abs(F.col(pred) - F.col(y)).alias("_e"))
    sets = [[*by, n] for n in names]
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, *names]]).agg(
        F.avg("_e").alias("mae"), F.count("_e").alias("n"),
        *[F.grouping(n).alias(f"_g_{n}") for n in names],
    )
    field, bucket = F.lit(None).cast("string"), F.lit(None).cast("long")
    for n in reversed(names):
        here = F.col(f"_g_{n}") == 0
        field, bucket = F.when(here, n).otherwise(field), F.when(here, F.col(n)).otherwise(bucket)
    return grouped.select(*by, field.alias("field"), bucket.alias("bucket"), "mae", "n")


def level_label(y: Column, edges: Sequence[Column]) -> Column:
    """Right-closed level slice of a value for three edges."""
    e0, e1, e2 = edges
    labels = LEVEL_LABELS
    return F.when(y <= e0, labels[0]).when(y <= e1, labels[1]).when(y <= e2, labels[2]).when(y > e2, labels[3])


def slice_columns(y: Column, pred: Column) -> dict[str, Column]:
    r = pred - y
    return {
        "mae": F.avg(F.abs(r)), "bias": F.avg(r), "residual_std": F.stddev_pop(r), "y_mean": F.avg(y), "n": F.count(F.lit(1)),
    }


def error_by_level(df: DataFrame, edges: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Error per level slice for given edges ``(by, q0_25, q0_5, q0_75)``; empty slices are absent (EV-7)."""
    joined = df.join(edges.select(*by, "q0_25", "q0_5", "q0_75"), list(by))
    label = level_label(F.col(y), [F.col("q0_25"), F.col("q0_5"), F.col("q0_75")])
    cols = slice_columns(F.col(y), F.col(pred))
    return joined.groupBy(*by, label.alias("level")).agg(*[c.alias(n) for n, c in cols.items()])


def error_by_quartile(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Error per quartile of the pooled actuals themselves (EV-8)."""
    return error_by_level(df, quantiles(df, by, y, [0.25, 0.5, 0.75]), by, y, pred)


def regime_columns(y: Column, pred: Column, inside: Column) -> dict[str, Column]:
    r = pred - y
    w = lambda c: F.when(inside, c)
    return {
        "n": F.count_if(inside), "mae": F.avg(w(F.abs(r))), "rmse": F.sqrt(F.avg(w(r * r))), "bias": F.avg(w(r)),
        "y_mean": F.avg(w(y)), "pred_mean": F.avg(w(pred)),
    }


def regime_metrics(df: DataFrame, thresholds: DataFrame, by: Sequence[str], probs: Sequence[float], y: str = "y", pred: str = "pred",
                   with_all: bool = False) -> DataFrame:
    """Metrics over rows at or above each threshold (EV-9, EV-10); an empty regime gives NULL metrics.

    All regimes are conditional aggregates of the same pass, so no row is multiplied.
    """
    cols = [quantile_name(p) for p in probs]
    joined = df.join(thresholds.select(*by, *cols), list(by))
    aggs, stats = [], None
    names = [f"P{round(p * 100)}+" for p in probs] + (["ALL"] if with_all else [])
    for i, name in enumerate(names):
        inside = F.lit(True) if name == "ALL" else F.col(y) >= F.col(cols[i])
        block = regime_columns(F.col(y), F.col(pred), inside)
        block["threshold"] = F.lit(None).cast("double") if name == "ALL" else F.max(cols[i])
        stats = list(block)
        aggs += [c.alias(f"{s}__{i}") for s, c in block.items()]
    from panelcast.operators.quality import wide_to_long

    return wide_to_long(joined.groupBy(*by).agg(*aggs), by, "regime", names, stats)


def association(df: DataFrame, thresholds: DataFrame, by: Sequence[str], drivers: Sequence[str], threshold: str = "q0_75", y: str = "y") -> DataFrame:
    """Driver means in train, validation and in high and remaining validation rows per fold (EV-11)."""
    joined = df.join(thresholds.select(*by, threshold), list(by))
    val, high = F.col("role") == "validation", F.col(y) >= F.col(threshold)
    places = {"train": F.col("role") == "train", "val": val, "val_high": val & high, "val_rest": val & ~high}
    aggs = [F.avg(F.when(cond, F.col(d))).alias(f"{p}_{d}") for d in drivers for p, cond in places.items()]
    return joined.groupBy(*by).agg(*aggs, F.count_if(val & high).alias("val_high_n"))


def distribution_shift(df: DataFrame, by: Sequence[str], columns: Sequence[str], role: str = "role", base: str = "train",
                       other: str = "validation", ddof: int = 0, flag_at: float = SHIFT_FLAG) -> DataFrame:
    """Shift of means in units of the train deviation per feature (EV-12); ddof 1 gives the audit form (EV-13)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    at = lambda name: (lambda c: F.when(F.col(role) == name, c.cast("double")))
    a, b = at(base), at(other)
    out = column_stats(
        df, by, columns,
        {
            "train_mean": lambda c: F.avg(a(c)), "train_std": lambda c: std(a(c)),
            "other_mean": lambda c: F.avg(b(c)), "other_std": lambda c: std(b(c)),
        },
    )
    shift = safe_ratio(F.abs(F.col("other_mean") - F.col("train_mean")), F.col("train_std"))
    return out.withColumn("shift", shift).withColumn("flag", F.coalesce(F.col("shift") >= flag_at, F.lit(False)))


def distribution_audit(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per feature and split (EV-13)."""
    return column_stats(
        df, by, columns,
        {"mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))},
    )


def residual_histogram(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred", bins: int = 40) -> DataFrame:
    """Equal-width residual histogram from minimum to maximum, last bin closed (EV-14)."""
    r = df.select(*by, (F.col(pred) - F.col(y)).alias("_r")).where(F.col("_r").isNotNull())
    edges = r.groupBy(*by).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    joined = r.join(edges, list(by))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    spot = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_r") - F.col("_lo")) / width)).otherwise(F.lit(0))
    slot = F.least(spot, F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*by, slot.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "n")


def versus_naive(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred", naive: str = "naive") -> DataFrame:
    """Model against a naive forecast on the rows where both exist (EV-15)."""
    both = F.col(pred).isNotNull() & F.col(naive).isNotNull()
    out = df.where(both).groupBy(*by).agg(
        F.avg(F.abs(F.col(pred) - F.col(y))).alias("model_mae"), F.avg(F.abs(F.col(naive) - F.col(y))).alias("naive_mae")
    )
    return out.select(
        "*", (F.col("model_mae") < F.col("naive_mae")).alias("beats_naive"),
        safe_ratio((F.col("naive_mae") - F.col("model_mae")) * 100.0, F.col("naive_mae")).alias("reduction_pct"),
    )


def peer_table(current: DataFrame, stored: Mapping[str, DataFrame], source: str = "this_run") -> DataFrame:
    """Current results together with stored ones, each tagged with its source (EV-16)."""
    out = current.withColumn("source", F.lit(source))
    for tag, df in stored.items():
        out = out.unionByName(df.withColumn("source", F.lit(tag)), allowMissingColumns=True)
    return out


def top_coefficients(coefficients: DataFrame, by: Sequence[str], k: int = 10, value: str = "coefficient") -> DataFrame:
    """The k largest and k smallest coefficients of each fold (EV-17)."""
    up = Window.partitionBy(*by).orderBy(F.col(value).desc(), "feature")
    down = Window.partitionBy(*by).orderBy(F.col(value).asc(), "feature")
    ranked = coefficients.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    positive = ranked.where(F.col("_up") <= k).select(*by, F.lit("positive").alias("side"), F.col("_up").alias("rank"), "feature", value)
    negative = ranked.where(F.col("_down") <= k).select(*by, F.lit("negative").alias("side"), F.col("_down").alias("rank"), "feature", value)
    return positive.unionByName(negative)


def phase_deltas(df: DataFrame, by: Sequence[str], phase: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """Means per phase and their difference, for drivers or metrics (EV-19)."""
    p = F.col(phase)
    out = column_stats(
        df, by, columns,
        {"first_mean": lambda c: F.avg(F.when(p == first, c)), "second_mean": lambda c: F.avg(F.when(p == second, c))},
    )
    return out.withColumn("delta", F.col("second_mean") - F.col("first_mean"))
