"""Chronological splits and expanding folds (SP-1 … SP-7).

All of them are arithmetic on ``pos`` and ``n_steps``, which the dense grid carries: no join, no
shuffle and no row number over a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.contract import PanelSpec
from panelcast.operators.grid import LENGTH, POSITION, bounds, with_index

# Split and fold fractions.
TRAIN_FRACTION, VALIDATION_END = 0.70, 0.85
FOLD_CUTS = (0.50, 0.60, 0.70, 0.80)
INNER_FOLD_CUTS = (0.50, 0.65, 0.80)
INNER_TAIL_CUT = 0.80
MIN_TAIL_ROWS = 24


def cut_at(n: Column, fraction: float) -> Column:
    """Number of rows before the cut: the whole part of n · fraction."""
    return F.floor(n * F.lit(float(fraction))).cast("long")


def with_position(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``pos`` and ``n_steps`` for a dense panel that does not carry them yet."""
    b = bounds(df, spec)
    out = with_index(df, spec).join(b, list(spec.keys))
    return out.withColumn(POSITION, F.col("idx") - F.col("first_idx")).withColumn(
        LENGTH, F.col("last_idx") - F.col("first_idx") + 1
    ).drop("first_idx", "last_idx")


def chronological_split(df: DataFrame, train: float = TRAIN_FRACTION, validation_end: float = VALIDATION_END) -> DataFrame:
    """Add ``split``: the first 70 % of each series, the next 15 %, the rest (SP-1)."""
    pos, n = F.col(POSITION), F.col(LENGTH)
    return df.withColumn(
        "split",
        F.when(pos < cut_at(n, train), "train").when(pos < cut_at(n, validation_end), "validation").otherwise("test"),
    )


def development(df: DataFrame) -> DataFrame:
    """Train and validation rows, everything before the locked split (SP-7)."""
    return df.where(F.col("split").isin("train", "validation"))


def split_summary(df: DataFrame, spec: PanelSpec, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, share, first and last instant and length of each split (SP-2)."""
    out = df.groupBy(*spec.keys, *by).agg(
        F.count(F.lit(1)).alias("rows"), F.first(LENGTH).alias("_n"), F.min(spec.ts).alias("start_ts"), F.max(spec.ts).alias("end_ts")
    )
    seconds = F.unix_seconds(F.col("end_ts").cast("timestamp")) - F.unix_seconds(F.col("start_ts").cast("timestamp"))
    return out.select(
        *spec.keys, *by, "rows", (F.col("rows") / F.col("_n") * 100.0).alias("percentage"), "start_ts", "end_ts",
        (seconds / spec.step_seconds).cast("long").alias("duration_steps"),
    )


def overlap_proof(df: DataFrame, spec: PanelSpec, order: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Per series: boundaries are ordered and every key belongs to exactly one split (SP-3)."""
    ts = F.col(spec.ts)
    edges = df.groupBy(*spec.keys).agg(
        *[F.min(F.when(F.col("split") == s, ts)).alias(f"min_{s}") for s in order],
        *[F.max(F.when(F.col("split") == s, ts)).alias(f"max_{s}") for s in order],
    )
    keys = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_c")).groupBy(*spec.keys).agg(
        F.count_if(F.col("_c") > 1).alias("multi_assigned")
    )
    ordered = F.lit(True)
    for a, b in zip(order, order[1:]):
        ordered = ordered & (F.col(f"max_{a}") < F.col(f"min_{b}"))
    return edges.join(keys, list(spec.keys)).select(
        *spec.keys, *[f"max_{s}" for s in order[:-1]], *[f"min_{s}" for s in order[1:]],
        ordered.alias("ordered"), "multi_assigned",
    )


def expanding_folds(df: DataFrame, cuts: Sequence[float] = FOLD_CUTS, upto: Column | None = None) -> DataFrame:
    """One copy of a row per fold it belongs to, with ``fold``, ``role`` and ``cut`` (SP-4, SP-6).

    Fold i trains on everything before cut i and validates on the block up to the next cut.  Rows
    are multiplied inside the scan stage (at most ``len(cuts)`` copies); there is no join at all.
    """
    pos, n = F.col(POSITION), (F.col(LENGTH) if upto is None else upto)
    edges = [cut_at(n, f) for f in cuts] + [n]
    folds = []
    for i, (low, high) in enumerate(zip(edges, edges[1:]), start=1):
        role = F.when(pos < low, "train").when(pos < high, "validation")
        folds.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"), low.alias("cut"))))
    member = F.filter(F.array(*folds), lambda f: f.isNotNull())
    return df.withColumn("_fold", F.explode(member)).select("*", "_fold.*").drop("_fold")


def inner_tail(train_rows: DataFrame, length: Column, fraction: float = INNER_TAIL_CUT, min_rows: int = MIN_TAIL_ROWS) -> DataFrame:
    """Split a train block of ``length`` rows again into ``fit`` and its chronological tail ``stop`` (SP-5)."""
    cut = F.greatest(cut_at(length, fraction), F.lit(min_rows))
    cut = F.when(length - cut < min_rows, F.greatest(length - min_rows, F.lit(min_rows))).otherwise(cut)
    return train_rows.withColumn("inner_role", F.when(F.col(POSITION) < cut, "fit").otherwise("stop"))


def fold_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows and time range of every fold and role."""
    return df.groupBy(*spec.keys, "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(spec.ts).alias("start_ts"), F.max(spec.ts).alias("end_ts")
    )


def fold_checks(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per series and fold: train precedes validation, both are non-empty (SP-4)."""
    ts, role = F.col(spec.ts), F.col("role")
    return df.groupBy(*spec.keys, "fold").agg(
        F.count_if(role == "train").alias("n_train"), F.count_if(role == "validation").alias("n_val"),
        (F.max(F.when(role == "train", ts)) < F.min(F.when(role == "validation", ts))).alias("ordered"),
    )
