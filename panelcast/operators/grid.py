"""Regular time grids (TM-3, TM-4, TM-5, GR-1, GR-2, GR-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.contract import PanelSpec
from panelcast.functions.chunks import CHUNK, chunk_of
from panelcast.functions.timefn import index_instant, step_index

INDEX = "idx"
POSITION = "pos"
LENGTH = "n_steps"
GRID_CHUNK = 4096


def with_index(df: DataFrame, spec: PanelSpec, name: str = INDEX) -> DataFrame:
    return df.withColumn(name, step_index(F.col(spec.ts), spec.step_seconds))


def bounds(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """First and last grid index of every series."""
    return with_index(df, spec).groupBy(*spec.keys).agg(F.min(INDEX).alias("first_idx"), F.max(INDEX).alias("last_idx"))


def expected_grid(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every step between the first and last observation of each series (keys and times of ``df``).

    Carries ``idx``, the zero-based ``pos`` and the series length ``n_steps``, so splits, folds and
    blocks further down are plain arithmetic.  The sequence is built in two explodes so that no
    single row holds the grid of a long series.
    """
    b = bounds(df.select(*spec.key), spec).withColumn(LENGTH, F.col("last_idx") - F.col("first_idx") + 1)
    parts = b.withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(LENGTH) - 1) / GRID_CHUNK).cast("long")))
    )
    low = F.col("_part") * GRID_CHUNK
    grid = parts.withColumn(
        POSITION, F.explode(F.sequence(low, F.least(low + GRID_CHUNK - 1, F.col(LENGTH) - 1)))
    )
    grid = grid.withColumn(INDEX, F.col("first_idx") + F.col(POSITION))
    return grid.select(
        *spec.keys, index_instant(F.col(INDEX), spec.step_seconds).alias(spec.ts), INDEX, POSITION, LENGTH
    )


def on_grid(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df`` itself; the job fails at a row whose time is no step or whose key is NULL.

    The check is part of the key columns, so neither column pruning nor the null filters that a join
    adds on its keys can come before it.
    """
    at = index_instant(step_index(F.col(spec.ts), spec.step_seconds), spec.step_seconds)
    kinds = dict(df.select(*spec.key).dtypes)

    def checked(name: str, good: Column) -> Column:
        failed = F.raise_error(F.lit(f"{name} is NULL or off the time grid")).cast(kinds[name])
        return F.when(F.coalesce(good, F.lit(False)), F.col(name)).otherwise(failed)

    return df.withColumns({spec.ts: checked(spec.ts, F.col(spec.ts) == at), **{k: checked(k, F.col(k).isNotNull()) for k in spec.keys}})


def densify(df: DataFrame, spec: PanelSpec, fill: dict[str, float] | None = None, extent: DataFrame | None = None) -> DataFrame:
    """Gap-free panel: missing steps appear as rows whose measures are NULL (or ``fill``).

    ``extent`` may name the raw rows behind ``df``: their range per series is a map-side combined
    minimum and maximum, while taking it from an aggregated ``df`` would repeat that aggregation.

    A row off the grid, or with a NULL key or time, has no place in the panel: it fails the job.
    """
    out = expected_grid(df if extent is None else extent, spec).join(on_grid(df, spec), spec.key, "left")
    return out.fillna(fill) if fill else out


def aggregate_events(
    events: DataFrame, spec: PanelSpec, unit: str, keys: dict[str, Column], ts: Column, measures: dict[str, Column]
) -> DataFrame:
    """Irregular events -> one row per series and step."""
    from panelcast.functions.timefn import truncate

    grouped = events.groupBy(
        *[c.alias(k) for k, c in keys.items()], truncate(ts, unit).alias(spec.ts)
    )
    return grouped.agg(*[c.alias(m) for m, c in measures.items()])


def missing_steps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Grid steps with no row."""
    return expected_grid(df, spec).join(df.select(*spec.key), spec.key, "left_anti").select(*spec.key)


def off_grid_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows whose instant is not on the grid of its series (for example a half-hour stamp)."""
    return df.select(*spec.key).join(expected_grid(df, spec).select(*spec.key), spec.key, "left_anti")


def step_report(df: DataFrame, spec: PanelSpec, chunk: int = GRID_CHUNK) -> DataFrame:
    """Per series: rows, successive differences and how many of them are not exactly one step.

    Differences are taken inside time chunks; the difference across a chunk border comes from a
    table with one row per chunk, so a long series never sits in one window partition.
    """
    rows = with_index(df.select(*spec.key), spec).where(F.col(spec.ts).isNotNull())
    rows = rows.withColumn(CHUNK, chunk_of(F.col(INDEX), chunk)).withColumn(
        "_sec", F.unix_micros(F.col(spec.ts).cast("timestamp"))
    )
    step = F.lit(spec.step_seconds * 1_000_000)
    inner = Window.partitionBy(*spec.keys, CHUNK).orderBy(spec.ts)
    diffs = rows.withColumn("_diff", F.col("_sec") - F.lag("_sec").over(inner))
    per_chunk = diffs.groupBy(*spec.keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("_diff") != step).alias("_bad"),
        F.min("_sec").alias("_lo"),
        F.max("_sec").alias("_hi"),
    )
    across = Window.partitionBy(*spec.keys).orderBy(CHUNK)
    joined = per_chunk.withColumn("_gap", F.col("_lo") - F.lag("_hi").over(across))
    return joined.groupBy(*spec.keys).agg(
        F.sum("_rows").alias("n_rows"),
        (F.sum("_rows") - 1).alias("n_diffs"),
        (F.sum("_bad") + F.count_if(F.col("_gap") != step)).alias("bad_steps"),
    )


def future_steps(origins: DataFrame, spec: PanelSpec, horizon: int = 24) -> DataFrame:
    """``horizon`` steps after each origin row ``(keys, origin)`` with labels h+1 … h+n."""
    out = origins.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = index_instant(step_index(F.col("origin"), spec.step_seconds) + F.col("h"), spec.step_seconds)
    return out.withColumn(spec.ts, at).withColumn("forecast_horizon", F.concat(F.lit("h+"), F.col("h").cast("string")))


def resample_mean(df: DataFrame, spec: PanelSpec, unit: str, columns: Sequence[str]) -> DataFrame:
    from panelcast.functions.timefn import truncate

    return df.groupBy(*spec.keys, truncate(F.col(spec.ts), unit).alias(spec.ts)).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
