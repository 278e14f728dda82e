"""Exact interpolated quantiles without holding a group in one task and without moving its values.

``percentile`` keeps every distinct value of a group in one hash map.  That is fine for a small
group and impossible for a group with a third of all rows.  ``quantiles`` therefore selects:

1. a first scan counts rows per magnitude band (``COARSE`` steps of the logarithm per power of two, a fixed
   monotone function of the value); tasks add up before they shuffle, so at most ``COARSE`` rows per power of two
   a group spans leave a task,
2. the bands that hold a wanted rank are found from the running counts,
3. a second scan keeps only rows of those bands (well under a hundredth of a group, or few distinct values)
   and counts equal values; the bands are cut once more into slices (``BANDS`` per power of two), and only those that hold
   a wanted rank are walked in order, by a sort that can spill.

The rows are read twice: stage them before if they are costly to compute.  ``distinct`` has to bring all
distinct values together anyway, so there they are counted first and the rest follows from the counts.

Bands depend on values only, not on the order of merging, so a task recomputed after an executor
loss sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import INF, all_present
from panelcast.sources.staging import stage

COARSE, BANDS = 256, 65_536
HOT_ROWS = 1_000_000


def finite_rows(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Keys and the value as ``name``, finite values only: the one value rule of every quantile here."""
    rows = df.select(*keys, F.col(value).cast("double").alias(name))
    return rows.where(F.abs(F.col(name)) < F.lit(INF))  # NULL and NaN fail this as well


def quantile_name(p: float) -> str:
    return f"q{p:g}".replace(".", "_")


def _wanted_ranks(n: Column, probs: Sequence[float]) -> Column:
    """Zero-based ranks of the order statistics that linear interpolation needs."""
    ranks = []
    for p in probs:
        low = F.floor(F.lit(float(p)) * (n - 1)).cast("long")
        ranks += [low, F.least(low + 1, (n - 1).cast("long"))]
    return F.array_distinct(F.array(*ranks))


def _interpolate(n: Column, values: Column, p: float) -> Column:
    h = F.lit(float(p)) * (n - 1)
    low = F.floor(h).cast("long")
    v0 = F.element_at(values, low)
    v1 = F.element_at(values, F.least(low + 1, (n - 1).cast("long")))
    return v0 + (h - low) * (v1 - v0)


def magnitude_band(v: Column, bands: int = BANDS) -> Column:
    """Monotone whole-number band of a finite double: exponent of two, then ``bands`` slices of it."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    slot = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * bands)
    # doubles have exponents above -1100, so the shifted band is positive
    band = (exponent + 1100) * bands + slot
    signed = F.when(v > 0, band).when(v < 0, -band).cast("long")
    # never NULL, so a join on it adds no filter that would evaluate the expression once more per row
    return F.coalesce(signed, F.lit(0).cast("long"))


def coarse_band(v: Column, bands: int = COARSE) -> Column:
    """Monotone whole-number band of a finite double: ``bands`` equal steps of the logarithm per power of two (one logarithm a row)."""
    band = F.floor(F.log2(F.abs(v)) * F.lit(float(bands))) + 1100 * bands
    return F.coalesce(F.when(v > 0, band).when(v < 0, -band).cast("int"), F.lit(0))


def holding_ranks(table: DataFrame) -> DataFrame:
    """Rows of a running count whose share contains a wanted rank, with those ranks."""
    held = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_m")))
    return table.withColumn("_held", held).where(F.size("_held") > 0).withColumn("_ranks", F.col("_held")).drop("_held")


def before(window) -> Column:
    return F.coalesce(F.sum("_m").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def located(bands: DataFrame, groups: Sequence[str], probs: Sequence[float], band: str, carry: Sequence[str] = ()) -> DataFrame:
    """Bands (``groups``, ``band``, rows ``_m``) that hold a wanted rank, with rows of the group ``_n``, ranks and rows before the band."""
    order = Window.partitionBy(*groups).orderBy(band)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = {"_n": F.sum("_m").over(everything), "_from": before(order), **{f"_t{c}": F.sum(c).over(everything) for c in carry}}
    bands = holding_ranks(bands.withColumns(totals).withColumn("_ranks", _wanted_ranks(F.col("_n"), probs)))
    return bands.select(*groups, band, "_n", F.col("_from").alias("_base"), "_ranks", *[F.col(f"_t{c}").alias(c) for c in carry])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], few_groups: bool = False, distinct: bool = False, keys_present: bool = False) -> DataFrame:
    """One row per group: ``by``, ``n`` and one column per probability (see ``quantile_name``).

    Groups with a NULL key are left out, as in any join by that key.  ``few_groups`` states that the
    number of groups is bounded by construction (a column list, split names): the located bands then
    have at most ``groups * 2 * len(probs)`` rows and are broadcast, as they are for one global group.
    Otherwise they are staged, and Spark picks the join from their measured size.
    ``distinct`` adds ``nunique``.  ``keys_present`` says that the caller has dropped NULL keys already.
    """
    by = list(by)
    groups = by or ["_all"]
    rows = finite_rows(df, by, value, "_v")
    if not by:
        rows = rows.withColumn("_all", F.col("_v").isNotNull())
    if not keys_present:
        rows = rows.where(all_present([F.col(c) for c in groups]))
    bounded = few_groups or not by

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if bounded else stage(table)

    rows = rows.withColumn("_v", F.col("_v") + F.lit(0.0))  # -0.0 and 0.0 are one value
    if distinct:
        counted = rows.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_coarse", coarse_band(F.col("_v")))
        bands = counted.groupBy(*groups, "_coarse").agg(F.sum("_m").alias("_m"), F.count(F.lit(1)).alias("_u"))
        wanted = located(bands, groups, probs, "_coarse", ["_u"])
        near = counted.join(small(wanted), [*groups, "_coarse"])
    else:
        rows = rows.withColumn("_coarse", coarse_band(F.col("_v")))
        wanted = located(rows.groupBy(*groups, "_coarse").agg(F.count(F.lit(1)).alias("_m")), groups, probs, "_coarse")
        wanted = small(wanted)
        kept = rows.join(wanted.select(*groups, "_coarse"), [*groups, "_coarse"], "left_semi")
        near = kept.groupBy(*groups, "_coarse", "_v").agg(F.count(F.lit(1)).alias("_m")).join(wanted, [*groups, "_coarse"])
    return _walked(near, by, groups, probs, distinct, bounded)


def _walked(near: DataFrame, by: Sequence[str], groups: Sequence[str], probs: Sequence[float], distinct: bool, bounded: bool) -> DataFrame:
    """Quantiles from the counted values (``_v``, ``_m``) of the located bands."""
    near = near.withColumn("_band", magnitude_band(F.col("_v")))
    keys = [*groups, "_coarse", "_band"]
    slices = near.groupBy(*keys).agg(F.sum("_m").alias("_m"), *[F.first(c).alias(c) for c in ("_base", "_ranks")])
    order = Window.partitionBy(*groups, "_coarse").orderBy("_band")  # about BANDS / COARSE rows
    slices = holding_ranks(slices.withColumn("_from", F.col("_base") + before(order)))
    slices = slices.select(*keys, F.col("_from").alias("_start"), F.col("_ranks").alias("_held_ranks"))
    walk = Window.partitionBy(*keys).orderBy("_v")
    last = near.join(F.broadcast(slices) if bounded else slices, keys).withColumns({"_ranks": F.col("_held_ranks"), "_from": F.col("_start") + before(walk)})
    hits = holding_ranks(last)
    unique = ["_u"] if distinct else []
    hits = hits.select(*groups, "_n", *unique, "_v", F.explode("_ranks").alias("_r"))
    # bounded: at most 2 * len(probs) order statistics per group
    found = hits.groupBy(*groups, "_n", *unique).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    return found.select(
        *by, F.col("_n").alias("n"), *([F.col("_u").alias("nunique")] if distinct else []),
        *[_interpolate(F.col("_n"), F.col("_at"), p).alias(quantile_name(p)) for p in probs],
    )


def keyed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Quantiles for very many, mostly tiny groups (duplicate keys): ``percentile`` for those, the
    distributed walk for the groups above ``hot_rows``.  Both see finite values only, so the limit never
    changes a result.  There are at most rows / hot_rows hot groups."""
    keys = list(keys)
    rows = finite_rows(df, keys, value, value)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)
    cold = rows.join(hot, keys, "left_anti").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(float(p))).alias(quantile_name(p)) for p in probs]
    )
    return cold.unionByName(quantiles(rows.join(hot, keys, "left_semi"), keys, value, probs))
