"""Collapsing duplicates, filling short gaps, pivoting and one-to-one joins (CL-1 … CL-12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.contract import ContractError, PanelSpec, require_unique_names
from panelcast.functions.chunks import CHUNK, chunk_of, chunk_window, chunked, home_rows
from panelcast.functions.numeric import all_present, circular_mean
from panelcast.functions.quantiles import keyed_quantiles
from panelcast.operators.grid import INDEX, LENGTH, POSITION
from panelcast.operators.quality import key_overlap

# Rules that are plain partial aggregates; median and mode need their own pass.
ONE_PASS_RULES = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "circular_mean": circular_mean,
}


def group_mode(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent value; ties go to the smallest by string order, the original value is returned (CL-3).

    Counts per (group, value) come first, so a hot group is spread over its values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    best = F.min_by(F.col(column), F.struct(-F.col("_c"), F.col(column).cast("string")))
    return counts.groupBy(*keys).agg(best.alias(column))


def collapse(df: DataFrame, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """One row per key with one rule per column: mean, max, min, median, circular_mean or mode (CL-1)."""
    keys = list(keys)
    unknown = {r for r in rules.values()} - set(ONE_PASS_RULES) - {"median", "mode"}
    if unknown:
        raise ContractError(f"unknown collapse rules: {sorted(unknown)}")
    # a NULL key names no row to collapse into: it fails the job rather than losing columns in the joins below
    named = all_present([F.col(k) for k in keys])
    df = df.where(F.when(named, F.lit(True)).otherwise(F.raise_error(F.lit(f"NULL in the keys {keys} of a collapse")).cast("boolean")))
    quick = [ONE_PASS_RULES[r](F.col(c)).alias(c) for c, r in rules.items() if r in ONE_PASS_RULES]
    parts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *quick)]
    for column, rule in rules.items():
        if rule == "median":
            parts.append(keyed_quantiles(df, keys, column, [0.5]).select(*keys, F.col("q0_5").alias(column)))
        elif rule == "mode":
            parts.append(group_mode(df, keys, column))
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    return joined.select(*keys, *rules, "n_rows")


def pivot_entities(
    df: DataFrame, keys: Sequence[str], entity: str, entities: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Long entity table -> wide ``{field}_{entity}``; an absent entity gives NULL columns (CL-4)."""
    spaced = [e for e in entities if any(ch.isspace() for ch in e)]
    if spaced:
        raise ContractError(f"entity names with spaces: {spaced}")
    names = require_unique_names(f"{f}_{e}" for f in fields for e in entities)
    # conditional aggregates: the entity list is fixed, so no extra job looks for distinct values
    cells = [
        F.max(F.when(F.col(entity) == e, F.col(f))).alias(f"{f}_{e}") for f in fields for e in entities
    ]
    return df.groupBy(*keys).agg(*cells).select(*keys, *names)


def missing_runs(df: DataFrame, spec: PanelSpec, columns: Sequence[str], chunk: int = 4096) -> DataFrame:
    """Runs of NULLs ``[start, end)`` per series and column with length and edge flag (CL-5).

    Needs a dense panel carrying ``idx``, ``pos`` and ``n_steps``.  Islands are found inside time
    chunks; only the pieces that touch a chunk border (two per chunk at most) are stitched together
    in a second, far smaller window.
    """
    keys = [*spec.keys, "column_name"]
    long = df.select(*spec.keys, INDEX, POSITION, LENGTH, *columns).unpivot(
        [*spec.keys, INDEX, POSITION, LENGTH], list(columns), "column_name", "_v"
    )
    nulls = long.where(F.col("_v").isNull()).withColumn(CHUNK, chunk_of(F.col(INDEX), chunk))
    inner = Window.partitionBy(*keys, CHUNK).orderBy(INDEX)
    pieces = (
        nulls.withColumn("_island", F.col(INDEX) - F.row_number().over(inner))
        .groupBy(*keys, CHUNK, "_island")
        .agg(
            F.min(INDEX).alias("_start"), (F.max(INDEX) + 1).alias("_end"),
            F.min(POSITION).alias("_p0"), F.max(POSITION).alias("_p1"), F.first(LENGTH).alias("_n"),
        )
    )
    size = F.lit(chunk)
    at_border = (F.pmod(F.col("_start"), size) == 0) | (F.pmod(F.col("_end"), size) == 0)
    fields = [*keys, "_start", "_end", "_p0", "_p1", "_n"]
    whole = pieces.where(~at_border).select(*fields)
    order = Window.partitionBy(*keys).orderBy("_start")
    opens = F.coalesce(F.lag("_end").over(order) != F.col("_start"), F.lit(True)).cast("int")
    stitched = (
        pieces.where(at_border).select(*fields).withColumn("_open", opens)
        .withColumn("_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("_start").alias("_start"), F.max("_end").alias("_end"),
            F.min("_p0").alias("_p0"), F.max("_p1").alias("_p1"), F.first("_n").alias("_n"),
        )
        .select(*fields)
    )
    edge = (F.col("_p0") == 0) | (F.col("_p1") == F.col("_n") - 1)
    return whole.unionByName(stitched).select(
        *keys, F.col("_p0").alias("start_pos"), (F.col("_p1") + 1).alias("end_pos"),
        (F.col("_end") - F.col("_start")).alias("length"), edge.alias("is_edge"),
    )


def fill_short_gaps(df: DataFrame, spec: PanelSpec, columns: Sequence[str], max_gap: int = 3) -> DataFrame:
    """Time-linear filling of interior NULL runs of at most ``max_gap`` steps (CL-6).

    Longer runs and runs at either end of a series stay NULL.  A short run has both neighbours
    within ``max_gap`` steps, so the frames are bounded and one shuffle serves all columns.
    """
    if not columns:
        return df
    staged = chunked(df, INDEX, lookback=max_gap, lookahead=max_gap)
    w = chunk_window(spec.keys, INDEX)
    before, after = w.rangeBetween(-max_gap, -1), w.rangeBetween(1, max_gap)
    helper: dict = {}
    for i, c in enumerate(columns):
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(INDEX).alias("i"), F.col(c).alias("v")))
        helper[f"_b{i}"] = F.last(known, ignorenulls=True).over(before)
        helper[f"_a{i}"] = F.first(known, ignorenulls=True).over(after)
    staged = home_rows(staged.withColumns(helper))
    filled = {}
    for i, c in enumerate(columns):
        b, a = F.col(f"_b{i}"), F.col(f"_a{i}")
        run = a["i"] - b["i"] - 1
        share = (F.col(INDEX) - b["i"]) / (a["i"] - b["i"])
        filled[c] = F.coalesce(F.col(c), F.when(run <= max_gap, b["v"] + (a["v"] - b["v"]) * share))
    return staged.withColumns(filled).select(*df.columns)


def fill_report(before: DataFrame, after: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: NULLs before, filled, and remaining."""
    from panelcast.operators.quality import column_stats

    count = {"nulls": lambda c: F.count_if(c.isNull())}
    b = column_stats(before, by, columns, count, "column_name").withColumnRenamed("nulls", "before")
    a = column_stats(after, by, columns, count, "column_name").withColumnRenamed("nulls", "remaining")
    return b.join(a, [*by, "column_name"]).select(
        *by, "column_name", "before", (F.col("before") - F.col("remaining")).alias("filled"), "remaining"
    )


def clean_measures(
    df: DataFrame, spec: PanelSpec, fillable: Sequence[str], protected: Sequence[str], empty: Sequence[str] = (), max_gap: int = 3
) -> DataFrame:
    """Drop columns known to be empty and fill short gaps of an allow-list, never of the target (CL-7)."""
    touched = sorted(set(fillable) & set(protected))
    if touched:
        raise ContractError(f"protected columns must not be filled: {touched}")
    return fill_short_gaps(df.drop(*empty), spec, [c for c in fillable if c not in empty], max_gap)


def one_to_one_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails the job at run time when either side repeats a key (CL-10).

    Each side is reduced to one row per key with its count; ``raise_error`` fires in filters while the
    join runs, so the check costs no second pass and does not depend on which columns are read.
    """
    keys = list(keys)
    overlap = (set(left.columns) & set(right.columns)) - set(keys)
    if overlap:
        raise ContractError(f"columns on both sides: {sorted(overlap)}")

    def unique(df: DataFrame, side: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        packed = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_c"), F.first(F.struct(*[F.col(c) for c in values])).alias("_row")
        )
        failed = F.raise_error(F.lit(f"duplicate key on the {side} side of a one-to-one join")).cast("boolean")
        once = packed.where(F.when(F.col("_c") > 1, failed).otherwise(F.lit(True)))
        return once.select(*keys, F.col("_c").alias(f"_c_{side}"), "_row.*")

    joined = unique(left, "left").join(unique(right, "right"), keys, "left")
    # reads the right side's count, so that side stays in the plan when none of its columns is wanted
    return joined.where(F.coalesce(F.col("_c_right"), F.lit(1)) == 1).drop("_c_left", "_c_right")


def assert_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Action: raise when the key sets differ (only two counts reach the driver)."""
    row = key_overlap(left, right, keys).first()
    if row["only_left"] or row["only_right"]:
        raise ContractError(f"key sets differ: only_left={row['only_left']} only_right={row['only_right']}")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "kind", value: str = "value") -> DataFrame:
    """Wide -> long (CL-11)."""
    return df.unpivot(list(ids), list(columns), name, value)


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation by name; columns a frame lacks become NULL (CL-12)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
