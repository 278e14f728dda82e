"""Quality checks and profiles (QC-1 … QC-16).  Nothing here changes or removes a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.contract import PanelSpec
from panelcast.functions.numeric import INF, all_present, any_present
from panelcast.functions.quantiles import quantiles
from panelcast.functions.timefn import index_instant, step_index
from panelcast.operators.grid import bounds, step_report


def _ratio(num: Column, den: Column, scale: float = 100.0) -> Column:
    return F.when(den > 0, num / den * F.lit(scale))


def wide_to_long(row_per_group: DataFrame, by: Sequence[str], label: str, names: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Reshape ``{stat}__{i}`` columns of a small aggregate to one row per (group, name)."""
    structs = [
        F.struct(F.lit(name).alias(label), *[F.col(f"{s}__{i}").alias(s) for s in stats]) for i, name in enumerate(names)
    ]
    return row_per_group.select(*by, F.inline(F.array(*structs)))


def column_stats(df: DataFrame, by: Sequence[str], columns: Sequence[str], stats: Mapping[str, callable], label: str = "feature") -> DataFrame:
    """One wide partial aggregate over all columns (no row is exploded), then a reshape of the result."""
    aggs = [fn(F.col(c)).alias(f"{s}__{i}") for i, c in enumerate(columns) for s, fn in stats.items()]
    return wide_to_long(df.groupBy(*by).agg(*aggs), by, label, columns, list(stats))


# --- index checks -----------------------------------------------------------------------------


def index_checks(df: DataFrame, spec: PanelSpec, expected_rows: int | None = None) -> DataFrame:
    """Long table ``(keys, check_name, ok, detail)`` about the time index of each series (QC-1)."""
    keys = list(spec.keys)
    ts = F.col(spec.ts)
    at = step_index(ts, spec.step_seconds)
    # count per key first: a plain count of groups then replaces count(distinct)
    per_key = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_c"))
    base = per_key.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(ts.isNull(), F.col("_c"))), F.lit(0)).alias("unparsed"),
        F.coalesce(F.sum(F.when(ts.isNotNull(), F.col("_c") - 1)), F.lit(0)).alias("duplicates"),
        F.count(ts).alias("unique_ts"),
        # steps from the first to the last observation without a row of their own: arithmetic, no grid
        (F.max(at) - F.min(at) + 1 - F.count_if(index_instant(at, spec.step_seconds) == ts)).alias("missing"),
    )
    unique = per_key.where(ts.isNotNull()).select(*spec.key)
    steps = step_report(unique, spec).select(*keys, "bad_steps")
    one = base.join(steps, keys, "left").fillna(0, ["missing", "bad_steps"])
    expected = F.lit(expected_rows) if expected_rows is not None else F.col("unique_ts")
    checks = {
        "unparsed": (F.col("unparsed") == 0, F.col("unparsed")),
        "duplicates": (F.col("duplicates") == 0, F.col("duplicates")),
        "unique_count": (F.col("unique_ts") == expected, F.col("unique_ts")),
        "step": (F.col("bad_steps") == 0, F.col("bad_steps")),
        "missing": (F.col("missing") == 0, F.col("missing")),
    }
    rows = F.array(*[
        F.struct(F.lit(n).alias("check_name"), ok.alias("ok"), d.cast("long").alias("detail")) for n, (ok, d) in checks.items()
    ])
    return one.select(*keys, F.inline(rows))


# --- duplicates -------------------------------------------------------------------------------


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def duplicate_summary(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Groups, duplicate groups, rows inside them and extra rows with rates, per ``by`` (QC-2, QC-5)."""
    size = F.col("size")
    out = group_sizes(df, keys).groupBy(*by).agg(
        F.sum(size).alias("total_rows"),
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(size > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(size > 1, size)), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.sum(size - 1).alias("extra_rows"),
    )
    return out.select(
        "*",
        _ratio(F.col("duplicate_groups"), F.col("total_groups")).alias("duplicate_group_rate_pct"),
        _ratio(F.col("rows_in_duplicate_groups"), F.col("total_rows")).alias("rows_in_duplicate_groups_rate_pct"),
        _ratio(F.col("extra_rows"), F.col("total_rows")).alias("extra_row_rate_pct"),
    )


def multiplicity(df: DataFrame, keys: Sequence[str], only_duplicates: bool = True) -> DataFrame:
    """Group size -> number of groups (QC-3)."""
    sizes = group_sizes(df, keys)
    if only_duplicates:
        sizes = sizes.where(F.col("size") > 1)
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def _constant(c: str) -> Column:
    """Aggregate: at most one distinct value, where NULL counts as a value.  No distinct set is needed."""
    present = F.count(F.col(c))
    return (present == 0) | ((present == F.count(F.lit(1))) & (F.min(F.col(c)) == F.max(F.col(c))))


def duplicate_classes(
    df: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], other: Sequence[str] = ()
) -> DataFrame:
    """Number of duplicate groups per kind of difference (QC-4)."""
    both = lambda cols: reduce(lambda a, b: a & b, [_constant(c) for c in cols], F.lit(True))
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        both(numeric).alias("num_same"),
        both(categorical).alias("cat_same"),
        both(other).alias("other_same"),
    ).where(F.col("size") > 1)
    exact = F.col("num_same") & F.col("cat_same") & F.col("other_same")
    kind = (
        F.when(exact, "exact_copy")
        .when(~F.col("num_same"), "numeric_differs")
        .when(~F.col("cat_same"), "numeric_same_category_differs")
        .otherwise("other")
    )
    return groups.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("groups"))


# --- rules and missing values -----------------------------------------------------------------


def rule_report(df: DataFrame, rules: Mapping[str, Column], entity: str, ts: str) -> DataFrame:
    """Rows matching each rule: count, share of all rows, per-entity count, first and last instant (QC-6).

    One aggregate per entity holds all rules; the totals per rule come from that small table.
    """
    names = list(rules)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(names):
        hit = rules[name]
        aggs += [
            F.count_if(hit).alias(f"n__{i}"),
            F.min(F.when(hit, F.col(ts))).alias(f"first_ts__{i}"),
            F.max(F.when(hit, F.col(ts))).alias(f"last_ts__{i}"),
        ]
    per_entity = wide_to_long(df.groupBy(entity).agg(*aggs), [entity, "_rows"], "rule", names, ["n", "first_ts", "last_ts"])
    totals = per_entity.groupBy("rule").agg(
        F.sum("n").alias("rule_count"), F.sum("_rows").alias("_total"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    # one row per declared rule, so the broadcast side is bounded by the rule list
    return per_entity.select("rule", entity, F.col("n").alias("entity_count")).join(F.broadcast(totals), "rule").select(
        "rule", entity, "entity_count", "rule_count",
        _ratio(F.col("rule_count"), F.col("_total")).alias("rule_rate_pct"), "first_ts", "last_ts",
    )


def missing_pattern(df: DataFrame, columns: Sequence[str], group: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with any column missing, rows with the whole ``group`` missing, and NULLs per column (QC-7)."""
    return df.groupBy(*by).agg(
        F.count_if(~all_present([F.col(c) for c in columns])).alias("rows_any_missing"),
        F.count_if(~any_present([F.col(c) for c in group])).alias("rows_group_missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def null_audit(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULL cells per feature, with the share of all cells and rows holding any NULL, per group (QC-12)."""
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if(~all_present([F.col(c) for c in columns])).alias("rows_with_null")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_cells__{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*by).agg(*aggs)
    cells = reduce(lambda a, b: a + b, [F.col(f"null_cells__{i}") for i in range(len(columns))])
    wide = wide.withColumn("null_pct", cells / (F.col("_rows") * F.lit(len(columns))) * 100.0)
    return wide_to_long(wide, [*by, "rows_with_null", "null_pct"], "feature", columns, ["null_cells"])


def infinity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return column_stats(df, [], columns, {"infinite": lambda c: F.count_if(F.abs(c) == F.lit(INF))}, "column_name")


def match_rate(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose side columns are all present (QC-9)."""
    ok = all_present([F.col(c) for c in columns])
    return df.groupBy(*by).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("match_rate"))


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Keys on both sides, only left and only right (QC-13)."""
    side = lambda df, flag: df.groupBy(*keys).agg(F.lit(True).alias(flag))
    both = side(left, "_l").join(side(right, "_r"), list(keys), "full_outer")
    return both.groupBy(*by).agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def repeated_rows(df: DataFrame) -> DataFrame:
    """Count of rows that repeat an earlier identical row (QC-8)."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return per_row.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows"))


def final_checks(df: DataFrame, spec: PanelSpec, target: str, numeric: Sequence[str], side: Sequence[str]) -> DataFrame:
    """Check table of a finished panel per series (QC-8): counts, index, target, infinities, copies."""
    keys = list(spec.keys)
    infinite = reduce(lambda a, b: a + b, [F.when(F.abs(F.col(c)) == F.lit(INF), 1).otherwise(0) for c in numeric])
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(target).isNull()).alias("target_missing"),
        F.min(target).alias("target_min"),
        F.max(target).alias("target_max"),
        F.avg(F.when(all_present([F.col(c) for c in side]), 1.0).otherwise(0.0)).alias("match_rate"),
        F.sum(infinite).alias("infinite_values"),
    )
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum(F.col("_c") - 1).alias("duplicate_rows")
    )
    index = index_checks(df, spec).groupBy(*keys).pivot("check_name", ["duplicates", "missing", "step"]).agg(F.first("detail"))
    one = base.join(copies, keys).join(index, keys)
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), ok.alias("ok"), detail.cast("double").alias("detail"))
        for name, ok, detail in [
            ("row_count", F.col("row_count") > 0, F.col("row_count")),
            ("duplicate_timestamp", F.col("duplicates") == 0, F.col("duplicates")),
            ("missing_timestamp", F.col("missing") == 0, F.col("missing")),
            ("monotonic_timestamp", F.col("step") == 0, F.col("step")),
            ("target_missing_count", F.col("target_missing") == 0, F.col("target_missing")),
            ("target_min", F.lit(True), F.col("target_min")),
            ("target_max", F.lit(True), F.col("target_max")),
            ("side_match_rate", F.col("match_rate") == 1.0, F.col("match_rate")),
            ("infinite_values", F.col("infinite_values") == 0, F.col("infinite_values")),
            ("duplicate_rows", F.col("duplicate_rows") == 0, F.col("duplicate_rows")),
        ]
    ])
    return one.select(*keys, F.inline(rows))


# --- profiles ---------------------------------------------------------------------------------


def profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Column profile: NULLs, distinct values, range, mean, median, deviation (QC-10)."""
    moments = column_stats(
        df, [], columns,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "nulls": lambda c: F.count_if(c.isNull()),
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
        },
        "column_name",
    )
    if approximate:
        rest = column_stats(
            df, [], columns,
            {"nunique": F.approx_count_distinct, "median": lambda c: F.percentile_approx(c.cast("double"), 0.5, 10000)},
            "column_name",
        )
    else:
        long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "_v")
        rest = quantiles(long, ["column_name"], "_v", [0.5], few_groups=True, distinct=True, keys_present=True)
        rest = rest.select("column_name", "nunique", F.col("q0_5").alias("median"))
    out = moments.join(rest, "column_name", "left").fillna(0, ["nunique"])
    return out.select(
        "column_name", "nulls", _ratio(F.col("nulls"), F.col("n_rows")).alias("null_pct"), "nunique",
        (F.col("nunique") + (F.col("nulls") > 0).cast("long")).alias("nunique_with_null"),
        "min", "max", "mean", "median", "std",
    )


def target_stats(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Count, mean, median, population deviation, range and NULLs of the target per group (QC-11)."""
    y = F.col(target)
    base = df.groupBy(*by).agg(
        F.count(y).alias("count"), F.count_if(y.isNull()).alias("nulls"), F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
    )
    median = quantiles(df, by, target, [0.5]).select(*by, F.col("q0_5").alias("median"))
    return base.join(median, list(by), "left")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content fingerprint: row count and a wide sum of row hashes (QC-14)."""
    columns = list(columns or df.columns)
    h = F.xxhash64(*[F.col(c) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"))


def grid_size(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Steps from the first to the last observation of each series."""
    return bounds(df.select(*spec.key), spec).select(*spec.keys, (F.col("last_idx") - F.col("first_idx") + 1).alias("expected_rows"))
