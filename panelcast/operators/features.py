"""Feature columns over a dense panel (FE-1 … FE-15, FE-17, FE-19, FE-22 … FE-24).

All history features of a panel share one shuffle: rows are chunked once with the longest
look-back, and every lag is a RANGE frame over the step index inside ``(series, chunk)``.  A RANGE
frame looks back in time, so a missing step gives NULL rather than silently moving to another row.

No rolling frame is read row by row, so the time does not depend on the window:

* shares are differences of two running counts (whole numbers, exact),
* means and deviations never subtract running sums, which would lose the digits of small values behind a large one.
  The axis is cut into blocks as long as the window; a window is the end of one block and the start of the next, whose running
  moments (from the front and from the back of the block) are merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.contract import ContractError, LeakageError, PanelSpec, require_unique_names
from panelcast.functions.chunks import CHUNK, chunk_window, chunked, home_rows, value_at
from panelcast.functions.numeric import strict_max, strict_mean, strict_min, strict_std
from panelcast.functions.timefn import CIVIL_ZONE, calendar_fields, civil, cyclic_fields
from panelcast.operators.grid import INDEX, future_steps, with_index
from panelcast.operators.lineage import stamped


def add_calendar(df: DataFrame, ts: str = "ts", zone: str = CIVIL_ZONE, cyclic: bool = True) -> DataFrame:
    """Calendar fields of the civil time and, optionally, their cyclic encodings (FE-1, FE-2)."""
    out = df.withColumn("_local", civil(F.col(ts), zone))
    out = out.withColumns(calendar_fields(F.col("_local"))).drop("_local")
    return out.withColumns(cyclic_fields({c: F.col(c) for c in out.columns})) if cyclic else out


def check_lag(steps: int) -> int:
    if steps <= 0:
        raise LeakageError(f"only positive lags are allowed, got {steps}")
    return steps


class History:
    """Collects history columns and evaluates all of them in one chunked pass.

    >>> History(spec).lag("y", 24).rolling("y", 168, delay=24, mean="m", std="s").apply(panel)

    ``lineage`` says for every column which source it reads and the least and greatest number of steps back; the
    columns carry it (see ``lineage.py``).
    """

    def __init__(self, spec: PanelSpec):
        self.spec = spec
        self.lineage: dict[str, tuple[str, int, int]] = {}
        self._columns: dict[str, callable] = {}
        self._states: dict[str, callable] = {}
        self._state_names: dict[tuple, str] = {}
        self._reach = 0

    def _add(self, name: str, source: str, least: int, reach: int, build: callable) -> History:
        if name in self._columns:
            raise ContractError(f"duplicate column names: ['{name}']")
        self._columns[name] = build
        self.lineage[name] = (source, least, reach)
        self._reach = max(self._reach, reach)
        return self

    def _state(self, kind: str, *of: object, build: callable) -> str:
        """Name of a running column that several features may share."""
        name = self._state_names.setdefault((kind, *map(str, of)), f"_run_{len(self._state_names)}")
        self._states.setdefault(name, build)
        return name

    def lag(self, source: str | Column, steps: int, name: str | None = None) -> History:
        """Value exactly ``steps`` earlier (FE-5)."""
        check_lag(steps)
        column = F.col(source) if isinstance(source, str) else source
        return self._add(name or f"{source}_lag_{steps}", str(source), steps, steps, lambda w: value_at(column, w, steps))

    def rolling(
        self, source: str, window: int, delay: int, mean: str | None = None, std: str | None = None
    ) -> History:
        """Mean and population deviation of the ``window`` values ending ``delay`` steps ago; NULL
        unless all of them are present (FE-13)."""
        check_lag(delay)
        reach = delay + window - 1
        x = F.col(source).cast("double")

        def moments(w, descending: bool) -> Column:
            """Moments of the block up to this row, from its front or its back."""
            index = F.col(INDEX)
            order = index.desc() if descending else index
            over = Window.partitionBy(*self.spec.keys, CHUNK, F.floor(index / F.lit(window))).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
            return F.struct(F.count(x).over(over).alias("n"), F.avg(x).over(over).alias("m"), F.var_pop(x).over(over).alias("v"))

        front = self._state("front", source, window, build=lambda w: moments(w, False))
        back = self._state("back", source, window, build=lambda w: moments(w, True))
        # the whole window is one block where its first step starts one
        one = F.pmod(F.col(INDEX) - F.lit(reach), F.lit(window)) == 0

        def merged(w, deviation: bool) -> Column:
            end, start = value_at(F.col(front), w, delay), value_at(F.col(back), w, reach)
            n, m = end["n"] + start["n"], F.lit(float(window))
            apart = end["m"] - start["m"]
            both = (end["v"] * end["n"] + start["v"] * start["n"]) / m + end["n"] * start["n"] / (m * m) * apart * apart
            if deviation:
                return F.when(one, F.when(end["n"] == window, F.sqrt(end["v"]))).when(n == window, F.sqrt(both))
            return F.when(one, F.when(end["n"] == window, end["m"])).when(n == window, (end["m"] * end["n"] + start["m"] * start["n"]) / m)

        if mean:
            self._add(mean, source, delay, reach, lambda w: merged(w, False))
        if std:
            self._add(std, source, delay, reach, lambda w: merged(w, True))
        return self

    def share_above(self, source: str, threshold: Column | float, window: int, delay: int, name: str) -> History:
        """Share of the ``window`` values ending ``delay`` steps ago strictly above a threshold (FE-14)."""
        check_lag(delay)
        reach = delay + window - 1
        level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        flag = F.when(F.col(source).isNotNull() & level.isNotNull(), (F.col(source) > level).cast("long"))

        def counts(w, upto: int) -> Column:
            over = w.rangeBetween(Window.unboundedPreceding, upto)
            return F.struct(F.count(flag).over(over).alias("n"), F.coalesce(F.sum(flag).over(over), F.lit(0)).alias("high"))

        upto = self._state("upto", source, threshold, build=lambda w: counts(w, 0))
        before = self._state("before", source, threshold, build=lambda w: counts(w, -1))

        def build(w):
            end, start = value_at(F.col(upto), w, delay), value_at(F.col(before), w, reach)
            return F.when(end["n"] - start["n"] == window, (end["high"] - start["high"]) / F.lit(float(window)))

        return self._add(name, source, delay, reach, build)

    def apply(self, df: DataFrame, chunk: int | None = None) -> DataFrame:
        if not self._columns:
            return df
        require_unique_names([*df.columns, *self._columns, *self._states])
        indexed = df if INDEX in df.columns else with_index(df, self.spec)
        staged = chunked(indexed, INDEX, lookback=self._reach, size=chunk)
        w = chunk_window(self.spec.keys, INDEX)
        staged = staged.withColumns({n: build(w) for n, build in self._states.items()}) if self._states else staged
        out = home_rows(staged.withColumns({n: build(w) for n, build in self._columns.items()}).drop(*self._states))
        out = stamped(out, {n: {source: least} for n, (source, least, _) in self.lineage.items()})
        return out if INDEX in df.columns else out.drop(INDEX)


def lag_summary(prefix: str, lags: Sequence[str], names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Mean, deviation, minimum and maximum across lag columns, NULL if any of them is NULL (FE-6)."""
    cols = [F.col(c) for c in lags]
    return {
        f"{prefix}_mean": strict_mean(cols), f"{prefix}_std": strict_std(cols),
        f"{prefix}_min": strict_min(cols), f"{prefix}_max": strict_max(cols),
    }


def spatial_stats(df: DataFrame, ts: Sequence[str], stats: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Mean or max across entities from the long table, NULLs skipped (FE-12): no wide pass is needed."""
    fn = {"mean": F.avg, "max": F.max}
    return df.groupBy(*ts).agg(*[fn[how](column).alias(name) for name, (column, how) in stats.items()])


def direction_parts(degrees: Column) -> tuple[Column, Column]:
    """Sine and cosine of an angle; degrees themselves are never averaged or lagged (FE-11)."""
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def interactions(pairs: Sequence[tuple[str, str, str]]) -> dict[str, Column]:
    """Products of column pairs (FE-15)."""
    return {name: F.col(a).cast("double") * F.col(b).cast("double") for a, b, name in pairs}


def lag_alignment(df: DataFrame, spec: PanelSpec, target: str, lags: Mapping[str, int], tolerance: float = 1e-9) -> DataFrame:
    """Audit: does each stored lag equal the target that many steps earlier? (FE-19)

    The expected value comes from an independent equi-join on the shifted step index: one join for all lags.
    """
    base = with_index(df.select(*spec.key, target, *lags), spec, "_i")
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("lag")) for c, k in lags.items()])).alias("_l")
    source = base.select(*spec.keys, "_i", F.col(target).alias("_expected"), steps)
    source = source.select(*spec.keys, (F.col("_i") + F.col("_l.lag")).alias("_i"), "_l.feature", "_expected")
    stored = base.select(*spec.keys, "_i", *[F.col(c).cast("double").alias(c) for c in lags]).unpivot([*spec.keys, "_i"], list(lags), "feature", "_stored")
    joined = stored.join(source, [*spec.keys, "_i", "feature"], "left")
    both = F.col("_stored").isNotNull() & F.col("_expected").isNotNull()
    worst = F.coalesce(F.max(F.when(both, F.abs(F.col("_stored") - F.col("_expected")))), F.lit(0.0))
    lag = F.element_at(F.create_map(*[F.lit(x) for pair in lags.items() for x in pair]), F.col("feature"))
    return joined.groupBy("feature", lag.alias("lag")).agg(
        F.count_if(both).alias("compared"), worst.alias("max_abs_diff"),
        F.count_if(F.col("_stored").isNull() & F.col("_expected").isNotNull()).alias("null_mismatch"),
        (worst <= tolerance).alias("pass"),
    )


def shares_at(
    history: DataFrame, times: DataFrame, spec: PanelSpec, target: str, threshold: float, windows: Mapping[str, int], delay: int
) -> DataFrame:
    """High-level shares at arbitrary forecast times, straight from history (FE-22).

    For each time: the last W values at least ``delay`` steps old, NULL if there are fewer.  The
    asked times travel through the history's own chunks as rows without a value, so no (time,
    history) pair is ever produced.
    """
    value = F.col(target).cast("double").alias(target)
    rows = history.select(*spec.key, value, F.lit(False).alias("_asked"))
    asked = times.select(*spec.key, F.lit(None).cast("double").alias(target), F.lit(True).alias("_asked"))
    features = History(spec)
    for name, window in windows.items():
        features.share_above(target, threshold, window, delay, name)
    return features.apply(rows.unionByName(asked)).where("_asked").select(*spec.key, *windows)


def lookup(features: DataFrame, times: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """Feature rows at requested times; a time without a row gives NULLs (FE-23)."""
    return times.join(features.select(*spec.key, *columns), spec.key, "left")


def future_calendar(origins: DataFrame, spec: PanelSpec, horizon: int = 24, zone: str = CIVIL_ZONE) -> DataFrame:
    """Calendar features of the steps after each origin (FE-24)."""
    return add_calendar(future_steps(origins, spec, horizon), spec.ts, zone)
