"""Residual corrections (RC-1 … RC-12).

Tables carry ``y``, ``pred`` and ``role`` per group (series and fold).  Addends are means of
actual − prediction over the train rows; every addend is a partial aggregate joined back by group,
so a group with a third of all rows never meets a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.contract import PanelSpec
from panelcast.functions.chunks import chunk_window, chunked, home_rows, value_at
from panelcast.functions.numeric import clip, finite
from panelcast.functions.quantiles import quantiles
from panelcast.operators.grid import INDEX, POSITION

# Time constant of the weighted addend, AR fit window, block length and clip of phi.
TAU_HOURS = 720.0
FIT_WINDOW = 1440
BLOCK = 24
PHI_LIMIT = 0.999


def error() -> Column:
    """Actual minus prediction."""
    return F.col("y") - F.col("pred")


def in_train() -> Column:
    return F.col("role") == "train"


def bias_addend(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean train error per group (RC-2)."""
    return df.where(in_train()).groupBy(*by).agg(F.avg(error()).alias("addend"))


def weighted_addend(df: DataFrame, by: Sequence[str], hours: Column, tau: float = TAU_HOURS) -> DataFrame:
    """Train error weighted by exp((t − t_max) / tau), plain mean if the weights vanish (RC-3).

    ``hours`` is the time of a row in hours.  Sums are first taken per group and tau-long bucket
    relative to the end of the bucket, then rescaled to the latest time: no exponent can overflow
    and no row has to learn the group maximum.
    """
    rows = df.where(in_train() & error().isNotNull()).select(*by, error().alias("_e"), hours.alias("_h"))
    rows = rows.withColumn("_b", F.floor(F.col("_h") / tau).cast("long"))
    weight = F.exp(F.col("_h") / tau - F.col("_b") - 1)
    buckets = rows.groupBy(*by, "_b").agg(
        F.sum(weight * F.col("_e")).alias("_we"), F.sum(weight).alias("_w"), F.sum("_e").alias("_e"),
        F.count(F.lit(1)).alias("_n"),
    )
    last = Window.partitionBy(*by)  # one row per tau-long bucket, not per data row
    scale = F.exp((F.col("_b") - F.max("_b").over(last)).cast("double"))
    scaled = buckets.withColumn("_s", scale)
    sums = scaled.groupBy(*by).agg(
        F.sum(F.col("_we") * F.col("_s")).alias("_we"), F.sum(F.col("_w") * F.col("_s")).alias("_w"),
        (F.sum("_e") / F.sum("_n")).alias("_plain"),
    )
    good = finite(F.col("_w")) > 0
    return sums.select(*by, F.when(good, F.col("_we") / F.col("_w")).otherwise(F.col("_plain")).alias("addend"))


def regime_of(pred: Column, edges: Sequence[Column]) -> Column:
    """0 … 3: how many edges the prediction exceeds (strictly)."""
    out = F.lit(0)
    for i, e in enumerate(edges, start=1):
        out = F.when(pred > e, i).otherwise(out)
    return out


def regime_addends(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges P25/P50/P75 of the train actuals and one addend per predicted regime (RC-4).

    The four addends sit in one row per group; an empty regime takes the overall mean.
    """
    train = df.where(in_train())
    edges = quantiles(train, by, "y", [0.25, 0.5, 0.75]).drop("n")
    regime = regime_of(F.col("pred"), [F.col("q0_25"), F.col("q0_5"), F.col("q0_75")])
    labelled = train.join(edges, list(by)).withColumn("_reg", regime)
    cols = [
        F.coalesce(F.avg(F.when(F.col("_reg") == r, error())), F.avg(error())).alias(f"add_{r}") for r in range(4)
    ]
    return labelled.groupBy(*by, "q0_25", "q0_5", "q0_75").agg(*cols)


def linear_calibration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least squares y = a + b · pred on train; constant predictions give b = 1 (RC-5)."""
    ok = in_train() & error().isNotNull()
    y, p = F.when(ok, F.col("y")), F.when(ok, F.col("pred"))
    sums = df.groupBy(*by).agg(
        F.var_pop(p).alias("_v"), F.covar_pop(p, y).alias("_c"), F.avg(p).alias("_mp"), F.avg(y).alias("_my")
    )
    b = F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(F.lit(1.0))
    return sums.select(*by, (F.col("_my") - b * F.col("_mp")).alias("a"), b.alias("b"))


def correct(df: DataFrame, by: Sequence[str], method: str, hours: Column | None = None) -> DataFrame:
    """Add ``corrected`` by one of the correction methods (RC-1 … RC-5).

    A group without train rows has nothing to learn from and keeps its predictions.
    """
    on = list(by)
    learned = lambda c: F.coalesce(c, F.lit(0.0))
    if method == "no_correction":
        return df.withColumn("corrected", F.col("pred"))
    if method == "fold_train_bias":
        return df.join(bias_addend(df, by), on, "left").withColumn("corrected", F.col("pred") + learned("addend")).drop("addend")
    if method == "expanding_historical":
        out = df.join(weighted_addend(df, by, hours), on, "left")
        return out.withColumn("corrected", F.col("pred") + learned("addend")).drop("addend")
    if method == "regime_aware":
        out = df.join(regime_addends(df, by), on, "left")
        regime = regime_of(F.col("pred"), [F.col("q0_25"), F.col("q0_5"), F.col("q0_75")])
        add = F.element_at(F.array(*[F.col(f"add_{r}") for r in range(4)]), regime + 1)
        return out.withColumn("corrected", F.col("pred") + learned(add)).drop("q0_25", "q0_5", "q0_75", *[f"add_{r}" for r in range(4)])
    if method == "linear_calibration":
        out = df.join(linear_calibration(df, by), on, "left")
        return out.withColumn("corrected", F.coalesce(F.col("a") + F.col("b") * F.col("pred"), F.col("pred"))).drop("a", "b")
    raise ValueError(f"unknown correction method {method}")


# Names of the correction methods.
METHODS = ("no_correction", "fold_train_bias", "expanding_historical", "regime_aware", "linear_calibration")


def specialist_addend(df: DataFrame, by: Sequence[str], detected: Column) -> DataFrame:
    """Extra mean train error where a row is detected as high; none detected gives 0 (RC-6)."""
    hit = in_train() & F.coalesce(detected, F.lit(False))
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(hit, error())), F.lit(0.0)).alias("extra"))


def fit_phi(errors: DataFrame, by: Sequence[str], order: str, column: str = "error", window: int = FIT_WINDOW) -> DataFrame:
    """AR(1) coefficient and last error of the final ``window`` steps of each group (RC-7).

    ``order`` is a step position.  The tail is cut by position first, so the window below sees at
    most ``window`` rows per group; errors that are not finite are dropped before pairing.  A group
    without a finite error in its tail has phi 0 and last error 0.
    """
    ends = errors.groupBy(*by).agg(F.max(order).alias("_end"))
    tail = errors.join(ends, list(by)).where(F.col(order) > F.col("_end") - window)
    tail = tail.withColumn("_r", finite(F.col(column))).where(F.col("_r").isNotNull())
    w = Window.partitionBy(*by).orderBy(order)
    pairs = tail.withColumn("_prev", F.lag("_r").over(w))
    sums = ends.select(*by).join(pairs, list(by), "left").groupBy(*by).agg(
        F.count("_r").alias("_n"), F.sum(F.col("_r") * F.col("_prev")).alias("_num"),
        F.sum(F.when(F.col("_prev").isNotNull(), F.col("_prev") * F.col("_prev"))).alias("_den"),
        F.max_by("_r", order).alias("last_error"),
    )
    usable = (F.col("_n") >= 3) & (F.col("_den") > 0)
    phi = F.when(usable, clip(F.col("_num") / F.col("_den"), -PHI_LIMIT, PHI_LIMIT)).otherwise(F.lit(0.0))
    return sums.select(*by, phi.alias("phi"), F.coalesce("last_error", F.lit(0.0)).alias("last_error"))


def block_correction(df: DataFrame, by: Sequence[str], state: DataFrame, offset: str, block: int = BLOCK, state_delay: int = 0) -> DataFrame:
    """Add phi^k · state inside blocks of ``block`` steps (RC-8).

    ``offset`` counts steps from the start of the scored range.  The state of block b is the last
    error before it, one equi-join away, so no sequential loop is needed; block 0 starts from
    ``last_error``.  ``state_delay`` moves the state that many steps further back (an origin before
    the end of the previous block); k then grows by the delay.
    """
    o = F.col(offset)
    placed = df.withColumn("_block", F.floor(o / block).cast("long")).withColumn("_k", F.pmod(o, F.lit(block)) + 1)
    # the state row of block b sits at offset b * block - 1 - delay
    at = o + 1 + state_delay
    donors = df.where(F.pmod(at, F.lit(block)) == 0).select(
        *by, F.floor(at / block).cast("long").alias("_block"), error().alias("_state")
    )
    joined = placed.join(donors, [*by, "_block"], "left").join(state, list(by), "left")
    phi, last_error = (F.coalesce(c, F.lit(0.0)) for c in ("phi", "last_error"))  # no state: no correction
    start = F.when(F.col("_block") == 0, last_error).otherwise(F.coalesce(F.col("_state"), F.lit(0.0)))
    lead = F.when(F.col("_block") == 0, 0).otherwise(state_delay)
    out = joined.withColumn("ar_add", F.pow(phi, F.col("_k") + lead) * start)
    return out.withColumn("corrected", F.col("pred") + F.col("ar_add")).drop("_block", "_k", "_state", "phi", "last_error")


def horizon_addend(phi: Column, last_error: Column, h: Column) -> Column:
    """phi^h · last error for the h-th future step (RC-9)."""
    return F.pow(phi, h) * last_error


def one_step(df: DataFrame, spec: PanelSpec, by: Sequence[str], state: DataFrame) -> DataFrame:
    """One-step AR diagnostic: phi · previous error; uses t−1 and is not a day-ahead forecast (RC-10)."""
    staged = chunked(df, INDEX, lookback=1)
    previous = home_rows(staged.withColumn("_prev", value_at(error(), chunk_window(by, INDEX), 1)))
    joined = previous.join(state, list(by), "left")
    add = F.coalesce("phi", F.lit(0.0)) * F.coalesce("_prev", "last_error", F.lit(0.0))
    return joined.withColumn("corrected", F.col("pred") + add).drop("_prev", "phi", "last_error")


def lag_one_correlation(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation of successive errors (RC-12)."""
    staged = chunked(df.withColumn("_e", error()), INDEX, lookback=1)
    pairs = home_rows(staged.withColumn("_prev", value_at(F.col("_e"), chunk_window(by, INDEX), 1)))
    return pairs.groupBy(*by).agg(F.corr("_e", "_prev").alias("lag1_corr"))


# --- autoregressive ladder ---------------------------------------------------------------------

# Candidate models and the error lags they use.
AR_CANDIDATES = {"AR1": (1,), "SAR1x24": (1, 24, 25)}


def ar_equations(errors: DataFrame, by: Sequence[str], order: str, column: str = "error", window: int = FIT_WINDOW) -> DataFrame:
    """Cross products of the error and its lags {1, 24, 25} over the last ``window`` steps: the normal
    equations of every candidate come from this one small row per group."""
    ends = errors.groupBy(*by).agg(F.max(order).alias("_end"))
    tail = errors.join(ends, list(by)).where(F.col(order) > F.col("_end") - window)
    # at most ``window`` rows per group are left
    w = Window.partitionBy(*by).orderBy(order)
    at = lambda k: F.first(F.col(column)).over(w.rangeBetween(-k, -k))
    z = tail.select(*by, F.col(column).alias("z0"), at(1).alias("z1"), at(24).alias("z24"), at(25).alias("z25")).dropna()
    names = ["z0", "z1", "z24", "z25"]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *products)


def fit_ar_ladder(equations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Conditional least squares and Gaussian AIC of every candidate per group (RC-11)."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in equations.select(*by).schema)
    schema = f"{key_schema}, model string, n_params int, coef array<double>, aic double"
    keys = list(by)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                get = lambda a, b: row.get(f"z{a}_z{b}", row.get(f"z{b}_z{a}"))
                for name, lags in AR_CANDIDATES.items():
                    gram = np.array([[get(a, b) for b in lags] for a in lags], dtype=float)
                    rhs = np.array([get(0, a) for a in lags], dtype=float)
                    coef = np.linalg.lstsq(gram, rhs, rcond=None)[0]
                    sse = max(row["z0_z0"] - float(coef @ rhs), 1e-300)
                    sigma2 = sse / row["n"]
                    aic = row["n"] * (np.log(2 * np.pi * sigma2) + 1.0) + 2.0 * (len(lags) + 1)
                    out.append({**{k: row[k] for k in keys}, "model": name, "n_params": len(lags), "coef": coef.tolist(), "aic": float(aic)})
            yield pd.DataFrame(out)

    return equations.mapInPandas(solve, schema)


def choose_ar(ladder: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lowest mean AIC over folds, then fewer parameters."""
    mean = ladder.groupBy(*by, "model", "n_params").agg(F.avg("aic").alias("mean_aic"))
    return mean.groupBy(*by).agg(F.min_by("model", F.struct("mean_aic", "n_params", "model")).alias("model"))


def ar_block_forecast(df: DataFrame, by: Sequence[str], ladder: DataFrame, offset: str, block: int = BLOCK) -> DataFrame:
    """Forecast errors in blocks from the errors known at the start of each block (RC-11).

    ``df`` holds train and scored rows; scored rows have ``offset >= 0``.  Each block with its 25
    preceding errors is one array row, built by grouping on (group, block): 49 values at most,
    however long the series is.  The recursion inside a block runs vectorised over blocks.
    """
    depth = 25
    o = F.col(offset)
    base = df.where(o >= -depth).select(*by, offset, error().alias("_e"))
    reach = F.sequence(F.floor(F.greatest(o, F.lit(0)) / block), F.floor((o + depth) / block))
    # a row serves its own block and every block that starts within the next 25 steps
    member = base.withColumn("_block", F.explode(F.filter(reach, lambda b: b >= 0)))
    slot = (o - F.col("_block") * block).cast("int")
    arrays = member.groupBy(*by, "_block").agg(
        F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), F.coalesce(F.col("_e"), F.lit(0.0)).alias("v")))).alias("_m"),
        F.max(slot).alias("_last"),
    )
    history = F.array(*[F.coalesce(F.element_at("_m", F.lit(-k)), F.lit(0.0)) for k in range(depth, 0, -1)])
    ready = arrays.where(F.col("_last") >= 0).select(*by, "_block", history.alias("history")).join(ladder, list(by))
    keys = list(by)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.select(*keys).schema)
    schema = f"{key_schema}, model string, _block long, path array<double>"
    lags_of = AR_CANDIDATES

    def forecast(batches):
        for pdf in batches:
            out = []
            for model, part in pdf.groupby("model", sort=False):
                lags = lags_of[model]
                z = np.zeros((len(part), depth + block))
                z[:, :depth] = np.vstack(part["history"].to_numpy())
                coef = np.vstack(part["coef"].to_numpy())
                for k in range(depth, depth + block):
                    z[:, k] = sum(coef[:, j] * z[:, k - lag] for j, lag in enumerate(lags))
                out.append(part[[*keys, "model", "_block"]].assign(path=list(z[:, depth:])))
            if out:
                yield pd.concat(out)

    paths = ready.select(*keys, "model", "_block", "history", "coef").mapInPandas(forecast, schema)
    flat = paths.select(*keys, "model", "_block", F.posexplode("path").alias("_k", "ar_add"))
    flat = flat.select(*keys, "model", (F.col("_block") * block + F.col("_k")).alias(offset), "ar_add")
    scored = df.where(o >= 0).join(flat, [*keys, offset])
    return scored.withColumn("corrected", F.col("pred") + F.col("ar_add"))


def with_offset(df: DataFrame, cut: str = "cut") -> DataFrame:
    """``offset``: steps since the start of the scored block (negative on train rows)."""
    return df.withColumn("offset", F.col(POSITION) - F.col(cut))
