"""Linear models from one distributed Gram matrix (MD-1 … MD-7, MD-11, MD-13 … MD-16).

Rows meet only in partial sums: each task turns its Arrow batches into (p+2)² cross products per
group, the upper triangles are added up as whole arrays keyed on (group, salt), then on the group, and the p × p
systems are solved inside tasks, one group per row.  The driver sees no data row, no matrix and no coefficient.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.contract import ContractError, require_columns
from panelcast.functions.numeric import balanced_sum, strict_mean
from panelcast.operators.prep import SCALER_FIELDS, fit_scaler, standardised
from panelcast.operators.splits import MIN_TAIL_ROWS
from panelcast.sources.staging import stage

# Regularisation grids of the tuning stages.
ALPHA_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
ENET_ALPHAS = (0.001, 0.01, 0.1, 1.0)
ENET_L1_RATIOS = (0.1, 0.5, 0.9)
SWEEP_LIMIT, SWEEP_TOLERANCE = 250, 1e-4
BOOSTER_LAMBDAS = (1e-6, 1e-5, 1e-4, 1e-3, 3e-3, 1e-2)
BOOSTER_RATES = (0.1, 0.3, 1.0)
BOOSTER_SELECTORS = ("cyclic", "shuffle")
BOOSTER_ROUNDS, BOOSTER_PATIENCE, BOOSTER_LEAST = 300, 40, 10
SEED = 42
FINAL_ALPHA = 0.001
META_ALPHA = 0.001

# Cross products held per task before they are handed on (doubles).
HELD_CELLS = 4_000_000
#: Tasks in which the partial sums of one group first meet.
SALTS = 16


def naive_prediction(lag: str) -> Column:
    """Last known same-hour value; a NULL is an error of the caller's row set, so it fails (MD-1)."""
    return F.coalesce(F.col(lag), F.raise_error(F.lit(f"naive prediction: {lag} is NULL")).cast("double"))


def naive_forecast(df: DataFrame, lag: str, name: str = "pred") -> DataFrame:
    """Rows with the naive prediction; a row without it fails the job whatever columns are read afterwards (MD-1)."""
    known = F.when(F.col(lag).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"naive prediction: {lag} is NULL")).cast("boolean"))
    return df.where(known).withColumn(name, F.col(lag))


def mean_of_lags(lags: Sequence[str]) -> Column:
    return strict_mean([F.col(c) for c in lags])


def _keys_schema(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)


def gram(df: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y", weight: str | None = None, scaler: DataFrame | None = None,
         scaler_by: Sequence[str] | None = None) -> DataFrame:
    """Per group the cross products of (x₁ … x_p, y, 1): one row with ``n`` and the flat upper triangle.

    With a ``scaler`` (of ``scaler_by``, else of the same groups) the columns are imputed and standardised inside the
    same stage.  A task holds at most ``HELD_CELLS`` numbers and the matrix of one group, whatever the number of groups.
    """
    by, p = list(by), len(columns)
    rows = df.where(F.col(y).isNotNull())
    if scaler is not None:
        rows = rows.join(scaler, list(scaler_by or by))
        x = standardised(columns)
    else:
        x = [F.col(c).cast("double") for c in columns]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    packed = rows.select(*by, F.array(*x).alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    upper = np.triu_indices(p + 2)

    def partial(batches):
        held: dict[tuple, list] = {}  # group → [rows, cross products]; never more than HELD_CELLS numbers

        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.num_rows
            z = np.empty((n, p + 2))
            z[:, :p] = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            z[:, p] = batch.column("_y").to_numpy(zero_copy_only=False)
            z[:, p + 1] = 1.0
            z *= np.sqrt(batch.column("_w").to_numpy(zero_copy_only=False))[:, None]
            code, first = _codes(batch, by)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for index in np.split(order, cuts):
                key = first[code[index[0]]]
                part = z[index]
                product = (part.T @ part)[upper]
                if key in held:
                    held[key][0] += len(index)
                    held[key][1] += product
                else:
                    held[key] = [len(index), product]
                    if len(held) * len(product) > HELD_CELLS:
                        yield from _partials(held, batch.schema, by)
                        held.clear()
        if held:
            yield from _partials(held, batch.schema, by)

    keys = _keys_schema(packed, by)
    parts = packed.mapInArrow(partial, f"{keys}, _n long, _cells array<double>").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    # whole matrices are added up, first per (group, salt), so that a hot group's partial sums meet in several tasks
    some = added_up(parts, [*by, "_salt"]).drop("_salt")
    return added_up(some, by).withColumnsRenamed({"_n": "n", "_cells": "cells"})


def _codes(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Number of every row's group, and the groups; NULL is a key like any other."""
    numbers = np.zeros(batch.num_rows, dtype=np.int64)
    for name in by:
        column = batch.column(name).dictionary_encode("encode")
        numbers = numbers * max(len(column.dictionary), 1) + column.indices.to_numpy(zero_copy_only=False)
        numbers = np.unique(numbers, return_inverse=True)[1]  # small again, whatever the number of key columns
    _, at, code = np.unique(numbers, return_index=True, return_inverse=True)
    columns = [batch.column(name).take(pa.array(at)).to_pylist() for name in by]
    return code, list(zip(*columns)) if by else [()] * len(at)


def _partials(held: Mapping[tuple, list], schema: pa.Schema, by: Sequence[str], chunk: int = 256):
    """Groups with their row counts and cross products, a bounded number of them per batch."""
    items = list(held.items())
    for at in range(0, len(items), chunk):
        some = items[at : at + chunk]
        columns = [pa.array([k[i] for k, _ in some], type=schema.field(name).type) for i, name in enumerate(by)]
        cells = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * len(some[0][1][1]), pa.array(np.concatenate([v[1] for _, v in some])))
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for _, v in some], pa.int64()), cells], names=[*by, "_n", "_cells"])


def added_up(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sums of ``_cells`` and sums of ``_n`` per group: rows come sorted by key, so a task holds one sum."""
    keys = list(keys)

    def run(batches):
        key, n, total, schema = None, 0, None, None
        for batch in batches:
            schema = batch.schema
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            counts, cells = batch.column("_n").to_numpy(), batch.column("_cells")
            for i, name in enumerate(names):
                row = cells[i].values.to_numpy()
                if total is not None and name == key:
                    n, total = n + counts[i], total + row
                    continue
                if total is not None:
                    yield from _partials({key: [n, total]}, schema, keys)
                key, n, total = name, counts[i], row
        if total is not None:
            yield from _partials({key: [n, total]}, schema, keys)

    together = parts.select(*keys, "_n", "_cells").repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, f"{_keys_schema(parts, keys)}, _n long, _cells array<double>")


def _unpack(cells, p: int) -> np.ndarray:
    m = np.zeros((p + 2, p + 2))
    m[np.triu_indices(p + 2)] = np.asarray(cells, dtype=float)
    return m + np.triu(m, 1).T


def _normal_equations(cells, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X, X'(y − ȳ), ȳ and the total weight."""
    m = _unpack(cells, p)
    total = m[p + 1, p + 1]
    y_mean = m[p, p + 1] / total
    return m[:p, :p], m[:p, p] - y_mean * m[:p, p + 1], float(y_mean), float(total)


def _solve_groups(grams: DataFrame, by: Sequence[str], schema: str, solver) -> DataFrame:
    keys = list(by)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                base = {k: rec[k] for k in keys}
                rows += [{**base, **r} for r in solver(rec["cells"], rec["n"])]
            if rows:
                yield pd.DataFrame(rows)

    return grams.mapInPandas(run, f"{_keys_schema(grams, by)}, {schema}")


def solve_ridge(grams: DataFrame, by: Sequence[str], p: int, alphas: Sequence[float], subsets: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """(X'X + αI) w = X'(y − ȳ) for every α from the same Gram (MD-3, MD-4).

    ``subsets`` names index lists: each is solved on its block of the Gram and its coefficients are
    placed back with zeros elsewhere, so nested feature sets share one pass over the data.
    """
    alphas = [float(a) for a in alphas]
    chosen = {name: list(index) for name, index in (subsets or {"": range(p)}).items()}

    def solver(cells, n):
        xtx, xty, y_mean, _ = _normal_equations(cells, p)
        for name, index in chosen.items():
            block, rhs = xtx[np.ix_(index, index)], xty[index]
            for a in alphas:
                w = np.zeros(p)
                w[index] = np.linalg.solve(block + a * np.eye(len(index)), rhs)
                yield {"method": name, "alpha": a, "coef": w.tolist(), "intercept": y_mean}

    out = _solve_groups(grams, by, "method string, alpha double, coef array<double>, intercept double", solver)
    return out if subsets else out.drop("method")


def solve_weights(grams: DataFrame, by: Sequence[str], p: int, weights: Sequence[float], alpha: float = FINAL_ALPHA) -> DataFrame:
    """Ridge for every weight of the high rows from the Grams of low and high rows: G(w) = G(low) + w G(high) (MD-6)."""
    weights = [float(w) for w in weights]
    sides = [F.first(F.when(F.col("_high") == flag, F.col(c)), ignorenulls=True).alias(f"{c}{int(flag)}") for flag in (False, True) for c in ("cells", "n")]
    pairs = grams.groupBy(*by).agg(*sides)  # two rows a group
    both = pairs.select(*by, F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n"), F.col("cells0"), F.col("cells1").alias("cells"))

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                low, up = (np.zeros((p + 2) * (p + 3) // 2) if c is None else np.asarray(c, dtype=float) for c in (rec["cells0"], rec["cells"]))
                for w in weights:
                    xtx, xty, y_mean, _ = _normal_equations(low + w * up, p)
                    coef = np.linalg.solve(xtx + alpha * np.eye(p), xty)
                    rows.append({**{k: rec[k] for k in by}, "high_weight": w, "alpha": alpha, "coef": coef.tolist(), "intercept": y_mean})
            if rows:
                yield pd.DataFrame(rows)

    return both.mapInPandas(run, f"{_keys_schema(grams, by)}, high_weight double, alpha double, coef array<double>, intercept double")


def _soft(rho: float, limit: float) -> float:
    return np.sign(rho) * max(abs(rho) - limit, 0.0)


def _coordinate_descent(xtx, xty, l1: float, l2: float, sweeps: int, tolerance: float, rate: float = 1.0, stops=(), shuffled: bool = False):
    """Coordinate descent on the p × p problem, keeping the gradient current; yields (sweep, weights) at ``stops`` and the end.

    ``shuffled`` visits the coordinates of every sweep in a new seeded order.
    """
    p = len(xty)
    w, gradient, diag = np.zeros(p), xty.copy(), np.diag(xtx).copy()
    draw = np.random.default_rng(SEED)
    for sweep in range(1, sweeps + 1):
        largest = 0.0
        for j in draw.permutation(p) if shuffled else range(p):
            denominator = diag[j] + l2
            target = _soft(gradient[j] + diag[j] * w[j], l1) / denominator if denominator > 0 else 0.0
            delta = rate * (target - w[j])
            if delta:
                w[j] += delta
                gradient -= delta * xtx[:, j]
            largest = max(largest, abs(delta))
        if sweep in stops:
            yield sweep, w.copy()
        if largest < tolerance:
            break
    yield 0, w


def solve_elastic_net(grams: DataFrame, by: Sequence[str], p: int, alphas: Sequence[float] = ENET_ALPHAS, l1_ratios: Sequence[float] = ENET_L1_RATIOS) -> DataFrame:
    """Elastic net by cyclic coordinate descent on Gram / n (MD-7)."""
    grid = [(float(a), float(r)) for a in alphas for r in l1_ratios]

    def solver(cells, n):
        xtx, xty, y_mean, total = _normal_equations(cells, p)
        for a, r in grid:
            *_, (_, w) = _coordinate_descent(xtx / total, xty / total, a * r, a * (1 - r), SWEEP_LIMIT, SWEEP_TOLERANCE)
            yield {"alpha": a, "l1_ratio": r, "coef": w.tolist(), "intercept": y_mean}

    return _solve_groups(grams, by, "alpha double, l1_ratio double, coef array<double>, intercept double", solver)


def booster_grid(lambdas: Sequence[float] = BOOSTER_LAMBDAS, rates: Sequence[float] = BOOSTER_RATES, selectors: Sequence[str] = BOOSTER_SELECTORS) -> list[tuple[float, float, str]]:
    return [(float(a), float(r), s) for a in lambdas for r in rates for s in selectors]


def booster_path(xtx: np.ndarray, xty: np.ndarray, config: tuple[float, float, str], rounds: int) -> np.ndarray:
    """Weights after every round of L2 coordinate descent (rounds × p)."""
    lam, rate, selector = config
    steps = _coordinate_descent(xtx, xty, 0.0, lam, rounds, 0.0, rate, range(1, rounds + 1), selector == "shuffle")
    out = [w for sweep, w in steps if sweep]
    return np.array(out + out[-1:] * (rounds - len(out)))  # a descent that came to rest stays there


BOOSTER_KEYS = ("reg_lambda", "rate", "selector")


def solve_booster_paths(grams: DataFrame, by: Sequence[str], p: int, grid: Sequence[tuple[float, float, str]], rounds: int) -> DataFrame:
    """One row for each group and configuration with the flat weights of all rounds (MD-11)."""

    def solver(cells, n):
        xtx, xty, y_mean, total = _normal_equations(cells, p)
        for config in grid:
            yield {**dict(zip(BOOSTER_KEYS, config)), "path": booster_path(xtx / total, xty / total, config, rounds).ravel().tolist(), "intercept": y_mean}

    return _solve_groups(grams, by, "reg_lambda double, rate double, selector string, path array<double>, intercept double", solver)


def path_losses(stop: DataFrame, paths: DataFrame, scaler: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y") -> DataFrame:
    """Sum of absolute errors on the stopping rows after every round: (by, configuration, _n, _cells).

    Rows travel as blocks of a batch's rows of one group, so a path is copied once for a block, not for a row, and a
    group with a third of all rows is many blocks.
    """
    by, p = list(by), len(columns)
    rows = stop.where(F.col(y).isNotNull()).join(scaler, by)
    packed = rows.select(*by, F.array(*standardised(columns)).alias("_z"), F.col(y).cast("double").alias("_y"))
    keys = _keys_schema(packed, by)

    def blocks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            target = batch.column("_y").to_numpy(zero_copy_only=False)
            code, first = _codes(batch, by)
            order = np.argsort(code, kind="stable")
            for index in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                held = [pa.array([v], type=batch.schema.field(k).type) for k, v in zip(by, first[code[index[0]]])]
                yield pa.RecordBatch.from_arrays([*held, pa.array([z[index].ravel()], pa.list_(pa.float64())), pa.array([target[index]], pa.list_(pa.float64()))], names=[*by, "_z", "_y"])

    def losses(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                target = batch.column("_y")[i].values.to_numpy()
                z = batch.column("_z")[i].values.to_numpy().reshape(len(target), p)
                path = batch.column("path")[i].values.to_numpy().reshape(-1, p)
                off = np.abs(z @ path.T + (batch.column("intercept")[i].as_py() - target)[:, None]).sum(axis=0)
                out.append((len(target), off))
            if out:
                kept = [batch.column(c) for c in (*by, *BOOSTER_KEYS)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out], pa.list_(pa.float64()))], names=[*by, *BOOSTER_KEYS, "_n", "_cells"])

    tail = packed.mapInArrow(blocks, f"{keys}, _z array<double>, _y array<double>").join(paths, by)
    parts = tail.mapInArrow(losses, f"{keys}, reg_lambda double, rate double, selector string, _n long, _cells array<double>")
    return added_up(parts, [*by, *BOOSTER_KEYS])


def stopping_round(losses: Column, patience: int = BOOSTER_PATIENCE, least: int = BOOSTER_LEAST) -> Column:
    """Round (from 1) of the least loss that ``patience`` further rounds did not better; ``least`` at least.

    The state runs along the losses in SQL: (best loss, its round, has it stopped).
    """
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(False).alias("done"))

    def step(state, loss):
        k = state["k"] + 1
        better = ~state["done"] & (loss < state["best"])
        done = state["done"] | (~better & (k - state["at"] >= patience))
        return F.struct(F.when(better, loss).otherwise(state["best"]).alias("best"), F.when(better, k).otherwise(state["at"]).alias("at"), k.alias("k"), done.alias("done"))

    return F.least(F.greatest(F.aggregate(losses, start, step)["at"], F.lit(least)), F.size(losses)).cast("int")


def with_scaler(models: DataFrame, scaler: DataFrame, by: Sequence[str]) -> DataFrame:
    """Model rows that carry everything scoring needs."""
    return models.join(scaler, list(by))


def fit_ridge(train: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y", alphas: Sequence[float] = (FINAL_ALPHA,), weight: str | None = None) -> DataFrame:
    """Median-impute, standardise and fit ridge per group (MD-3, MD-4, MD-5).

    Stages two small tables, one row per group: the scaler and the models.
    With ``weight`` the centre of y is the weighted mean while X keeps its unweighted scaling.
    """
    require_columns(train, [*by, *columns, y])
    scaler = stage(fit_scaler(train, by, columns))
    grams = gram(train, by, columns, y, weight, scaler)
    return stage(with_scaler(solve_ridge(grams, by, len(columns), alphas), scaler, by))


def fit_elastic_net(train: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y", alphas: Sequence[float] = ENET_ALPHAS,
                    l1_ratios: Sequence[float] = ENET_L1_RATIOS) -> DataFrame:
    scaler = stage(fit_scaler(train, by, columns))
    grams = gram(train, by, columns, y, scaler=scaler)
    return stage(with_scaler(solve_elastic_net(grams, by, len(columns), alphas, l1_ratios), scaler, by))


def linear_terms(columns: Sequence[str]) -> list[Column]:
    """Contribution of each feature to the prediction of a row joined with its model row."""
    return [F.col("coef")[i] * z for i, z in enumerate(standardised(columns))]


def score(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "pred") -> DataFrame:
    """Predictions for every model of the row's group; all of them come from one scan (MD-4, EV-18).

    Rows of a group without a model stay, with a NULL prediction.
    """
    joined = df.join(models, list(by), "left")
    pred = balanced_sum(linear_terms(columns)) + F.col("intercept")
    return joined.withColumn(name, pred).drop("coef", "intercept", *SCALER_FIELDS)


def score_frozen(df: DataFrame, model: dict, name: str = "pred") -> DataFrame:
    """Score with one archived model, by column name: impute → scale → dot → intercept + addend (MD-16)."""
    missing = [c for c in model["names"] if c not in df.columns]
    if missing:
        raise ContractError(f"model columns missing: {missing}")
    terms = []
    for c, med, mu, sd, w in zip(model["names"], model["medians"], model["means"], model["scales"], model["coef"]):
        x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(med)))
        terms.append((x - F.lit(float(mu))) / F.lit(float(sd)) * F.lit(float(w)))
    return df.withColumn(name, balanced_sum(terms) + F.lit(float(model["intercept"])) + F.lit(float(model.get("addend", 0.0))))


def coefficient_table(models: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long coefficients ``(by, feature, coefficient)`` (EV-17)."""
    pairs = F.arrays_zip(F.col("names").alias("feature"), F.col("coef").alias("coefficient"))
    return models.select(*by, F.inline(pairs)).toDF(*by, "feature", "coefficient")


def two_variable_ols(df: DataFrame, by: Sequence[str], x1: str, x2: str, y: str = "y") -> DataFrame:
    """Unscaled least-squares weights of two predictors, closed form from one aggregate (MD-14)."""
    a, b, t = F.col(x1), F.col(x2), F.col(y)
    m = df.groupBy(*by).agg(
        F.var_pop(a).alias("_aa"), F.var_pop(b).alias("_bb"), F.covar_pop(a, b).alias("_ab"),
        F.covar_pop(a, t).alias("_ay"), F.covar_pop(b, t).alias("_by"),
        F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.avg(t).alias("_my"),
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    w1 = F.when(det > 0, (F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab")) / det)
    w2 = F.when(det > 0, (F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab")) / det)
    return m.select(*by, w1.alias("w1"), w2.alias("w2"), (F.col("_my") - w1 * F.col("_ma") - w2 * F.col("_mb")).alias("intercept"))


def average(predictions: Sequence[str]) -> Column:
    """Equal-weight average of predictions (MD-15)."""
    return strict_mean([F.col(c) for c in predictions])


def choose_weight(df: DataFrame, by: Sequence[str], columns: Sequence[str], threshold: str, weights: Sequence[float] = (1.0, 2.0, 3.0),
                  y: str = "y", alpha: float = FINAL_ALPHA) -> DataFrame:
    """Weight for rows at or above a threshold, chosen by MAE on the inner tail (MD-6).

    ``df`` carries ``inner_role`` (fit / stop).  The scaler comes from the whole train block, as the
    weighted fit that follows uses it too.  One pass makes the Grams of low and of high rows; every candidate's
    Gram is their weighted sum.  A group whose tail is shorter than ``MIN_TAIL_ROWS`` cannot choose and keeps weight 1.
    """
    fit = F.col("inner_role") == "fit"
    scaler = stage(fit_scaler(df, by, columns))
    high = F.coalesce(F.col(y) >= F.col(threshold), F.lit(False)).alias("_high")
    grams = gram(df.where(fit).select(*by, *columns, y, high), [*by, "_high"], columns, y, scaler=scaler, scaler_by=by)
    models = stage(solve_weights(grams, by, len(columns), weights, alpha).join(scaler, list(by)))
    scored = score(df.where(~fit), models, by, columns)
    maes = scored.groupBy(*by, "high_weight").agg(F.avg(F.abs(F.col("pred") - F.col(y))).alias("mae"))
    # a larger weight must beat a smaller one by more than rounding noise
    chosen = maes.where("mae IS NOT NULL").groupBy(*by).agg(F.min_by("high_weight", F.struct(F.round("mae", 12), "high_weight")).alias("_best"))
    tails = df.groupBy(*by).agg(F.count_if(~fit).alias("_tail")).join(chosen, list(by), "left")
    return tails.select(*by, F.when(F.col("_tail") >= MIN_TAIL_ROWS, F.coalesce("_best", F.lit(1.0))).otherwise(F.lit(1.0)).alias("high_weight"))


def fit_booster(train: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y", lambdas: Sequence[float] = BOOSTER_LAMBDAS, rates: Sequence[float] = BOOSTER_RATES,
                rounds: int | Sequence[int] = BOOSTER_ROUNDS, selectors: Sequence[str] = BOOSTER_SELECTORS, patience: int = BOOSTER_PATIENCE, least: int = BOOSTER_LEAST) -> DataFrame:
    """L2 booster per configuration: rounds are chosen by MAE on the inner tail, then the whole train block is fitted
    with as many (MD-11).

    ``rounds`` is a limit, within which ``patience`` stops, or a list of rounds to choose from.  A group without a tail
    takes ``least`` rounds.
    """
    grid = booster_grid(lambdas, rates, selectors)
    limit = rounds if isinstance(rounds, int) else max(rounds)
    fit, stop = train.where(F.col("inner_role") == "fit"), train.where(F.col("inner_role") == "stop")
    p, by, config = len(columns), list(by), list(BOOSTER_KEYS)
    scaler = stage(fit_scaler(train, by, columns))
    paths = stage(solve_booster_paths(gram(fit, by, columns, y, scaler=scaler), by, p, grid, limit))
    losses = path_losses(stop, paths, scaler, by, columns, y).withColumn("_mae", F.transform("_cells", lambda c: c / F.col("_n")))
    if isinstance(rounds, int):
        at = stopping_round(F.col("_mae"), patience, least)
    else:
        listed = F.array(*[F.struct(F.element_at("_mae", r).alias("mae"), F.lit(r).alias("at")) for r in rounds])
        at = F.array_min(listed)["at"]
    chosen = losses.select(*by, *config, at.alias("rounds"), F.array_min("_mae").alias("stop_mae"))
    full = solve_booster_paths(gram(train, by, columns, y, scaler=scaler), by, p, grid, limit)
    full = full.join(chosen, [*by, *config], "left").withColumn("rounds", F.coalesce("rounds", F.lit(min(least, limit))))
    full = full.withColumn("coef", F.slice("path", (F.col("rounds") - 1) * p + 1, F.lit(p))).drop("path")
    return stage(with_scaler(full, scaler, by))
