"""Walk-forward comparison of strategies and the frozen final pipeline (RC-13, FC-3, MD-13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.contract import PanelSpec
from panelcast.functions.quantiles import quantiles
from panelcast.operators import boosting, evaluate, linear, residual, splits
from panelcast.operators.features import History, interactions
from panelcast.operators.prep import fit_scaler
from panelcast.sources.staging import stage

BASELINE = "CURRENT_BEST"
# Strategy names.
STRATEGIES = (BASELINE, "METHOD_A", "METHOD_B", "METHOD_C", "METHOD_D", "METHOD_E")


def add_levels(df: DataFrame, spec: PanelSpec, windows: Mapping[str, int], delay: int, target: str = "y") -> DataFrame:
    """Recent level: rolling mean and deviation per window (method A)."""
    h = History(spec)
    for label, window in windows.items():
        h.rolling(target, window, delay, f"level_mean_{label}", f"level_std_{label}")
    return h.apply(df)


def add_shares(df: DataFrame, spec: PanelSpec, windows: Mapping[str, int], delay: int, threshold: Column, target: str = "y", history: str = "joined") -> DataFrame:
    """High-level shares per window (method B).

    ``history="joined"`` lets validation rows look back into the train block, as the final model
    does; ``"block"`` computes them on each block alone, so its first rows are NULL.
    """
    keys = tuple(spec.keys) + (("role",) if history == "block" else ())
    h = History(PanelSpec(keys, spec.ts, spec.step_seconds))
    for label, window in windows.items():
        h.share_above(target, threshold, window, delay, f"share_high_{label}")
    return h.apply(df)


def strategies(
    fold_rows: DataFrame, by: Sequence[str], spec: PanelSpec, base: Sequence[str], levels: Mapping[str, int], shares: Mapping[str, int], delay: int,
    pairs: Sequence[tuple[str, str, str]], recent: str, hours: Column, alpha: float = linear.FINAL_ALPHA, history: str = "joined",
) -> DataFrame:
    """Corrected predictions of all strategies on the same folds as ``(by, ts, y, role, method, pred, corrected)``.

    All unweighted strategies use nested feature sets, so they share one scaler and one Gram: each
    solves its own block of it.  Only the weighted strategy needs a second Gram.
    """
    on = list(by)
    fold_spec = PanelSpec(tuple(by), spec.ts, spec.step_seconds)
    train = F.col("role") == "train"
    fold_rows = stage(fold_rows)
    thresholds = stage(quantiles(fold_rows.where(train), by, "y", [0.75]).select(*on, F.col("q0_75").alias("p75")))
    rows = add_levels(fold_rows.join(thresholds, on, "left"), fold_spec, levels, delay)
    rows = add_shares(rows, fold_spec, shares, delay, F.col("p75"), history=history)
    # read by the scaler, two Gram passes, the weight search and the scoring scan
    rows = stage(rows.withColumns(interactions(pairs)))

    level_cols = [f"level_{s}_{n}" for n in levels for s in ("mean", "std")]
    share_cols = [f"share_high_{n}" for n in shares]
    pair_cols = [name for *_, name in pairs]
    columns = [*base, *level_cols, *share_cols, *pair_cols]
    at = {c: i for i, c in enumerate(columns)}
    index = lambda names: [at[c] for c in names]
    sets = {
        BASELINE: index(base), "METHOD_A": index([*base, *level_cols]), "METHOD_B": index([*base, *share_cols]),
        "METHOD_C": index([*base, *level_cols, *pair_cols]), "METHOD_D": index(base),
    }
    scaler = stage(fit_scaler(rows.where(train), by, columns))
    gram = linear.gram(rows.where(train), by, columns, scaler=scaler)
    models = linear.solve_ridge(gram, by, len(columns), [alpha], sets)

    weighted = rows.where(train)
    tail = splits.inner_tail(weighted, F.col("cut"))
    inner = stage(quantiles(tail.where(F.col("inner_role") == "fit"), by, "y", [0.75]).select(*on, F.col("q0_75").alias("inner_p75")))
    weight = stage(linear.choose_weight(tail.join(inner, on, "left"), by, base, "inner_p75", alpha=alpha))
    weighted = weighted.join(weight, on).withColumn("_w", F.when(F.col("y") >= F.col("p75"), F.col("high_weight")).otherwise(1.0))
    heavy = linear.solve_ridge(linear.gram(weighted, by, columns, weight="_w", scaler=scaler), by, len(columns), [alpha], {"METHOD_E": index(base)})

    models = stage(linear.with_scaler(models.unionByName(heavy), scaler, by))
    scored = stage(linear.score(rows, models, by, columns).select(*on, spec.ts, "pos", "cut", "role", "method", "y", "pred", "p75", recent, level_cols[0]))
    keyed = [*by, "method"]
    out = residual.correct(scored, keyed, "expanding_historical", hours)
    high = (F.col("method") == "METHOD_D") & ((F.col(recent) > F.col("p75")) | (F.col(level_cols[0]) > F.col("p75")))
    out = out.withColumn("_high", F.coalesce(high, F.lit(False)))
    extra = residual.specialist_addend(out.withColumn("pred", F.col("corrected")), keyed, F.col("_high"))
    out = out.join(extra, keyed).withColumn("corrected", F.col("corrected") + F.when(F.col("_high"), F.col("extra")).otherwise(0.0))
    return out.select(*on, spec.ts, "pos", "cut", "role", "method", "y", "pred", "corrected", "p75")


def compare(predictions: DataFrame, by: Sequence[str], over: Sequence[str] = ()) -> DataFrame:
    """Fold metrics of the corrected predictions summarised per strategy, with the high-level bias."""
    validation = predictions.where(F.col("role") == "validation").withColumn("pred", F.col("corrected"))
    folds = evaluate.metrics(validation, [*by, "method"])
    high = validation.groupBy(*by, "method").agg(F.avg(F.when(F.col("y") >= F.col("p75"), F.col("pred") - F.col("y"))).alias("p75_bias"))
    summary = evaluate.summarise_folds(folds, [*over, "method"])
    bias = high.groupBy(*over, "method").agg(F.avg("p75_bias").alias("mean_p75_bias"))
    return summary.join(bias, [*over, "method"])


def frozen_pipeline(
    rows: DataFrame, spec: PanelSpec, base: Sequence[str], shares: Mapping[str, int], delay: int, hours: Column, alpha: float = linear.FINAL_ALPHA, block: int = residual.BLOCK,
) -> dict[str, DataFrame]:
    """Fit on development, score the locked test split once (FC-3).

    ``rows`` carries ``split``, ``pos`` and ``n_steps``.  Everything learned — thresholds, scaler,
    coefficients, addend, AR state — comes from development rows; test rows only meet it in the
    final scoring.
    """
    by = list(spec.keys)
    dev = F.col("split") != "test"
    rows = rows.withColumn("role", F.when(dev, "train").otherwise("validation"))
    rows = stage(rows)
    thresholds = stage(quantiles(rows.where(dev), by, "y", list(evaluate_probs())).drop("n"))
    full = stage(add_shares(rows.join(thresholds, by), spec, shares, delay, F.col("q0_75")))
    columns = [*base, *[f"share_high_{n}" for n in shares]]
    model = linear.fit_ridge(full.where(dev), by, columns, alphas=[alpha])
    scored = stage(linear.score(full, model, by, columns))
    addend = residual.weighted_addend(scored, by, hours)
    shifted = scored.join(addend, by, "left").withColumn("pred", F.col("pred") + F.coalesce("addend", F.lit(0.0))).drop("addend")
    state = residual.fit_phi(shifted.where(dev).withColumn("error", F.col("y") - F.col("pred")), by, "pos")
    test = shifted.where(~dev).withColumn("offset", F.col("pos") - splits.cut_at(F.col("n_steps"), splits.VALIDATION_END))
    corrected = residual.block_correction(test, by, state, "offset", block)
    archive = model.join(addend, by, "left").join(state, by, "left").fillna(0.0, ["addend", "phi", "last_error"])
    return {"model": archive, "thresholds": thresholds, "test": corrected.withColumn("raw_pred", F.col("pred")).withColumn("pred", F.col("corrected"))}


def evaluate_probs() -> tuple[float, ...]:
    return (0.25, 0.50, 0.75, 0.90, 0.95)


def with_shares(fold_rows: DataFrame, by: Sequence[str], spec: PanelSpec, shares: Mapping[str, int], delay: int) -> DataFrame:
    """Stages: rows with ``p75`` of their fold's train block and the share columns above it (method B)."""
    on = list(by)
    fold_rows = stage(fold_rows)
    thresholds = quantiles(fold_rows.where(F.col("role") == "train"), by, "y", [0.75]).select(*on, F.col("q0_75").alias("p75"))
    return stage(add_shares(fold_rows.join(thresholds, on, "left"), PanelSpec(tuple(by), spec.ts, spec.step_seconds), shares, delay, F.col("p75")))


# The ensembles of the share study and of stacking, and the tuned configuration.
PLAIN_TREES = boosting.Config("plain", 0.05, leaves=31, min_rows=20)
TUNED_TREES = boosting.Config("tuned", 0.1, leaves=63, subsample=0.8, colsample=0.8, min_rows=20)


def boosting_with_shares(rows: DataFrame, spec: PanelSpec, base: Sequence[str], share_columns: Sequence[str], hours: Column, rounds: int = boosting.grids.BOOST_ROUNDS,
                         search_rounds: int = boosting.grids.SEARCH_ROUNDS, patience: int = boosting.grids.PATIENCE) -> DataFrame:
    """Boosted trees per fold with and without share columns, tuned and not, raw and with the time-weighted addend (MD-12).

    ``rows`` carries series key, fold, role, pos and cut (see ``with_shares``); trees learn from the pooled train rows of a fold.
    Returns the rows with ``model`` and ``pred``.
    """
    keys, columns = list(spec.key), [*base, *share_columns]
    fold = [*spec.keys, "fold"]
    tail = splits.inner_tail(rows, F.col("cut")).withColumn("inner_role", F.when(F.col("role") == "train", F.col("inner_role")).otherwise("validation"))
    plain = [replace(PLAIN_TREES, name="trees_base", columns=tuple(range(len(base)))), replace(PLAIN_TREES, name="trees_shares")]
    predicted, _ = boosting.search(tail, keys, columns, [replace(TUNED_TREES, name="trees_shares_tuned")], search_rounds, patience, plain=plain, plain_rounds=rounds)
    predicted = predicted.select(*keys, "fold", "pred", F.col("config").alias("model"))
    scored = stage(rows.select(*keys, "fold", "role", "pos", "cut", "y", "p75").join(predicted, [*keys, "fold"]))
    corrected = residual.correct(scored, [*fold, "model"], "expanding_historical", hours).where(F.col("model") != "trees_base")
    corrected = corrected.withColumns({"pred": F.col("corrected"), "model": F.concat("model", F.lit("_addend"))}).select(scored.columns)
    return scored.unionByName(corrected)


def nested_folds(rows: DataFrame) -> DataFrame:
    """Outer folds (``nest`` = 10 × fold) and the inner expanding folds of their train blocks (10 × fold + k)."""
    outer = splits.expanding_folds(rows)
    inner = splits.expanding_folds(outer.where(F.col("role") == "train").withColumnsRenamed({"fold": "outer", "cut": "length"}).drop("role"), splits.INNER_FOLD_CUTS, F.col("length"))
    inner = inner.withColumn("nest", 10 * F.col("outer") + F.col("fold")).drop("length", "fold")
    outer = outer.withColumnRenamed("fold", "outer").withColumn("nest", 10 * F.col("outer"))
    return outer.unionByName(inner)


def stacking(rows: DataFrame, spec: PanelSpec, base: Sequence[str], shares: Mapping[str, int], delay: int, rounds: int = boosting.grids.BOOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Ridge with share columns and boosted trees, stacked by a ridge on their out-of-fold predictions (MD-13).

    ``rows`` are those of the panel.  All inner and outer fits of the trees grow together.  Returns the validation rows of
    every outer fold with both bases, their average and the stacked prediction, and the meta models.
    """
    by = [*spec.keys, "nest"]
    nested = with_shares(nested_folds(rows), by, spec, shares, delay)
    columns = [*base, *[f"share_high_{n}" for n in shares]]
    ridge = linear.fit_ridge(nested.where(F.col("role") == "train"), by, columns)
    validation = nested.where(F.col("role") == "validation")
    first = linear.score(validation, ridge, by, columns, "ridge_shares").select(*spec.key, "outer", "nest", "pos", "y", "ridge_shares")
    second = boosting.fit_predict(nested, spec.key, base, PLAIN_TREES, rounds, fold="nest").where(F.col("part") == boosting.OTHER)
    both = stage(first.join(second.select(*spec.key, F.col("fold").alias("nest"), F.col("pred").alias("trees")), [*spec.key, "nest"]))
    inner = F.col("nest") % 10 > 0
    oof, fresh = both.where(inner), both.where(~inner)
    group, bases = [*spec.keys, "outer"], ["ridge_shares", "trees"]
    meta = linear.fit_ridge(oof, group, bases, alphas=[linear.META_ALPHA])
    return apply_meta(fresh, meta, group, bases), meta.join(oof.groupBy(*group).agg(F.count(F.lit(1)).alias("n_oof")), group)


def apply_meta(fresh: DataFrame, meta: DataFrame, by: Sequence[str], bases: Sequence[str]) -> DataFrame:
    """Stacked and averaged prediction of fresh base predictions."""
    return linear.score(fresh, meta, by, bases, "stacked").withColumn("averaged", linear.average(bases))


def stacked(oof: DataFrame, fresh: DataFrame, by: Sequence[str], bases: Sequence[str], alpha: float = linear.META_ALPHA) -> DataFrame:
    """Ridge on out-of-fold base predictions, applied to fresh base predictions (MD-13)."""
    return apply_meta(fresh, linear.fit_ridge(oof, by, bases, alphas=[alpha]), by, bases)
