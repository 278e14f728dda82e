"""Tree ensembles on MLlib (MD-8, MD-9, MD-10, MD-12).

Numbers differ from third-party boosters; folds, early stopping and selection behave the same.
Training rows stay distributed; the driver loops over configurations only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.prep import fit_scaler, transform
from panelcast.sources.staging import stage

# Ensemble sizes, rates and search grids.
SEED = 42
BOOST_ROUNDS, BOOST_RATE, BOOST_DEPTH = 200, 0.05, 5
FOREST_TREES, FOREST_DEPTH, FOREST_LEAF = 80, 12, 5
SEARCH_ROUNDS, PATIENCE, MIN_ROUNDS = 500, 40, 20
DEPTH_GRID, LEAF_GRID, RATE_GRID, SUBSAMPLE_GRID = (4, 6, 8), (15, 31, 63), (0.05, 0.1), (0.8, 1.0)
COLUMN_SHARE = 0.8


def boosted(rounds: int = BOOST_ROUNDS, rate: float = BOOST_RATE, depth: int = BOOST_DEPTH, subsample: float = 1.0, min_rows: int = 1) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_x", labelCol="y", predictionCol="pred", maxIter=rounds, stepSize=rate, maxDepth=depth, maxBins=64,
        subsamplingRate=subsample, minInstancesPerNode=min_rows, seed=SEED,
    )


def forest(trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, leaf: int = FOREST_LEAF) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="_x", labelCol="y", predictionCol="pred", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED
    )


def assemble(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Median-impute with train statistics and build the feature vector for train and other frames."""
    key = ["_all"]
    flag = F.col("y").isNotNull()
    scaler = stage(fit_scaler(train.withColumn("_all", flag), key, columns))
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_x")
    return [assembler.transform(transform(df.withColumn("_all", flag), F.broadcast(scaler), key, columns, scale=False)).drop("_all") for df in [train, *others]]


def fit_predict(train: DataFrame, validation: DataFrame, columns: Sequence[str], estimator) -> tuple[DataFrame, DataFrame]:
    """Predictions on train and validation rows (MD-8, MD-9)."""
    tr, va = assemble(train, [validation], columns)
    model = estimator.fit(tr)
    return model.transform(tr).drop("_x"), model.transform(va).drop("_x")


def best_rounds(losses: Sequence[float], patience: int = PATIENCE, minimum: int = MIN_ROUNDS) -> int:
    """Number of rounds at the best loss before ``patience`` rounds brought nothing better."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses, start=1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return max(at, minimum)


def tuned_boosting(fit: DataFrame, stop: DataFrame, validation: DataFrame, columns: Sequence[str], config: Mapping, rounds: int = SEARCH_ROUNDS,
                   patience: int = PATIENCE) -> tuple[DataFrame, int]:
    """Early stopping on the chronological tail, then a refit on the whole train block (MD-10)."""
    whole = fit.unionByName(stop)
    tr, st, full, va = assemble(fit, [stop, whole, validation], columns)
    shape = {k: config[k] for k in ("rate", "depth", "subsample", "min_rows") if k in config}
    probe = boosted(rounds, **shape).fit(tr)
    n = best_rounds(probe.evaluateEachIteration(st, "absolute"), patience)
    return boosted(n, **shape).fit(full).transform(va).drop("_x"), n


def depth_grid() -> list[dict]:
    """Depth-wise configurations of the search."""
    return [
        {"name": f"depth_{d}_rate_{r}_sub_{s}", "depth": d, "rate": r, "subsample": s, "min_rows": 1}
        for d, r, s in product(DEPTH_GRID, RATE_GRID, SUBSAMPLE_GRID)
    ]


def leaf_grid() -> list[dict]:
    """Leaf-wise configurations, expressed as the depth that holds that many leaves."""
    return [
        {"name": f"leaves_{n}_rate_{r}_sub_{s}", "leaves": n, "depth": (n + 1).bit_length() - 1, "rate": r, "subsample": s, "min_rows": 20}
        for n, r, s in product(LEAF_GRID, RATE_GRID, SUBSAMPLE_GRID)
    ]
