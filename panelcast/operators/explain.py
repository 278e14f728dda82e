"""Exact explanations of linear models (EX-1 … EX-7).

The contribution of feature i is w_i · z_i.  Contributions are aggregated as column expressions of
one pass; the rows × features matrix is never written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import balanced_sum
from panelcast.operators.linear import linear_terms
from panelcast.operators.prep import standardised
from panelcast.operators.quality import wide_to_long

# Fixed value: seed of the permutations.
SEED = 42
# Multipliers of the index permutation; a prime that does not divide n visits every index once.
PRIMES = (1_000_003, 1_000_033, 1_000_037)


def contributions(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "phi_") -> DataFrame:
    """Rows with one contribution column per feature (EX-1)."""
    joined = df.join(models, list(by))
    return joined.withColumns({f"{prefix}{c}": t for c, t in zip(columns, linear_terms(columns))})


def additivity(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str], pred: str = "pred") -> DataFrame:
    """Largest gap between the summed contributions plus intercept and the prediction (EX-2)."""
    joined = df.join(models, list(by))
    gap = balanced_sum(linear_terms(columns)) + F.col("intercept") - F.col(pred)
    return joined.groupBy(*by).agg(F.max(F.abs(gap)).alias("max_gap"), F.count(gap).alias("n"))


def importance(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Coefficient, mean |φ| and mean φ per feature and group (EX-3)."""
    joined = df.join(models, list(by))
    terms = linear_terms(columns)
    aggs = []
    for i, t in enumerate(terms):
        aggs += [
            F.first(F.col("coef")[i]).alias(f"std_coef__{i}"), F.avg(F.abs(t)).alias(f"mean_abs_shap__{i}"), F.avg(t).alias(f"mean_shap__{i}")
        ]
    return wide_to_long(joined.groupBy(*by).agg(*aggs), by, "feature", columns, ["std_coef", "mean_abs_shap", "mean_shap"])


def permutation_importance(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str], offset: str, seed: int = SEED) -> DataFrame:
    """Increase of the MAE when one column is shuffled within its group (EX-4).

    ``offset`` numbers the rows of a group 0 … n−1.  Row i takes the values of row (a·i + b) mod n
    with a coprime to n: a seeded permutation that is one equi-join, shared by all features.  For a
    linear model the new error is error + w_j (z'_j − z_j), so no feature needs its own scan.
    """
    keys, z = list(by), [f"_z{i}" for i in range(len(columns))]
    scored = df.join(models, keys)
    error = balanced_sum(linear_terms(columns)) + F.col("intercept") + F.coalesce(F.col("addend"), F.lit(0.0)) - F.col("y")
    rows = scored.select(*keys, F.col(offset).alias("_i"), error.alias("_e"), "coef", *[t.alias(n) for n, t in zip(z, standardised(columns))])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    a = F.lit(PRIMES[2])
    for prime in (PRIMES[1], PRIMES[0]):
        a = F.when(n % prime != 0, F.lit(prime)).otherwise(a)
    # the first 32 bits of a digest of key and seed: any engine can repeat the map
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    b = F.pmod(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long"), n)
    placed = rows.join(sizes, keys).withColumn("_p", F.pmod(a * F.col("_i") + b, n))
    donors = rows.select(*keys, F.col("_i").alias("_p"), *[F.col(c).alias(f"{c}s") for c in z])
    paired = placed.join(donors, [*keys, "_p"])
    base = F.avg(F.abs(F.col("_e")))
    aggs = [
        (F.avg(F.abs(F.col("_e") + F.col("coef")[i] * (F.col(f"{c}s") - F.col(c)))) - base).alias(f"mae_increase__{i}") for i, c in enumerate(z)
    ]
    return wide_to_long(paired.groupBy(*keys).agg(*aggs), keys, "feature", columns, ["mae_increase"])


def summarise_importance(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cross-fold importance with sign counts, direction and rank (EX-5)."""
    coef = F.col("std_coef")
    out = per_fold.groupBy(*by, "feature").agg(
        F.avg("mean_abs_shap").alias("mean_abs_shap"), F.stddev_pop("mean_abs_shap").alias("std_abs_shap"), F.avg("mean_shap").alias("mean_shap"),
        F.avg(coef).alias("mean_std_coef"), F.stddev_pop(coef).alias("std_std_coef"), F.avg(F.abs(coef)).alias("mean_abs_std_coef"),
        F.count_if(coef > 0).alias("n_folds_pos"), F.count_if(coef < 0).alias("n_folds_neg"),
    )
    pos, neg = F.col("n_folds_pos"), F.col("n_folds_neg")
    out = out.withColumn("direction", F.when(pos > neg, "+").when(neg > pos, "-").otherwise("0"))
    # one row per feature of the model: a ranking window over the feature list
    order = Window.partitionBy(*by).orderBy(F.desc("mean_abs_shap"), F.desc("mean_abs_std_coef"), "feature")
    return out.withColumn("rank", F.row_number().over(order))


def group_importance(per_fold: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum per fold and feature group, then mean and sample deviation over folds (EX-6).

    ``groups`` is the manifest's (feature, feature_group), one row per feature.
    """
    per_group = per_fold.join(groups.select("feature", "feature_group"), "feature").groupBy(*by, "fold", "feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("mean_abs_shap").alias("_sum"), F.avg("mean_abs_shap").alias("_mean")
    )
    return per_group.groupBy(*by, "feature_group").agg(
        F.max("n_features").alias("n_features"), F.avg("_sum").alias("mean_abs_shap_sum"),
        F.coalesce(F.stddev_samp("_sum"), F.lit(0.0)).alias("std_abs_shap_sum"), F.avg("_mean").alias("mean_abs_shap_mean"),
    )


def high_level_difference(df: DataFrame, models: DataFrame, by: Sequence[str], columns: Sequence[str], high: Column) -> DataFrame:
    """Mean contribution in high rows minus the rest per feature and group (EX-7)."""
    joined = df.join(models, list(by)).withColumn("_high", high)
    aggs = []
    for i, t in enumerate(linear_terms(columns)):
        aggs += [
            F.avg(F.when(F.col("_high"), t)).alias(f"mean_shap_high__{i}"), F.avg(F.when(~F.col("_high"), t)).alias(f"mean_shap_rest__{i}")
        ]
    out = wide_to_long(joined.groupBy(*by).agg(*aggs), by, "feature", columns, ["mean_shap_high", "mean_shap_rest"])
    return out.withColumn("delta", F.col("mean_shap_high") - F.col("mean_shap_rest"))
