"""Importance per fold: no task sorts or shuffles the rows of a flag."""

from __future__ import annotations

import pytest

from panelcast.plans.catalogue import explain


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    rows = [(k, 1, "ANR"[k % 3], "FO"[k % 2] if k % 7 else None, float(k % 11 + 1), k % 5 / 100.0, 0.02, 1000.0 + k) for k in range(300)]
    names = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def test_rows_are_neither_sorted_nor_shuffled_before_the_aggregation(spark, small):
    plan = explain.per_fold(spark, small[0])._jdf.queryExecution().executedPlan().toString()
    # the model is three rows; scan, join and partial sums are one stage
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_mean_contributions_and_signs(spark, small):
    folder, rows = small
    got = {(r.fold, r.l_returnflag, r.feature): r for r in explain.per_fold(spark, folder).collect()}
    assert {k[:2] for k in got} == {(r[3], r[2]) for r in rows}
    for at, (name, weight) in enumerate(explain.WEIGHTS.items(), start=4):
        for fold, flag in {(r[3], r[2]) for r in rows}:
            own = [r[at] for r in rows if r[2] == flag]
            mean = sum(own) / len(own)
            scale = (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5
            phi = [weight * (r[at] - mean) / scale for r in rows if r[2] == flag and r[3] == fold]
            r = got[fold, flag, name]
            assert r.std_coef == (weight if fold == "F" else -weight)
            assert r.mean_abs_shap == pytest.approx(sum(map(abs, phi)) / len(phi)) and r.mean_shap == pytest.approx(sum(phi) / len(phi))
