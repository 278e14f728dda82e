"""A cross-section of registered queries against their SQL on the smallest scale factor.

``tools/check_queries.py`` does the same for all of them.
"""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = (
    "naive_error_by_hour", "time_parse_offsets", "grid_densify", "grid_step_check_users", "quality_index_checks", "quality_duplicate_classes", "quality_column_profile",
    "clean_collapse_duplicates", "clean_missing_runs", "clean_fill_short_gaps", "feature_calendar_years", "feature_lags_irregular", "feature_high_share",
    "split_expanding_folds", "prep_standardise", "eval_regimes_by_fold", "residual_regime_aware", "residual_ar1_blocks", "model_ridge", "model_frozen_pipeline_small",
    "explain_cross_fold", "forecast_strict",
)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
