from __future__ import annotations

import corpus_pipeline as cp
import duckdb
import pytest

import __spark_entry__ as entry

from panelcast.sources.staging import stage as written

from .helpers import awkward, empty


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    counts = [before]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = written(out)
        kept = docs.count()
        assert 0.5 * before < kept <= counts[-1]
        counts.append(kept)
    assert counts[2] < counts[1]  # the corpus holds copies
    assert cp.run(spark, sf).count() > 0


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_awkward(spark, sf, name, stage):
    df = awkward(spark)
    out = stage(spark, df, sf)
    assert out.count() <= df.count()
    if name != cp.STAGES[-1][0]:
        assert out.columns == df.columns and out.schema == df.schema
    assert stage(spark, empty(spark), sf).count() == 0


def test_queries_are_registered():
    assert "pipeline" in entry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_url_filter", "op13_centroids"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
