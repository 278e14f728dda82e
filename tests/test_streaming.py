"""The streamed block correction equals the batch rule."""

from __future__ import annotations

import datetime as dt

import numpy as np

from panelcast.streaming.blocks import correct_blocks

START = dt.datetime(2020, 1, 1)


def test_blocks_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    errors = rng.normal(size=73)  # steps −1 … 71
    at = lambda s: START + dt.timedelta(hours=s)
    asked = [("s", at(s), s, 100.0) for s in range(72)]
    known = [("s", at(s), s, 100.0 + float(errors[s + 1]), 100.0) for s in range(-1, 72)]
    # a far later row on both sides moves the watermark
    asked.append(("late", at(24 * 30), 720, 1.0))
    known.append(("late", at(24 * 30), 719, 1.0, 1.0))
    a, k = str(tmp_path / "asked"), str(tmp_path / "known")
    asked_schema = "series_id string, ts timestamp, step long, pred double"
    known_schema = "series_id string, ts timestamp, step long, y double, pred double"
    spark.createDataFrame(asked, asked_schema).coalesce(1).write.parquet(a)
    spark.createDataFrame(known, known_schema).coalesce(1).write.parquet(k)
    state = spark.createDataFrame([("s", 0.9), ("late", 0.5)], "series_id string, phi double")
    stream = correct_blocks(
        spark.readStream.schema(asked_schema).parquet(a), spark.readStream.schema(known_schema).parquet(k), state
    )
    q = (stream.writeStream.format("memory").queryName("corrected").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT step, ar_add FROM corrected WHERE series_id = 's' ORDER BY step").toPandas()
    want = [0.9 ** (s % 24 + 1) * errors[s // 24 * 24] for s in range(72)]
    assert list(got["step"]) == list(range(72))
    np.testing.assert_allclose(got["ar_add"], want, atol=1e-9)
