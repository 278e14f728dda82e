"""Keyed block correction: any arrival order, deadlines, restart from a checkpoint."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from panelcast.streaming.keyed import correct_blocks_keyed

START = dt.datetime(2020, 1, 1)
ASKED = "series_id string, ts timestamp, step long, pred double"
KNOWN = "series_id string, ts timestamp, step long, y double, pred double"
STEPS = 72


def at(step):
    return START + dt.timedelta(hours=step)


def rows(lost=()):
    rng = np.random.default_rng(9)
    errors = {s: rng.normal(size=STEPS + 1) for s in ("a", "b", "no_phi")}
    asked = [(s, at(k), k, 100.0) for s in errors for k in range(STEPS)]
    known = [(s, at(k), k, 100.0 + float(e[k + 1]), 100.0) for s, e in errors.items() for k in range(-1, STEPS) if (s, k) not in lost]
    phi = {"a": 0.9, "b": -0.5, "no_phi": 0.0}
    want = {(s, k): 0.0 if (s, k // 24 * 24 - 1) in lost else phi[s] ** (k % 24 + 1) * e[k // 24 * 24] for s, e in errors.items() for k in range(STEPS)}
    return asked, known, want


def write(spark, data, schema, folder, parts):
    """One file for each part, so that each is a micro-batch."""
    for part in parts:
        if part:
            spark.createDataFrame([data[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, name):
    state = spark.createDataFrame([("a", 0.9), ("b", -0.5)], "series_id string, phi double")
    read = lambda schema, folder: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    out = correct_blocks_keyed(read(ASKED, "asked"), read(KNOWN, "known"), state, late_by="10 days")
    q = out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.schema("series_id string, ts timestamp, step long, pred double, ar_add double, corrected double").parquet(str(tmp_path / "out")).collect()
    assert len({(r.series_id, r.step) for r in got}) == len(got)
    return {(r.series_id, r.step): r.ar_add for r in got}


def shuffled(n, parts, seed):
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [order[k::parts] for k in range(parts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    asked, known, want = rows()
    write(spark, asked, ASKED, str(tmp_path / "asked"), shuffled(len(asked), 3, seed))
    write(spark, known, KNOWN, str(tmp_path / "known"), shuffled(len(known), 3, seed + 10))
    got = run(spark, tmp_path, "any")
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_deadline_and_restart(spark, tmp_path):
    """Forecasts wait over a restart for a donor that comes later; those whose donor never comes leave at the deadline."""
    lost = {("a", 23), ("b", -1)}
    asked, known, want = rows(lost)
    early = [i for i, r in enumerate(known) if r[2] < 30]
    write(spark, asked, ASKED, str(tmp_path / "asked"), shuffled(len(asked), 2, 3))
    write(spark, known, KNOWN, str(tmp_path / "known"), [early])
    first = run(spark, tmp_path, "one")
    waiting = {k for k in want if k[1] // 24 * 24 - 1 >= 30 or (k[0], k[1] // 24 * 24 - 1) in lost}
    assert first.keys() == want.keys() - waiting  # nothing is late yet: the watermark lags ten days behind
    rest = [i for i, r in enumerate(known) if r[2] >= 30]
    write(spark, known, KNOWN, str(tmp_path / "known"), [rest])
    second = run(spark, tmp_path, "two")
    assert second.keys() == {k for k in want if (k[0], k[1] // 24 * 24 - 1) not in lost}
    far = [("late", at(24 * 40), 24 * 40, 1.0)]
    write(spark, far, ASKED, str(tmp_path / "asked"), [[0]])
    far = [("late", at(24 * 40), 24 * 40, 1.0, 1.0)]
    write(spark, far, KNOWN, str(tmp_path / "known"), [[0]])
    third = run(spark, tmp_path, "three")
    assert third.keys() == want.keys()
    assert all(third[k] == pytest.approx(want[k], abs=1e-9) for k in want)
