"""Boosting of many ensembles at once against one ensemble at a time in plain NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.contract import ContractError
from panelcast.operators import boosting as b
from panelcast.operators.trees import best_rounds

COLUMNS = ["a", "b", "c"]


def sample(n=240, folds=2, seed=0):
    rng = np.random.default_rng(seed)
    frames = []
    for fold in range(1, folds + 1):
        x = rng.normal(size=(n, 3)).round(2)
        y = np.where(x[:, 0] > 0.3, 3.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, n)
        part = np.where(np.arange(n) < 0.6 * n, "fit", np.where(np.arange(n) < 0.8 * n, "stop", "validation"))
        frames.append(pd.DataFrame({"series_id": "s", "ts": np.arange(n) + 1000 * fold, "fold": fold, "inner_role": part, "y": y, **dict(zip(COLUMNS, x.T))}))
    out = pd.concat(frames, ignore_index=True)
    out.loc[::17, "b"] = np.nan
    return out


def table(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))


def one_by_one(data, fold, config, rounds, parts):
    """Straight boosting of one fold from its staged rows; running predictions after every round."""
    pdf = data.rows.where(F.col("_fold") == fold).toPandas()
    bins = np.array([np.frombuffer(v, np.uint8) for v in pdf["_bins"]])
    mean, spread = data.targets[fold]
    y, f = pdf["y"].to_numpy(), np.full(len(pdf), mean)
    fit = np.isin(pdf["_part"], parts)
    out = []
    for r in range(rounds):
        g = np.rint((y - f) * (b.FIXED_POINT / spread))
        use = fit & b.sampled(pdf["_id"].to_numpy(), r, config.subsample) if config.subsample < 1 else fit
        allowed = config.features(bins.shape[1], r)

        def best(rows):
            found = (1e-9 * max(g[rows].sum() ** 2, 1.0), -1, -1)
            for j in sorted(allowed):
                for cut in range(b.BINS - 1):
                    left = rows[bins[rows, j] <= cut]
                    n, m = len(left), len(rows) - len(left)
                    if min(n, m) < config.min_rows or not n or not m:
                        continue
                    s, t = g[left].sum(), g[rows].sum()
                    gain = s**2 / n + (t - s) ** 2 / m - t**2 / len(rows)
                    if gain > found[0]:
                        found = (gain, j, cut)
            return found

        leaves, open_ = [], [(np.flatnonzero(use), np.arange(len(pdf)), 0)]
        count = 1
        while open_:
            cuts = sorted(((best(rows), k) for k, (rows, _, _) in enumerate(open_)), key=lambda c: (-c[0][0] if c[0][1] >= 0 else 1, c[1]))
            todo, nxt = {k: c for c, k in cuts if c[1] >= 0}, {}
            budget = config.leaves - count if config.leaves else None
            chosen = [k for c, k in cuts if c[1] >= 0][:budget]
            for k, (rows, everyone, depth) in enumerate(open_):
                if k not in chosen:
                    leaves.append((rows, everyone))
            for k in chosen:
                rows, everyone, depth = open_[k]
                _, j, cut = todo[k]
                count += 1
                for side in (bins[:, j] <= cut, bins[:, j] > cut):
                    nxt[len(nxt)] = (rows[side[rows]], everyone[side[everyone]], depth + 1)
            full = config.leaves and count >= config.leaves
            open_ = []
            for rows, everyone, depth in nxt.values():
                if full or (config.depth and depth >= config.depth):
                    leaves.append((rows, everyone))
                else:
                    open_.append((rows, everyone, depth))
        for rows, everyone in leaves:
            f[everyone] += config.rate / (b.FIXED_POINT / spread) * g[rows].sum() / max(len(rows), 1)
        out.append(f.copy())
    return pdf, out


CONFIGS = [
    b.Config("depth_2", 0.3, depth=2), b.Config("sub", 0.2, depth=3, subsample=0.7, min_rows=5), b.Config("leaves_5", 0.3, leaves=5, min_rows=4),
    b.Config("columns", 0.1, leaves=6, depth=4, colsample=0.7),
]


def test_equals_one_ensemble_at_a_time(spark):
    data = b.prepared(table(spark, sample()), ["series_id", "ts"], COLUMNS, {"fit": b.FIT, "stop": b.STOP}, len(CONFIGS), role="inner_role")
    grown, _ = b.grow(data, CONFIGS, 3)
    got = b.predictions(grown, CONFIGS).toPandas()
    assert len(got) == 2 * 240 * len(CONFIGS)
    for fold in (1, 2):
        for config in CONFIGS:
            pdf, f = one_by_one(data, fold, config, 3, [b.FIT, b.STOP])
            want = pdf.assign(want=f[-1]).merge(got[(got.fold == fold) & (got.config == config.name)], on=["series_id", "ts"])
            assert len(want) == 240
            np.testing.assert_allclose(want["pred"], want["want"], rtol=1e-9, atol=1e-9)


def test_early_stopping_and_refit(spark):
    rows, configs = table(spark, sample()), CONFIGS[:2]
    pred, report = b.search(rows, ["series_id", "ts"], COLUMNS, configs, rounds=9, patience=3, least=2)
    data = b.prepared(rows, ["series_id", "ts"], COLUMNS, {"fit": b.FIT, "stop": b.STOP}, 2, role="inner_role")
    got = pred.toPandas()
    for r in report:
        config = next(c for c in configs if c.name == r["config"])
        pdf, path = one_by_one(data, r["fold"], config, 9, [b.FIT])
        stop = (pdf["_part"] == b.STOP).to_numpy()
        losses = [np.abs(pdf["y"].to_numpy()[stop] - f[stop]).mean() for f in path]
        assert r["rounds"] == best_rounds(losses, patience=3, minimum=2)
        best, at = min((x, i) for i, x in enumerate(losses[: r["tried"]], start=1))
        assert abs(r["stop_mae"] - best) < 1e-5 and r["tried"] == min(9, at + 3)
        pdf, path = one_by_one(data, r["fold"], config, r["rounds"], [b.FIT, b.STOP])
        want = pdf.assign(want=path[-1]).merge(got[(got.fold == r["fold"]) & (got.config == config.name)], on=["series_id", "ts"])
        np.testing.assert_allclose(want["pred"], want["want"], rtol=1e-9, atol=1e-9)


def test_plain_ensembles_beside_a_search(spark):
    """Mixed ensembles: those without patience learn from all train rows, and from their own columns only."""
    rows = table(spark, sample(n=200))
    plain = b.Config("plain", 0.3, depth=2, columns=(0, 2))
    pred, report = b.search(rows, ["series_id", "ts"], COLUMNS, CONFIGS[:1], rounds=3, patience=2, least=2, plain=[plain], plain_rounds=3)
    data = b.prepared(rows, ["series_id", "ts"], COLUMNS, {"fit": b.FIT, "stop": b.STOP}, 2, role="inner_role")
    got = pred.toPandas()
    assert len(got) == 2 * 2 * 200 and {r["config"] for r in report} == {"depth_2"}
    for config, rounds in [(plain, {1: 3, 2: 3}), (CONFIGS[0], {r["fold"]: r["rounds"] for r in report})]:
        for fold, n in rounds.items():
            pdf, path = one_by_one(data, fold, config, n, [b.FIT, b.STOP])
            want = pdf.assign(want=path[-1]).merge(got[(got.fold == fold) & (got.config == config.name)], on=["series_id", "ts"])
            np.testing.assert_allclose(want["pred"], want["want"], rtol=1e-9, atol=1e-9)


def test_whole_trees_are_those_grown_by_level(spark, monkeypatch):
    """Folds of few rows get a tree from their rows, others from histograms a level: the same to the last bit, also side by side."""
    pdf = sample(n=260, folds=3, seed=5)
    rows, out = table(spark, pdf[(pdf.fold != 3) | (pdf.ts % 2 == 0)]), []
    for most in (b.WHOLE_ROWS, 150, 0):  # all folds, the one with half the rows, none
        monkeypatch.setattr(b, "WHOLE_ROWS", most)
        pred, report = b.search(rows, ["series_id", "ts"], COLUMNS, CONFIGS, rounds=3, patience=2, least=2)
        out.append((sorted((r.fold, r.config, r.ts, r.pred) for r in pred.collect()), sorted(map(str, report))))
    assert len(out[0][0]) == len(CONFIGS) * (2 * 260 + 130)
    assert out[0] == out[1] == out[2]


def test_jobs_do_not_grow_with_the_depth(spark):
    """A round of folds with few rows is one step, however deep its trees."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    data = b.prepared(table(spark, sample()), ["series_id", "ts"], COLUMNS, {"fit": b.FIT, "stop": b.STOP}, 1, role="inner_role")
    for depth in (1, 6):
        config = b.Config(f"depth_{depth}", 0.3, depth=depth)
        spark.sparkContext.setJobGroup(config.name, "boosting")
        grown, _ = b.grow(data, [config], 2)
        jobs.append(len(tracker.getJobIdsForGroup(config.name)))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[0] == jobs[1] > 0


def test_learns_and_chooses(spark):
    from panelcast.operators import evaluate

    pdf = sample(n=600, folds=1, seed=4)
    configs = [b.Config("deep", 0.3, depth=4, min_rows=5), b.Config("stump", 0.05, depth=1)]
    pred, report = b.search(table(spark, pdf), ["series_id", "ts"], COLUMNS, configs, rounds=12, patience=4, least=5)
    scores = evaluate.metrics(pred.where(F.col("part") == b.OTHER), ["fold", "config"])
    out = {r.config: r for r in b.choose(scores, report).collect()}
    assert out["deep"].chosen and not out["stump"].chosen
    naive = (pdf.y - pdf.y[pdf.inner_role != "validation"].mean()).abs()[pdf.inner_role == "validation"].mean()
    assert out["deep"].mae < 0.4 * naive and out["deep"].mean_mae == out["deep"].mae


def test_partitions_and_order_do_not_matter(spark):
    """Gradient sums are whole numbers: any spread over tasks gives the same trees to the last bit."""
    rows, out = table(spark, sample(n=300)), []
    for tasks in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        pred = b.fit_predict(rows.withColumn("role", F.col("inner_role")).orderBy(F.rand(int(tasks))), ["series_id", "ts"], COLUMNS, CONFIGS[1], 2, train=("fit", "stop"))
        out.append(sorted((r.fold, r.ts, r.pred) for r in pred.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_awkward_rows(spark):
    pdf = sample(n=60, folds=1)
    pdf["c"] = 1.0  # constant
    pdf.loc[3, "y"] = np.nan
    df = table(spark, pdf).withColumn("a", F.when(F.col("ts") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("a"))).withColumn("d", F.lit(None).cast("double"))
    pred = b.fit_predict(df, ["series_id", "ts"], ["a", "b", "c", "d"], b.Config("x", 0.5, depth=3), 1, role="inner_role", train=("fit", "stop"))
    got = pred.toPandas()
    assert len(got) == 59 and np.isfinite(got["pred"]).all()  # the train row without a target is left out
    flat = b.fit_predict(df.withColumn("y", F.lit(2.0)), ["series_id", "ts"], ["a"], b.Config("x", 0.5, depth=3), 1, role="inner_role", train=("fit", "stop"))
    assert set(flat.toPandas()["pred"]) == {2.0}
    assert b.fit_predict(df.where("false"), ["series_id", "ts"], ["a"], b.Config("x", 0.5, depth=3), 1, role="inner_role", train=("fit",)).count() == 0
    with pytest.raises(ContractError):
        b.Config("unlimited", 0.1)


def test_grid_is_the_whole_grid():
    grid = b.search_grid()
    assert len(grid) == 24 == len({c.name for c in grid})
    assert {(c.depth, c.leaves) for c in grid} == {(4, 0), (6, 0), (8, 0), (0, 15), (0, 31), (0, 63)}
