"""AR(1) block correction with keyed state and a timer for every block (ST-1).

The state of a (series, block) is the error its donor step left behind and the forecasts that wait
for it, at most a block.  Whatever comes first waits for the other; forecasts leave as soon as the
donor is known, in any order of arrival.  Each block has a deadline in event time, its own end: when the watermark
has passed it, waiting forecasts leave uncorrected and the state goes.  Keys spread a dominant series over its
blocks; state lives in the query's checkpoint, from which a restarted query goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelcast.operators.residual import BLOCK

STATE = "known boolean, error double, ts array<timestamp>, step array<long>, pred array<double>, phi array<double>"
OUT = "series_id string, ts timestamp, step long, pred double, phi double, error double"


def waiting(asked: DataFrame, actuals: DataFrame, step_seconds: int, block: int) -> DataFrame:
    """Both streams as one: forecasts, and the one actual of each block that its successor needs."""
    start = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.col("step"), F.lit(block)) * F.lit(float(step_seconds)))
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(block * step_seconds)))
    wanted = asked.select(
        "series_id", "ts", F.floor(F.col("step") / block).cast("long").alias("block"), F.unix_millis(end).alias("deadline"),
        F.col("step").cast("long").alias("step"), F.col("pred").cast("double").alias("pred"), F.lit(None).cast("double").alias("error"),
    )
    # a donor stands one step before its block
    after = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float((block + 1) * step_seconds)))
    donors = actuals.where(F.pmod(F.col("step") + 1, F.lit(block)) == 0).select(
        "series_id", "ts", F.floor((F.col("step") + 1) / block).cast("long").alias("block"), F.unix_millis(after).alias("deadline"),
        F.lit(None).cast("long").alias("step"), F.lit(None).cast("double").alias("pred"), (F.col("y") - F.col("pred")).alias("error"),
    )
    return wanted.unionByName(donors)


def met(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Forecasts of one block that can leave now."""
    known, error, ts, step, pred, phi = state.get if state.exists else (False, None, [], [], [], [])
    ts, step, pred, phi = list(ts), list(step), list(pred), list(phi)
    if state.hasTimedOut:
        state.remove()
    else:
        deadline = 0
        for part in parts:
            deadline = max(deadline, int(part["deadline"].max()))
            given = part["step"].isna()
            if given.any() and not known:
                # the smallest of several actuals of one step, whatever their order
                known, error = True, float(part.loc[given, "error"].min()) if part.loc[given, "error"].notna().any() else None
            asked = part[~given]
            ts += list(asked["ts"])
            step += [int(s) for s in asked["step"]]
            pred += [None if pd.isna(p) else float(p) for p in asked["pred"]]
            phi += [None if pd.isna(p) else float(p) for p in asked["phi"]]
        if not known:
            state.update((False, None, ts, step, pred, phi))
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
            return
        state.update((True, error, [], [], [], []))
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
    if step:
        yield pd.DataFrame({"series_id": key[0], "ts": ts, "step": step, "pred": pred, "phi": phi, "error": error if known else None})


def correct_blocks_keyed(asked: DataFrame, actuals: DataFrame, state: DataFrame, step_seconds: int = 3600, block: int = BLOCK, late_by: str = "2 days") -> DataFrame:
    """Corrected forecasts in append mode; inputs as for ``blocks.correct_blocks``.

    A series without ``phi`` is not corrected.  Rows older than the watermark change nothing.
    """
    both = waiting(asked, actuals, step_seconds, block).withWatermark("ts", late_by).join(state.select("series_id", "phi"), "series_id", "left")
    paired = both.groupBy("series_id", "block").applyInPandasWithState(met, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    k = F.pmod(F.col("step"), F.lit(block)) + 1
    add = F.coalesce(F.pow(F.col("phi"), k) * F.col("error"), F.lit(0.0))
    return paired.select("series_id", "ts", "step", "pred", add.alias("ar_add"), (F.col("pred") + add).alias("corrected"))
