"""AR(1) block correction as a stream (ST-1).

The batch rule is: within a block the k-th step gets phi^k times the last error before the block.
As a stream this is a stream-stream join on (series, block): forecasts that ask for a correction on
one side, on the other side only the one actual per block that its successor needs.  The state is
spread over (series, block), so a dominant series does not land in one task, and the watermark
closes a block: an actual that arrives later changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.residual import BLOCK


def correct_blocks(asked: DataFrame, actuals: DataFrame, state: DataFrame, step_seconds: int = 3600, block: int = BLOCK, late_by: str = "2 days") -> DataFrame:
    """Corrected forecasts in append mode.

    ``asked``: stream ``(series_id, ts timestamp, step, pred)`` with ``step`` counted from the start
    of the scored range.  ``actuals``: stream ``(series_id, ts timestamp, step, y, pred)``; step −1
    is the last training step.  ``state``: static ``(series_id, phi)``; a series without one is not
    corrected (phi 0), as in the batch form.  A block whose preceding actual never arrives is emitted
    uncorrected once the watermark has passed.
    """
    wanted = asked.withWatermark("ts", late_by).select(
        "series_id", "ts", F.col("step").cast("long").alias("step"), F.col("pred").cast("double").alias("pred"),
        F.floor(F.col("step") / block).cast("long").alias("block"),
    )
    # only the last step before a block matters; all other actuals stop here
    donors = actuals.where(F.pmod(F.col("step") + 1, F.lit(block)) == 0).withWatermark("ts", late_by).select(
        F.col("series_id").alias("d_series"), F.col("ts").alias("d_ts"),
        F.floor((F.col("step") + 1) / block).cast("long").alias("d_block"), (F.col("y") - F.col("pred")).alias("error"),
    )
    reach = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(block * step_seconds)))
    on = (
        (F.col("series_id") == F.col("d_series")) & (F.col("block") == F.col("d_block"))
        & (F.col("d_ts") < F.col("ts")) & (F.col("d_ts") >= F.col("ts") - reach)
    )
    paired = wanted.join(donors, on, "left_outer").join(state.select("series_id", "phi"), "series_id", "left")
    k = F.pmod(F.col("step"), F.lit(block)) + 1
    add = F.coalesce(F.pow(F.col("phi"), k) * F.col("error"), F.lit(0.0))
    return paired.select("series_id", "ts", "step", "pred", add.alias("ar_add"), (F.col("pred") + add).alias("corrected"))
