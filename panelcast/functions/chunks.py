"""Windows over long series.

A window partitioned by series alone would put a series holding a third of all rows into one
task.  Instead the time axis is cut into chunks; each row is also copied into the neighbouring
chunks whose frames reach it (a copy for ``reach / size`` of the rows).  Frames then run inside
``(series, chunk)``, only home rows are kept, and the result equals the unchunked window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
HOME = "_home"
MIN_CHUNK = 4096


def chunk_of(index: Column, size: int) -> Column:
    return F.floor(index / F.lit(size)).cast("long")


def default_size(lookback: int = 0, lookahead: int = 0) -> int:
    # at most one eighth of the rows travels twice
    return max(MIN_CHUNK, 8 * (lookback + lookahead))


def chunked(df: DataFrame, index: str, lookback: int = 0, lookahead: int = 0, size: int | None = None) -> DataFrame:
    """Add the chunk id (one copy per chunk that needs the row) and the home flag."""
    size = size or default_size(lookback, lookahead)
    i = F.col(index)
    if lookback == 0 and lookahead == 0:
        return df.withColumn(CHUNK, chunk_of(i, size)).withColumn(HOME, F.lit(True))
    span = F.sequence(chunk_of(i - F.lit(lookahead), size), chunk_of(i + F.lit(lookback), size))
    return df.withColumn(CHUNK, F.explode(span)).withColumn(HOME, F.col(CHUNK) == chunk_of(i, size))


def chunk_window(keys: Sequence[str], index: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(index)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(CHUNK, HOME)


def value_at(value: Column, window: WindowSpec, back: int) -> Column:
    """Value exactly ``back`` steps earlier on the time axis; a missing step gives NULL, not a neighbour."""
    return F.first(value).over(window.rangeBetween(-back, -back))
