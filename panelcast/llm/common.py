"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ways a hot key is dealt out over; a key never adds more than this many rows to a look-up table.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salted_lookup(rows: DataFrame, values: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (one row per key) for keys that may hold a third of all rows.

    Every key's value is copied to the salts it occurs with, at most ``SALTS``, so the rows of a hot
    key are joined in that many tasks.  A null key never matches.
    """
    rows = rows.withColumn("_salt", salt)
    spread = rows.select(key, "_salt").distinct().join(values, key)
    return rows.join(spread, [key, "_salt"]).drop("_salt")


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text, F.length(text))


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the whole row as one column: no name of ``docs`` can clash with another."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), whole.alias("row"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, text_key), each once; columns unchanged.

    One shuffle of the rows: the window uses the partitioning and order of the join.
    """
    id_, no_id = F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")
    keys = ["id", "no_id", "text_key"]
    first = Window.partitionBy(*keys).orderBy(*keys)
    found = wrapped(docs).select(id_, no_id, "text_key", "row").join(kept.select(id_, no_id, "text_key"), keys, "left_semi")
    return found.withColumn("copy", F.row_number().over(first)).where("copy = 1").select("row.*")


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` not named by ``dropped`` (doc_id, text_key); columns unchanged."""
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    return wrapped(docs).alias("a").join(dropped.select("doc_id", "text_key").alias("b"), same, "left_anti").select("row.*")


def text_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a column of texts into runs of at most about ``most_bytes``: (first row, UTF-8 of each row); null is empty."""
    values = batch.column(column).cast(pa.large_binary())
    run: list[bytes] = []
    first = held = 0
    for i in range(len(values)):
        raw = values[i].as_py() or b""
        run.append(raw)
        held += len(raw)
        if held >= most_bytes:
            yield first, run
            first, run, held = i + 1, [], 0
    if run:
        yield first, run


def batch_of(columns: dict[str, tuple[Sequence, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def as_int64(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
