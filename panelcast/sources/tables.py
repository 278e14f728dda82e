"""CSV and Parquet sources and sinks (IO-1 … IO-7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.contract import ContractError, LockedSplitError, forbid_columns, require_columns
from panelcast.session import prepare


def nan_as_null(df: DataFrame) -> DataFrame:
    """The one rule for missing numbers at every scan."""
    floats = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(floats) if floats else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV with a header; empty fields and NaN are missing values (IO-1).

    The header must name the schema's columns in order; text that does not parse becomes NULL.
    """
    prepare(spark)
    return nan_as_null(spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue="", mode="PERMISSIVE", nanValue="NaN"))


def read_parquet(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Parquet scan with a column contract; row order is never relied on, NaN becomes NULL (IO-2)."""
    prepare(spark)
    return nan_as_null(require_columns(spark.read.parquet(path), required))


def preview(df: DataFrame, columns: Mapping[str, str], rows: int = 6, order: Sequence[str] = ()) -> DataFrame:
    """First rows of a few renamed columns; only those columns are read (IO-3)."""
    keep = df.select(*columns) if not order else df.select(*dict.fromkeys([*order, *columns])).orderBy(*order)
    return keep.limit(rows).select(*[F.col(c).alias(n) for c, n in columns.items()])


def write_splits(df: DataFrame, path: str, order: Sequence[str], forbidden: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Action: one Parquet table partitioned by ``split`` with a fixed column order (IO-5)."""
    forbid_columns(df, forbidden)
    require_columns(df, [*order, "split"])
    df.select(*order, "split").write.mode(mode).partitionBy("split").parquet(path)


def write_summary(df: DataFrame, path: str, order: Sequence[str], fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Action: small sorted result table (IO-6)."""
    out = df.orderBy(*order).coalesce(1)
    writer = out.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


class SplitCatalog:
    """Split table behind a lock: the held-out split cannot be read while fitting (IO-7)."""

    LOCKED = "test"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.locked_reads = 0
        self._released = False

    def read(self, *splits: str) -> DataFrame:
        if self.LOCKED in splits and not self._released:
            self.locked_reads += 1
            raise LockedSplitError("the test split is locked and must not be read while fitting")
        # a partition filter: files of other splits are never listed
        return read_parquet(self.spark, self.path).where(F.col("split").isin(*splits))

    def release(self) -> None:
        """Open the holdout once everything is frozen."""
        self._released = True

    def assert_not_scanned(self, df: DataFrame) -> None:
        """Raise if the plan of ``df`` would read files of the locked split."""
        plan_files = [f for f in df.inputFiles() if f"split={self.LOCKED}" in f]
        if plan_files:
            raise LockedSplitError(f"plan reads locked files: {plan_files[:3]}")


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ContractError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
