"""Staged tables: cut the lineage of a result that several later steps read.

A feature table read by a scaler, a Gram pass and a scoring scan would otherwise be planned and
computed once per reader.  It is written once as Parquet to the shared folder the session names in
``spark.checkpoint.dir``; readers get a pruned columnar scan, and a lost executor costs nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelcast.contract import ContractError
from panelcast.session import checkpoint_root

_LOCAL_ROOTS: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    root = checkpoint_root(spark)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ContractError("set spark.checkpoint.dir to a folder every executor can reach")
    # one machine: driver and executors share its disk
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="panelcast-")
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame) -> DataFrame:
    """Action: write the rows once and return a scan of them."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/panelcast/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
