"""Session settings every operator relies on."""

from __future__ import annotations

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import SparkSession

import panelcast

# Task functions travel with their code, so executors need no copy of this package on their path.
register_pickle_by_value(panelcast)

# The time contract: NTZ columns hold UTC, so casts NTZ <-> TIMESTAMP must run in a UTC session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs a later shuffle: one series may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "panelcast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """Shared folder the cluster names for cutting lineage; None where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None)
