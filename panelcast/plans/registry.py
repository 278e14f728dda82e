"""Registered queries: the Spark job and, where SQL can express it, the SQL it is checked against.

Both sides pass through one output contract: doubles are rounded to stated digits (sums are
re-ordered by a distributed engine), timestamps are printed, whole numbers are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans.views import with_ctes
from panelcast.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WHOLE = ("tinyint", "smallint", "int")


def present(df: DataFrame, digits: Mapping[str, int], places: int = 6) -> DataFrame:
    out = []
    for field in df.schema:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            # adding zero turns a negative zero into zero
            c = F.round(c.cast("double"), digits.get(field.name, places)) + F.lit(0.0)
        elif kind in WHOLE or kind.startswith("decimal"):
            c = c.cast("long")
        elif kind in ("timestamp_ntz", "timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(
    name: str, ctes: Sequence[str] = (), sql: str | None = None, doubles: Sequence[str] = (), whole: Sequence[str] = (),
    stamps: Sequence[str] = (), digits: Mapping[str, int] | None = None, places: int = 6,
):
    """Register a query; ``doubles``, ``whole`` and ``stamps`` name the result columns the SQL side has to format.

    Doubles are rounded to ``places`` unless ``digits`` says otherwise.  Means of values with two
    decimals use 8: with 6 a mean over 32 rows can fall exactly between two roundings.
    """
    digits = dict(digits or {})

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(prepare(spark), sf_dir), digits, places)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            formatted = [f"round({c}, {digits.get(c, places)}) + 0.0 AS {c}" for c in doubles]
            formatted += [f"CAST({c} AS BIGINT) AS {c}" for c in whole]
            formatted += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps]
            replace = f" REPLACE ({', '.join(formatted)})" if formatted else ""
            head = f"WITH {with_ctes(list(ctes))},\n" if ctes else "WITH "
            ORACLE[name] = f"{head}result AS ({sql.strip()})\nSELECT *{replace} FROM result"
        return fn

    return register
