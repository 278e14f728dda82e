"""Lineage of feature columns: which sources a column reads and how many steps back (FE-18).

The lineage travels in the metadata of the columns, so it survives selections, renames, joins and staged
tables.  ``History`` writes it for what it builds, ``observed`` for raw measurements (0 steps back), and
``derived`` for arithmetic on such columns, whose references it takes from the analysed expression, not
from a declaration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "lineage"


def of(df: DataFrame, column: str) -> dict[str, int]:
    """Source → least number of steps back; empty for a column without lineage."""
    return {source: int(steps) for source, steps in df.schema[column].metadata.get(KEY, {}).items()}


def stamped(df: DataFrame, lineage: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The same columns; those named carry their lineage."""
    if not lineage:
        return df
    named = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[x.alias(c, metadata={**df.schema[c].metadata, KEY: dict(lineage[c])}) if c in lineage else x for c, x in named.items()])


def observed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mark raw measurements: a copy of one under another name is still known to read it 0 steps back."""
    return stamped(df, {c: {c: 0} for c in columns})


def references(df: DataFrame, column: Column) -> list[str]:
    """Columns of ``df`` without which the expression cannot be analysed."""

    def needed(names: list[str]) -> list[str]:
        try:
            df.drop(*names).select(column)
            return []
        except AnalysisException:
            if len(names) == 1:
                return names
        half = len(names) // 2
        return needed(names[:half]) + needed(names[half:])

    return needed(df.columns) if df.columns else []


def merged(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Lineage of something computed from all of these columns: the least offset of every source."""
    out: dict[str, int] = {}
    for c in columns:
        for source, steps in of(df, c).items():
            out[source] = min(steps, out.get(source, steps))
    return out


def derived(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns computed from others, with the lineage of what they refer to."""
    found = {name: merged(df, references(df, column)) for name, column in columns.items()}
    return stamped(df.withColumns(dict(columns)), found)
