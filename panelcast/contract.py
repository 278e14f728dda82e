"""What a panel looks like, and the errors raised when a table breaks the contract."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame


class ContractError(ValueError):
    """A table does not meet the panel contract."""


class LeakageError(ContractError):
    """A feature could carry information that is unknown at the forecast origin."""


class LockedSplitError(ContractError):
    """The held-out split was asked for while the holdout is locked."""


@dataclass(frozen=True)
class PanelSpec:
    """Key columns and sampling step of a panel."""

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    step_seconds: int = 3600

    @property
    def key(self) -> list[str]:
        return [*self.keys, self.ts]


HOURLY = PanelSpec()
DAILY = PanelSpec(step_seconds=86400)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    found = [c for c in columns if c in df.columns]
    if found:
        raise ContractError(f"forbidden columns present: {found}")
    return df


def require_unique_names(names: Iterable[str]) -> list[str]:
    names = list(names)
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ContractError(f"duplicate column names: {repeated}")
    return names
