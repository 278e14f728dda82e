"""All registered queries, grouped by the operator family they show."""

from __future__ import annotations

import importlib

from panelcast.plans.registry import ORACLE, QUERIES

FAMILIES = ("time", "quality", "cleaning", "features", "splits", "evaluation", "residuals", "models", "explain", "storage", "closed")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
