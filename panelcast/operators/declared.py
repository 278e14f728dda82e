"""History columns and their manifest entries, declared once (FE-16, FE-18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column

from panelcast.contract import PanelSpec
from panelcast.operators.features import History
from panelcast.operators.manifest import FeatureSpec, Manifest


class Declared:
    """Collects features; ``history`` computes them and ``manifest`` describes them from the same arguments."""

    def __init__(self, spec: PanelSpec):
        self.history, self.manifest = History(spec), Manifest()

    def known(self, name: str, source: str, group: str, how: str, availability: str, text: str) -> None:
        """A column known in advance."""
        self.manifest.add(FeatureSpec(name, source, group, "0", how, availability, text))

    def lags(self, base: str, column: str | Column, lags: Sequence[int], source: str, group: str, how: str, availability: str, text: str) -> list[str]:
        names = [f"{base}_lag_{k}" for k in lags]
        for name, k in zip(names, lags):
            self.history.lag(column, k, name)
            self.manifest.add(FeatureSpec(name, source, group, str(k), f"{how}(+{k})", availability, f"{text} at t-{k}", k))
        return names

    def rolling(self, name: str, source: str, window: int, delay: int, group: str, availability: str, text: str, std: bool = False) -> str:
        self.history.rolling(source, window, delay, **{"std" if std else "mean": name})
        how = f"rolling {'deviation' if std else 'mean'} over {window}"
        self.manifest.add(FeatureSpec(name, source, group, f"{delay}+", how, availability, text, delay))
        return name

    def share(self, name: str, source: str, threshold: Column | float, window: int, delay: int, group: str, availability: str, text: str) -> str:
        self.history.share_above(source, threshold, window, delay, name)
        self.manifest.add(FeatureSpec(name, source, group, f"{delay}+", f"share above a level over {window}", availability, text, delay))
        return name
