"""Null-exact numeric expressions: one definition per missing-value rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """NULL unless the value is a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where the numerator is finite and the denominator finite and positive, else NULL (FE-4)."""
    d = finite(den)
    return F.when(d > 0, finite(num) / d)


def all_present(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def any_present(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])


def total(cols: Sequence[Column]) -> Column:
    """Plain sum of columns: NULL as soon as one input is NULL."""
    return reduce(lambda a, b: a + b, cols)


def total_skip_null(cols: Sequence[Column]) -> Column:
    """Sum over the inputs that are present; NULL only when none is (FE-8)."""
    return F.when(any_present(cols), total([F.coalesce(c, F.lit(0.0)) for c in cols]))


def strict_mean(cols: Sequence[Column]) -> Column:
    return total(cols) / F.lit(float(len(cols)))


def strict_std(cols: Sequence[Column]) -> Column:
    """Population deviation across columns, NULL if any input is NULL."""
    mu = strict_mean(cols)
    return F.sqrt(total([(c - mu) * (c - mu) for c in cols]) / F.lit(float(len(cols))))


def strict_min(cols: Sequence[Column]) -> Column:
    # least() skips NULLs, so it needs the guard
    return F.when(all_present(cols), F.least(*cols))


def strict_max(cols: Sequence[Column]) -> Column:
    return F.when(all_present(cols), F.greatest(*cols))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the mean unit vector in [0, 360), NULL for no finite input (CL-2)."""
    rad = F.radians(finite(degrees.cast("double")))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def dot(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Sum of products as a balanced expression tree (keeps generated code shallow)."""
    terms = [a * b for a, b in pairs]
    return balanced_sum(terms)


def balanced_sum(terms: Sequence[Column]) -> Column:
    terms = list(terms)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]
