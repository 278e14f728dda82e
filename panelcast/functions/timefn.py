"""Instants, civil time and calendar expressions (TM-1, TM-2, FE-1, FE-2)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CIVIL_ZONE = "Europe/Madrid"


def parse_instant(text: Column) -> Column:
    """Offset string -> UTC instant; text that cannot be parsed becomes NULL instead of failing the job."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def civil(ts: Column, zone: str = CIVIL_ZONE) -> Column:
    """UTC instant -> wall-clock time of ``zone``, DST aware."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_civil(local: Column, zone: str = CIVIL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def step_index(ts: Column, step_seconds: int) -> Column:
    """Absolute position of an instant on the step grid; equal steps differ by exactly one."""
    return F.floor(epoch_seconds(ts) / F.lit(step_seconds)).cast("long")


def index_instant(index: Column, step_seconds: int) -> Column:
    return F.timestamp_seconds(index * F.lit(step_seconds)).cast("timestamp_ntz")


def truncate(ts: Column, unit: str) -> Column:
    # date_trunc on NTZ yields TIMESTAMP, so go straight back to NTZ.
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def calendar_fields(local: Column) -> dict[str, Column]:
    """Twelve calendar fields of a civil time."""
    day = F.to_date(local)
    month, dom, dow = F.month(local), F.dayofmonth(local), F.weekday(local)
    month_end = day == F.last_day(local)
    as_flag = lambda cond: cond.cast("int")
    return {
        "hour": F.hour(local),
        "day_of_week": dow,
        "day_of_month": dom,
        "month": month,
        "quarter": F.quarter(local),
        "day_of_year": F.dayofyear(local),
        "week_of_year": F.weekofyear(local),
        "is_weekend": as_flag(dow >= 5),
        "is_month_start": as_flag(dom == 1),
        "is_month_end": as_flag(month_end),
        "is_year_start": as_flag((month == 1) & (dom == 1)),
        "is_year_end": as_flag((month == 12) & month_end),
    }


# Period of each cyclic encoding.
CYCLES = {
    "hour": ("hour", 24.0),
    "dow": ("day_of_week", 7.0),
    "month": ("month", 12.0),
    "day_of_year": ("day_of_year", 365.25),
}


def cyclic_fields(calendar: dict[str, Column]) -> dict[str, Column]:
    """Sine and cosine of each periodic calendar field."""
    out: dict[str, Column] = {}
    for name, (field, period) in CYCLES.items():
        angle = calendar[field] * F.lit(2.0 * math.pi) / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out
