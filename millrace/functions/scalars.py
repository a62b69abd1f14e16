"""Scalar functions whose Spark counterpart has another name or meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_dayofweek(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(ts) + 1).cast("int")


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT(unit FROM ts) as an int, whole seconds."""
    unit = unit.upper()
    plain = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOW": iso_dayofweek}
    if unit == "MILLISECOND":
        return F.date_format(ts, "SSS").cast("int")
    if unit not in plain:
        raise ValueError(f"can't extract {unit}")
    return plain[unit](ts).cast("int")


def floor_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def random_int(seed: int | None = None) -> Column:
    """A random int over the whole range."""
    r = F.rand() if seed is None else F.rand(seed)
    return (F.floor(r * F.lit(4294967296.0)) - 2147483648).cast("int")


def widened(x: Column) -> Column:
    """Integers as longs, before arithmetic, so that results are longs and don't overflow."""
    return x.cast("bigint")
