"""Non-standard behaviour, offered by name; nothing else uses these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_as_zero(op, a: Column, b: Column) -> Column:
    """a op b where a null operand counts as 0 unless both are null."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(op(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))


def count_rows(_: Column) -> Column:
    """COUNT(c) that counts nulls too."""
    return F.count(F.lit(1))


def sum_long(c: Column) -> Column:
    """SUM in longs: fractions are dropped row by row, no rows or only nulls give 0."""
    return F.coalesce(F.sum(F.when(c.isNull(), None).otherwise(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))).cast("long")), F.lit(0).cast("long"))


def avg_all_rows(c: Column) -> Column:
    """AVG whose divisor counts nulls."""
    return F.sum(F.coalesce(c, F.lit(0)).cast("double")) / F.nullif(F.count(F.lit(1)), F.lit(0))


def avg_int(c: Column) -> Column:
    """AVG of integers, truncated."""
    total = F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return F.try_divide(total - total % F.nullif(F.count(F.lit(1)), F.lit(0)), F.count(F.lit(1))).cast("int")


def round_half_up(x: Column, places: int = 0) -> Column:
    """floor(x + 1/2) at a decimal place: -2.5 gives -2."""
    scale = F.lit(10.0 ** places)
    return (F.floor(x * scale + 0.5) / scale).cast("double")


def timestamp_text(ts: Column) -> Column:
    """A timestamp as text with one digit of the second's fraction."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.S")


def two_valued(condition: Column) -> Column:
    """A condition whose unknown is false."""
    return F.coalesce(condition, F.lit(False))
