"""Relational operators where the DataFrame API needs a word more: order, paging, joins, sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str] | tuple[str, str, str | None]


def ordering(keys: Iterable[Key]) -> list[Column]:
    """Sort columns of (name, "asc" | "desc", "first" | "last" | None); null counts as greater than all values, so it
    comes last ascending and first descending unless told otherwise."""
    out = []
    for key in keys:
        name, way, nulls = (*((key,) if isinstance(key, str) else key), "asc", None)[:3] if isinstance(key, str) else (*key, None)[:3]
        nulls = nulls or ("last" if way == "asc" else "first")
        out.append(getattr(F.col(name), f"{way}_nulls_{nulls}")())
    return out


def sort(df: DataFrame, *keys: Key) -> DataFrame:
    return df.orderBy(*ordering(keys))


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; offset first, limit 0 gives no rows."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def top(df: DataFrame, n: int, *keys: Key) -> DataFrame:
    """The first n rows in order: each task keeps n, no full sort."""
    return sort(df, *keys).limit(n)


def semi(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """NOT EXISTS: rows whose key is null stay."""
    return left.join(right, on, "left_anti")


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the columns both have; the cross product if there are none."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other."""
    return left.join(right, reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in pairs)), how)


def union_all(*parts: DataFrame) -> DataFrame:
    """Concatenation by position."""
    return reduce(DataFrame.unionAll, parts)
