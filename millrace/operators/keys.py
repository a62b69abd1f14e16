"""Keys and references checked as joins and groupings: each function returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyViolation(ValueError):
    """A primary, unique, not-null or foreign key constraint doesn't hold."""


def duplicates(df: DataFrame, key: Sequence[str], skip_nulls: bool = False) -> DataFrame:
    """Keys held by more than one row; as in unique indexes, keys with a null can be left out."""
    rows = df.where(_all_known(key)) if skip_nulls else df
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def clashes(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows whose key the table holds."""
    return rows.join(target.select(*key), list(key), "left_semi")


def clashes_rows(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the table whose key is among the new rows'."""
    return target.join(rows.select(*key), list(key), "left_semi").select(*target.columns)


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null where none may be."""
    return df.where(~_all_known(columns))


def orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, references: Sequence[str]) -> DataFrame:
    """Rows whose reference no parent has. Rows whose reference is null as a whole refer to nothing and are left out."""
    some = child.where(~_none_known(columns))
    keys = parent.select(*(F.col(r).alias(f"__{i}") for i, r in enumerate(references)))
    on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)]
    return some.join(keys, on, "left_anti")


def referring(child: DataFrame, columns: Sequence[str], gone: DataFrame, references: Sequence[str]) -> DataFrame:
    """Rows that refer to parents that go."""
    keys = gone.select(*(F.col(r).alias(f"__{i}") for i, r in enumerate(references)))
    return child.join(keys, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)], "left_semi")


def cascaded(child: DataFrame, columns: Sequence[str], gone: DataFrame, references: Sequence[str]) -> DataFrame:
    """ON DELETE CASCADE: the child without the rows that refer to parents that go."""
    keys = gone.select(*(F.col(r).alias(f"__{i}") for i, r in enumerate(references)))
    return child.join(keys, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)], "left_anti")


def nulled(child: DataFrame, columns: Sequence[str], gone: DataFrame, references: Sequence[str]) -> DataFrame:
    """ON DELETE SET NULL: references to parents that go become null."""
    keys = gone.select(*(F.col(r).alias(f"__{i}") for i, r in enumerate(references))).distinct().withColumn("__gone", F.lit(True))
    joined = child.join(keys, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)], "left")
    return joined.select(*(F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in child.columns))


def _all_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _none_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNull()
    return out
