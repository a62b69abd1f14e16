"""Sources: Parquet folders, literal rows, the one-row table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def dual(spark: SparkSession) -> DataFrame:
    """One row with one column."""
    return spark.range(1).selectExpr("'' AS dummy")
