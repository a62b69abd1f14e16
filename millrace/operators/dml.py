"""INSERT, UPSERT, UPDATE, DELETE and TRUNCATE as functions from tables to tables.

Each returns the table's next version, lazily. `target` is the current version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conformed(rows: DataFrame, schema: T.StructType, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with the columns of a schema, in its order: cast, and missing ones filled with defaults or null."""
    have = {c.lower() for c in rows.columns}
    unknown = have - {f.name.lower() for f in schema}
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    fill = {k.lower(): v for k, v in (defaults or {}).items()}
    cols = [(F.col(f"`{f.name}`") if f.name.lower() in have else fill.get(f.name.lower(), F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*cols)


def insert(target: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    return target.unionAll(conformed(rows, target.schema, defaults))


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows replace those of equal key whole; of several new rows of a key one stays (they should be unique)."""
    new = conformed(rows, target.schema, defaults).dropDuplicates(list(key))
    return target.join(new.select(*key), list(key), "left_anti").select(*target.columns).unionAll(new)


def update(target: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Rows for which the condition holds get new values, computed from the old ones."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {k.lower(): v for k, v in changes.items()}
    unknown = set(new) - {c.lower() for c in target.columns}
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    cols = []
    for f in target.schema:
        value = new.get(f.name.lower())
        cols.append(F.col(f.name) if value is None else F.when(hit, value.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
    return target.select(*cols)


def update_in(target: DataFrame, changes: Mapping[str, Column], column: str, values: DataFrame) -> DataFrame:
    """UPDATE ... WHERE column IN (a one-column table): a left join with its distinct values flags the rows."""
    flags = values.select(F.col(values.columns[0]).alias("__value")).distinct().withColumn("__hit", F.lit(True))
    joined = target.join(flags, F.col(column) == F.col("__value"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    new = {k.lower(): v for k, v in changes.items()}
    return joined.select(*(F.when(hit, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in new else F.col(f.name) for f in target.schema))


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the condition isn't true stay."""
    return truncate(target) if where is None else target.where(~F.coalesce(where, F.lit(False)))


def delete_in(target: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """DELETE ... WHERE column IN (a one-column table)."""
    return target.join(values.select(F.col(values.columns[0]).alias("__value")), F.col(column) == F.col("__value"), "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def numbered(rows: DataFrame, column: str, after: int = 0) -> DataFrame:
    """rows with an auto-increment column: after + 1, after + 2, ... in the order of partitions.

    Partitions are counted first and their sums, one row for each, put in order, so no task sees all rows."""
    tagged = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col("__part").alias("__p"), "__first", before.alias("__base"))
    joined = tagged.join(F.broadcast(base), F.col("__part") == F.col("__p"))  # one row for each partition
    number = F.col("__at") - F.col("__first") + F.col("__base") + 1 + after
    return joined.withColumn(column, number.cast("long")).drop("__part", "__at", "__p", "__first", "__base")
