"""EXPLAIN, SHOW CREATE TABLE, checksums, dump and restore."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_SPACE, HIDDEN_KEY, Catalog, TableDef, _table


def explained(df: DataFrame, query: str) -> DataFrame:
    """Four rows: the query, its logical plan, the optimised plan and the physical plan."""
    q = df._jdf.queryExecution()
    rows = [("query", query), ("logicalplan", q.analyzed().toString()), ("plan", q.optimizedPlan().toString()), ("finalplan", q.executedPlan().toString())]
    return df.sparkSession.createDataFrame(rows, "name string, value string")


def show_create(table: TableDef, with_indexes: bool = False) -> str:
    parts = []
    for c in table.columns:
        if c.name == HIDDEN_KEY:
            continue
        more = ("" if c.nullable else " NOT NULL") + (" AUTO_INCREMENT" if c.auto_increment else "") + (f" DEFAULT {c.default}" if c.default else "")
        parts.append(f"{c.name} {c.type}{more}")
    if table.key != [HIDDEN_KEY]:
        parts.append(f"PRIMARY KEY({','.join(table.key)})")
    if with_indexes:
        parts += [f"{'UNIQUE KEY' if i.unique else 'INDEX'} {i.name}({','.join(i.columns)})" for i in table.indexes]
    for k in table.foreign_keys:
        parts.append(f"CONSTRAINT {k.name} FOREIGN KEY ({','.join(k.columns)}) REFERENCES {k.parent}({','.join(k.references)}) ON DELETE {k.on_delete} ON UPDATE {k.on_update}")
    return f"CREATE TABLE {table.space}.{table.name} ({', '.join(parts)})"


def checksum(df: DataFrame) -> DataFrame:
    """n_rows and a checksum that doesn't depend on the order of rows: one pass with partial aggregation, no sort."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("total"))


def dump(catalog: Catalog, space: str, path: str) -> None:
    """A space as Parquet tables and a manifest."""
    tables = catalog.spaces[space]
    for t in tables.values():
        catalog.read(t).write.mode("overwrite").parquet(f"{path}/{t.name}")
    manifest = json.dumps([asdict(t) for t in tables.values()])
    catalog.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest_tables")


def restore(catalog: Catalog, space: str, path: str) -> None:
    """A dumped space under a (new) name; references among its tables follow."""
    found = [_table(d) for d in json.loads(catalog.spark.read.text(f"{path}/_manifest_tables", wholetext=True).first().value)]
    catalog.refresh()
    base, mine = catalog.snapshot(), catalog.snapshot()
    own, names = mine.setdefault(space, {}), {t.name for t in found}
    for t in found:
        for k in t.foreign_keys:
            of, _, parent = k.parent.rpartition(".")
            if (of or DEFAULT_SPACE) == t.space and parent in names:
                k.parent = parent if space == DEFAULT_SPACE else f"{space}.{parent}"
    for t in found:
        rows = catalog.spark.read.schema(t.schema()).parquet(f"{path}/{t.name}")
        t.space, t.manifest, t.version, t.uuid = space, None, 0, uuid.uuid4().hex
        own[t.name] = t
        catalog.write(t, rows)
    catalog.merge(base, mine)
