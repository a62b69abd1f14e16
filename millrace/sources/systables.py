"""System tables: the catalog and the session as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types
from ..catalog import Catalog

# Names and columns.
COLUMNS = {
    "systables": "tablespace string, table_name string, table_uuid string, systemtable string",
    "syscolumns": "table_name string, column_name string, ordinal_position int, is_nullable int, data_type string, type_name string, auto_increment int, default_value string",
    "sysindexes": "tablespace string, table_name string, index_name string, index_uuid string, index_type string, unique int",
    "sysindexcolumns": "tablespace string, table_name string, index_name string, index_uuid string, index_type string, column_name string, ordinal_position int, clustered int, unique int",
    "sysforeignkeys": "child_table_name string, child_table_column_name string, child_table_cons_name string, parent_table_name string, parent_table_column_name string, on_delete_action string, on_update_action string, ordinal_position int, deferred string",
    "systablestats": "tablespace string, table_name string, systemtable string, tablesize long, loadedpages int, loadedpagescount long, unloadedpagescount long, dirtypages int, dirtyrecords long, maxlogicalpagesize long, keysmemory long, buffersmemory long, dirtymemory long",
    "systransactions": "tablespace string, txid long, creationtimestamp timestamp_ntz",
    "systablespaces": "tablespace_name string, uuid string, leader string, replica string, expectedreplicacount int, maxleaderinactivitytime long",
    "systablespacereplicastate": "tablespace_name string, uuid string, nodeid string, mode string, timestamp timestamp_ntz, maxleaderinactivitytime long, inactivitytime long",
    "sysnodes": "nodeid string, address string, ssl int",
    "sysstatements": "id long, tablespace string, query string, startts timestamp_ntz, runningtime long, batches int, info string",
    "syslogstatus": "tablespace_uuid string, nodeid string, tablespace_name string, ledger long, offset long, status string",
    "sysconfig": "name string, value string",
    "sysclients": "id long, username string, address string, connectionts timestamp_ntz",
    "dual": "dummy string",
}
NAMES = tuple(COLUMNS)


def system_table(catalog: Catalog, name: str, transactions: dict[int, float] | None = None) -> DataFrame:
    """One of the system tables. Those of a cluster of its own (replicas, clients, log, statements) are empty."""
    spark, name = catalog.spark, name.lower()
    tables = [t for ts in catalog.spaces.values() for t in ts.values()]
    rows: list[tuple] = []
    if name == "systables":
        rows = [(t.space, t.name, t.uuid, "false") for t in tables] + [(s, n, n, "true") for s in catalog.spaces for n in NAMES]
    elif name == "syscolumns":
        rows = [(t.name, c.name, i, int(c.nullable), types.sql_name(types.parse(c.type)), c.type, int(c.auto_increment), c.default) for t in tables for i, c in enumerate(t.columns, 1)]
    elif name == "sysindexes":
        rows = [(t.space, t.name, i.name, i.uuid, i.kind, int(i.unique)) for t in tables for i in t.indexes]
    elif name == "sysindexcolumns":
        for t in tables:
            rows += [(t.space, t.name, "primary", t.uuid, "pk", c, k, 1, 1) for k, c in enumerate(t.key, 1)]
            rows += [(t.space, t.name, i.name, i.uuid, i.kind, c, k, 0, int(i.unique)) for i in t.indexes for k, c in enumerate(i.columns, 1)]
    elif name == "sysforeignkeys":
        rows = [(t.name, c, k.name, k.parent, p, k.on_delete, k.on_update, i, "NOT DEFERRABLE") for t in tables for k in t.foreign_keys for i, (c, p) in enumerate(zip(k.columns, k.references), 1)]
    elif name == "systablestats":
        parts = [catalog.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.space), F.lit(t.name), F.lit("false"), "n", *[F.lit(0)] * 9) for t in tables]
        out = spark.createDataFrame([], COLUMNS[name])
        for p in parts:
            out = out.unionAll(p)
        return out
    elif name == "systransactions":
        now = transactions or {}
        return spark.createDataFrame([("default", tx) for tx in now], "tablespace string, txid long").withColumn("creationtimestamp", F.localtimestamp())
    elif name == "systablespaces":
        rows = [(s, s, "local", "local", 1, 0) for s in catalog.spaces]
    elif name == "sysnodes":
        rows = [("local", spark.sparkContext.master, 0)]
    elif name == "sysconfig":
        rows = sorted(spark.sparkContext.getConf().getAll())
    elif name == "dual":
        rows = [("",)]
    elif name not in COLUMNS:
        raise ValueError(f"no system table {name}")
    return spark.createDataFrame(rows, COLUMNS[name])


