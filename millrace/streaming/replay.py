"""Change feeds: a folder of change files applied to a table, as a follower replays a log.

A change is a row of the table with `op` ('upsert' or 'delete') and `seq`, its order. Structured Streaming reads each file once;
a micro-batch becomes one new version of the table. Changes name whole rows by key, so a batch that is run again after a
failure gives the same table. The last `seq` of each key that a feed has changed is kept beside its checkpoint, so a change that
comes in a later batch than a newer one of its key is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    """The last change of each key; of several with one seq that of greatest hash, a deletion last."""
    ties = (F.col("op") == "upsert").desc(), F.xxhash64(*changes.columns).desc()
    last = Window.partitionBy(*key).orderBy(F.col("seq").desc(), *ties)
    return changes.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def applied(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after a set of changes: one anti-join and a union."""
    last = latest(changes, key)
    kept = target.join(last.select(*key), key, "left_anti").select(*target.columns)
    return kept.unionAll(last.where("op = 'upsert'").select(*target.columns))


def follow(engine: Engine, table: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Replays a folder of Parquet change files into a table."""
    t = engine._table(table)
    schema = T.StructType([*t.schema().fields, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())])

    seqs, kept = f"{checkpoint.rstrip('/')}-seqs", t.key

    def apply(batch: DataFrame, number: int) -> None:
        spark, last = engine.spark, latest(batch, kept)
        path = spark._jvm.org.apache.hadoop.fs.Path(seqs)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(seqs).where(F.col("batch") < number)
            known = known.join(last.select(*kept), kept, "left_semi").groupBy(*kept).agg(F.max("seq").alias("__known"))
            last = last.join(known, kept, "left").where("__known IS NULL OR seq > __known").drop("__known")
        engine.change(table, last.where("op = 'upsert'"), last.where("op <> 'upsert'"))
        last.select(*kept, "seq").write.mode("overwrite").parquet(f"{seqs}/batch={number}")

    writer = engine.spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
