import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types
from millrace.functions import compat, scalars, vectors
from millrace.operators import dml, keys, relational


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_vectors(spark):
    df = spark.createDataFrame([(1234, [0.2, 0.8]), (1235, [0.1, 0.9]), (1236, [0.0, 1.0]), (0, [0.0, 0.0]), (1, None)], "n int, v array<float>")
    got = {r.n: r for r in df.select("n", vectors.cosine_similarity("v", [0, 1]).alias("c"), vectors.dot_product("v", [0, 1]).alias("d"), vectors.euclidean_distance("v", [0, 1]).alias("e")).collect()}
    assert got[1236].c == 1 and got[1236].e == 0 and got[0].c == 0 and got[1].c is None
    assert got[1236].c > got[1235].c > got[1234].c
    with pytest.raises(PySparkException, match="differ in length"):
        df.select(vectors.dot_product("v", [1, 2, 3])).collect()


def test_scalars(spark):
    ts = F.lit("2024-02-29 13:14:15.678").cast("timestamp_ntz")
    units = ("YEAR", "MONTH", "DAY", "DOW", "HOUR", "MINUTE", "SECOND", "MILLISECOND")
    assert one(spark, *(scalars.extract(u, ts) for u in units)) == (2024, 2, 29, 4, 13, 14, 15, 678)
    assert one(spark, scalars.extract("DOW", F.lit(None).cast("timestamp_ntz"))) == (None,)
    with pytest.raises(ValueError, match="extract"):
        scalars.extract("CENTURY", ts)


def test_compat(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (None,)], "n int")
    assert tuple(df.agg(compat.avg_all_rows(F.col("n")), compat.avg_int(F.col("n")), compat.sum_long(F.col("n")), compat.count_rows(F.col("n"))).first()) == (2.0, 2, 8, 4)
    assert df.where("n IS NULL").agg(compat.sum_long(F.col("n"))).first()[0] == 0
    assert one(spark, compat.round_half_up(F.lit(-2.5)), F.round(F.lit(-2.5))) == (-2.0, -3.0)
    add = lambda a, b: a + b
    null = F.lit(None).cast("int")
    assert one(spark, compat.null_as_zero(add, null, F.lit(3)), compat.null_as_zero(add, null, null)) == (3, None)
    assert one(spark, compat.timestamp_text(F.lit("1970-01-01 01:00:00").cast("timestamp_ntz")), compat.two_valued(F.lit(None).cast("boolean"))) == ("1970-01-01 01:00:00.0", False)


def test_types():
    assert types.parse("VARCHAR(20)") == T.StringType() and types.parse("tinyint") == T.IntegerType()
    assert types.parse("decimal(10,2)") == T.DoubleType() and types.parse("decimal(10)") == T.IntegerType() and types.parse("decimal(0)") == T.LongType()
    assert types.parse("timestamp with time zone") == T.TimestampNTZType() and types.parse("floata") == types.VECTOR
    assert types.parse("double precision") == T.DoubleType()
    with pytest.raises(ValueError, match="unknown"):
        types.parse("uuid")


def test_joins(spark):
    t1 = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B")], "k1 string, n1 int, s1 string")
    t2 = spark.createDataFrame([("c", 3, "A"), ("d", 4, "A")], "k2 string, n2 int, s2 string")
    t3 = spark.createDataFrame([("a", 1, "A"), ("b", 3, "B")], "k1 string, n3 int, s3 string")
    assert relational.natural(t1, t2).count() == 4 and relational.natural(t1, t3).count() == 2
    assert t3.join(t2, t3.n3 == t2.n2, "full").count() == 3
    assert [(r.k1, r.k2) for r in t1.join(t2, t1.n1 + 3 <= t2.n2).collect()] == [("a", "d")]
    assert relational.semi(t1, t3, ["k1"]).count() == 2 and relational.anti(t1, t3, t1.n1 == t3.n3).count() == 1


def test_sort_and_page(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "n int")
    assert [r.n for r in relational.sort(df, "n").collect()] == [1, 3, None]
    assert [r.n for r in relational.sort(df, ("n", "desc")).collect()] == [None, 3, 1]
    assert [r.n for r in relational.sort(df, ("n", "desc", "last")).collect()] == [3, 1, None]
    assert [r.n for r in relational.page(relational.sort(df, "n"), 1, 1).collect()] == [3] and relational.page(df, 0).count() == 0


def test_numbered_is_dense(spark):
    got = dml.numbered(spark.range(1000).repartition(7), "n", after=5)
    assert sorted(r.n for r in got.collect()) == list(range(6, 1006))
    assert dml.numbered(spark.range(0), "n").count() == 0


def test_reference_with_some_nulls(spark):
    child = spark.createDataFrame([(1, None), (None, None), (1, 2), (9, 9)], "a int, b int")
    parent = spark.createDataFrame([(1, 2)], "x int, y int")
    assert sorted(map(tuple, keys.orphans(child, ["a", "b"], parent, ["x", "y"]).collect()), key=str) == [(1, None), (9, 9)]
    assert keys.duplicates(child, ["a"], skip_nulls=True).collect()[0].n_rows == 2
