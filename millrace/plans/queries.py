"""One query for each operator of the engine, with SQL for DuckDB that gives the same rows.

Queries that both engines read alike are given once, in SQL; the others pair a function over DataFrames with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, scalars, vectors
from ..operators import dml, keys, relational
from ..sources import tables
from . import admin, dialect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, sql: str, oracle: str | None = None, uses: str = "") -> None:
    """A query in SQL, through the front door's rewriting; names of tables are found in the text."""
    words = {t.ident for t in dialect.tokens(sql) if t.kind == "word"}
    used = [n for n in tables.NAMES if n in words]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables.views(spark, folder, *used)
        return spark.sql(dialect.rewritten(sql))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql


def _df(oracle: str | None = None) -> Callable[[Query], Query]:
    """A query over DataFrames."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- scans, filters, projections ---

_sql("table_scan", "SELECT * FROM nation")
_sql("scan_filter_project", "SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07")
_sql("projection_reorder", "SELECT r_name, r_regionkey FROM region")
_sql("pk_seek", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
_sql("pk_prefix", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 42")
_sql("pk_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 250")
_sql("secondary_index_seek", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
_sql("secondary_index_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 6000")
_sql("equals_not_equals", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 AND n_nationkey = n_nationkey")
_sql("comparisons", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0 AND s_acctbal <= 5000 OR s_suppkey < 3 OR s_suppkey > 95")
_sql("in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')")
_sql("between_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000")
_sql("or_of_ranges", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size BETWEEN 20 AND 25 OR p_size > 45")
_sql("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE '_x%'")
_sql("like_escape", "SELECT c_custkey, c_name FROM customer WHERE concat(c_name, '%') LIKE '%1!%' ESCAPE '!'")
_sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_sql("null_logic", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NULL AS unknown, COALESCE(NULLIF(n_regionkey, 1) > 2, FALSE) AS above FROM nation WHERE NOT (NULLIF(n_regionkey, 1) <= 0)")
_sql("is_not_true", "SELECT n_nationkey FROM nation WHERE (NULLIF(n_regionkey, 1) > 2) IS NOT TRUE")
_sql("is_null", "SELECT n_nationkey, n_name FROM nation WHERE NULLIF(n_regionkey, 2) IS NULL OR NULLIF(n_regionkey, 3) IS NULL")
_sql("boolean_literals", "SELECT r_regionkey, TRUE AS yes, r_regionkey > 2 AS above FROM region WHERE TRUE AND NOT FALSE")
_sql("arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CAST(l_linenumber AS BIGINT) + 1 AS next_line, CAST(l_linenumber AS BIGINT) * 5 - 2 AS scaled FROM lineitem")
_sql("division", "SELECT o_orderkey, CAST(1 AS DOUBLE) / 2 / 2 AS quarter, o_totalprice / NULLIF(o_custkey, 0) AS ratio FROM orders")
_sql("integer_division", "SELECT o_orderkey, CAST(o_orderkey div 7 AS BIGINT) AS sevenths FROM orders", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS sevenths FROM orders")
_sql("modulo", "SELECT o_orderkey, o_orderkey % 7 AS remainder FROM orders WHERE mod(o_custkey, 5) = 2")
_sql("unary_minus", "SELECT s_suppkey, -s_acctbal AS owed FROM supplier WHERE -s_acctbal < 0")
_sql("casts", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS k, CAST(CAST(o_orderkey AS VARCHAR(20)) AS BIGINT) AS back, CAST(o_custkey AS DOUBLE) AS d FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS back, CAST(o_custkey AS DOUBLE) AS d FROM orders")
_sql("vector_cast", "SELECT vec_id, size(CAST(embedding AS FLOAT ARRAY)) AS n FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")

# --- joins ---

_sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_sql("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o RIGHT JOIN customer ON c_custkey = o_custkey")
_sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey < 20) s FULL JOIN (SELECT * FROM customer WHERE c_custkey BETWEEN 10 AND 30) c ON s.s_suppkey = c.c_custkey")
_sql("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
_sql("join_natural_cross", "SELECT n_name, r_name FROM (SELECT n_name FROM nation) a NATURAL JOIN (SELECT r_name FROM region) b", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND 1 <> 2")
_sql("join_theta", "SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON r.r_regionkey + 3 <= n.n_regionkey")
_sql("join_theta_left", "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON r.r_regionkey > n.n_nationkey")
_sql("join_equi_theta", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate <> o_orderdate AND l_extendedprice > o_totalprice / 4")
_sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_sql("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sql("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_sql("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_sql("join_multiway", "SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
_sql("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
_sql("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("from_subquery", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 12")


@_df("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def join_merge(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.table(spark, folder, "lineitem").where("l_quantity > 45")
    orders = tables.table(spark, folder, "orders").hint("merge")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@_df("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 1) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 1)")
def join_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    nation = tables.table(spark, folder, "nation").selectExpr("n_nationkey", "nullif(n_regionkey, 1) AS k")
    a, b = nation.toDF("a", "ka"), nation.toDF("b", "kb")
    return relational.null_safe(a, b, [("ka", "kb")]).select("a", "b")


# --- aggregation ---

_sql("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
_sql("global_agg", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders")
_sql("global_agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
_sql("count_nulls", "SELECT n_regionkey, count(*) AS n_rows, count(NULLIF(n_nationkey % 2, 0)) AS n_known FROM nation GROUP BY n_regionkey")
_sql("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
_sql("sum_nulls", "SELECT n_regionkey, CAST(sum(NULLIF(n_nationkey, n_nationkey)) AS BIGINT) AS nothing, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
_sql("min_max_timestamp", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
_sql("min_max_text", "SELECT min(c_name) AS first_name, max(c_mktsegment) AS last_segment FROM customer")
_sql("group_by_null", "SELECT NULLIF(n_regionkey, 1) AS k, count(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 1)")
_sql("group_by_expression", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
_sql("having_filter", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql("agg_case", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, CAST(sum(1) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")


@_df("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, COALESCE(sum(CAST(trunc(n_nationkey / 2) AS BIGINT)), 0)::BIGINT AS total, sum(COALESCE(NULLIF(n_nationkey % 3, 0), 0))::DOUBLE / count(*) AS mean FROM nation GROUP BY n_regionkey")
def compat_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    nation = tables.table(spark, folder, "nation")
    some = F.expr("nullif(n_nationkey % 3, 0)")
    return nation.groupBy("n_regionkey").agg(compat.count_rows(some).alias("n"), compat.sum_long(F.col("n_nationkey") / 2).alias("total"), compat.avg_all_rows(some).alias("mean"))


@_df("SELECT n_nationkey, CASE WHEN NULLIF(n_regionkey, 1) IS NULL AND NULLIF(n_nationkey, 2) IS NULL THEN NULL ELSE COALESCE(NULLIF(n_regionkey, 1), 0) + COALESCE(NULLIF(n_nationkey, 2), 0) END AS total FROM nation")
def compat_null_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    total = compat.null_as_zero(lambda a, b: a + b, F.expr("nullif(n_regionkey, 1)"), F.expr("nullif(n_nationkey, 2)"))
    return tables.table(spark, folder, "nation").select("n_nationkey", total.alias("total"))


# --- order, paging, sets ---

_sql("sort_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey NULLS LAST LIMIT 25")
_sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
_sql("limit_comma", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30, 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
_sql("top_n", "SELECT TOP 7 p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
_sql("order_nulls_asc", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 1), n_nationkey LIMIT 22", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 1) ASC NULLS LAST, n_nationkey LIMIT 22")
_sql("order_nulls_desc", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 1) DESC, n_nationkey LIMIT 7", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 1) DESC NULLS FIRST, n_nationkey LIMIT 7")
_sql("order_nulls_first", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 1) NULLS FIRST, n_nationkey DESC LIMIT 7")
_sql("order_by_alias", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, k LIMIT 10")
_sql("limit_zero", "SELECT r_name FROM region LIMIT 0")
_sql("union_all", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
_sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
_sql("with_query", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")


@_df("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return relational.top(orders, 15, ("o_totalprice", "desc"), "o_orderkey")


@_df("SELECT '' AS dummy, 1 + 2 AS three")
def dual(spark: SparkSession, folder: str) -> DataFrame:
    return tables.dual(spark).selectExpr("dummy", "1 + 2 AS three")


# --- functions ---

_sql("extract_parts", "SELECT event_id, CAST(EXTRACT(YEAR FROM ts) AS INT) AS y, CAST(EXTRACT(MONTH FROM ts) AS INT) AS mo, CAST(EXTRACT(DAY FROM ts) AS INT) AS d, CAST(EXTRACT(HOUR FROM ts) AS INT) AS h, CAST(EXTRACT(MINUTE FROM ts) AS INT) AS mi, CAST(EXTRACT(SECOND FROM ts) AS INT) AS s FROM events", "SELECT event_id, CAST(EXTRACT(YEAR FROM ts) AS INTEGER) AS y, CAST(EXTRACT(MONTH FROM ts) AS INTEGER) AS mo, CAST(EXTRACT(DAY FROM ts) AS INTEGER) AS d, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS h, CAST(EXTRACT(MINUTE FROM ts) AS INTEGER) AS mi, CAST(EXTRACT(SECOND FROM ts) AS INTEGER) AS s FROM events")
_sql("extract_millisecond", "SELECT event_id, EXTRACT(MILLISECOND FROM ts) AS ms FROM events", "SELECT event_id, CAST(EXTRACT(MILLISECOND FROM ts) AS INTEGER) % 1000 AS ms FROM events")
_sql("iso_day_of_week", "SELECT event_id, DAYOFWEEK(ts) AS dow FROM events", "SELECT event_id, CAST(isodow(ts) AS INTEGER) AS dow FROM events")
_sql("floor_to_day", "SELECT event_id, CAST(FLOOR(ts TO DAY) AS TIMESTAMP_NTZ) AS day FROM events", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
_sql("timestamp_diff", "SELECT o_orderkey, CAST(timestampdiff(DAY, TIMESTAMP_NTZ '1995-01-01 00:00:00', o_orderdate) AS BIGINT) AS days FROM orders", "SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS BIGINT) AS days FROM orders")
_sql("timestamp_add", "SELECT o_orderkey, CAST(timestampadd(DAY, 10, o_orderdate) AS TIMESTAMP_NTZ) AS due FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS due FROM orders")
_sql("timestamp_literal", "SELECT o_orderkey FROM orders WHERE o_orderdate >= {ts '1997-06-01 00:00:00'}", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'")
_sql("lower_upper", "SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up FROM customer WHERE lower(c_mktsegment) = 'building'")
_sql("abs_values", "SELECT s_suppkey, abs(s_acctbal) AS a, abs(CAST(s_suppkey AS INT) - 50) AS distance FROM supplier")
_sql("round_values", "SELECT o_orderkey, round(o_totalprice, 1) AS r1, round(o_totalprice) AS r0, round(o_totalprice, -2) AS r100 FROM orders")
_sql("vector_functions", "SELECT a.vec_id, round(CAST(cosine_similarity(a.embedding, b.embedding) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS cosine, round(CAST(dot_product(a.embedding, b.embedding) AS DOUBLE), 2) + CAST(0 AS DOUBLE) AS dot, round(CAST(euclidean_distance(a.embedding, b.embedding) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = 0", "SELECT a.vec_id, round(CAST(list_cosine_similarity(a.embedding, b.embedding) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS cosine, round(CAST(list_dot_product(a.embedding, b.embedding) AS DOUBLE), 2) + CAST(0 AS DOUBLE) AS dot, round(CAST(list_distance(a.embedding, b.embedding) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = 0")


@_df("SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = 7 ORDER BY round(CAST(list_cosine_similarity(a.embedding, b.embedding) AS DOUBLE), 4) DESC, a.vec_id LIMIT 10")
def vector_top_k(spark: SparkSession, folder: str) -> DataFrame:
    own = tables.table(spark, folder, "embeddings")
    one = own.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    near = F.round(vectors.cosine_similarity("embedding", "q").cast("double"), 4)
    return relational.top(own.crossJoin(F.broadcast(one)).withColumn("near", near), 10, ("near", "desc"), "vec_id").select("vec_id")


@_df("SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS dow, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders")
def date_columns(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("o_orderdate")
    day = scalars.floor_day(ts).cast("timestamp_ntz").alias("day")
    return tables.table(spark, folder, "orders").select("o_orderkey", scalars.iso_dayofweek(ts).alias("dow"), scalars.extract("YEAR", ts).alias("y"), day)


@_df("SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS in_range, TRUE AS now_known FROM nation")
def random_and_now(spark: SparkSession, folder: str) -> DataFrame:
    r = scalars.random_int()
    rows = tables.table(spark, folder, "nation").select(r.alias("r"), F.current_timestamp().alias("now"), F.current_date().alias("today"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("r").between(-2147483648, 2147483647)).alias("in_range"), F.bool_and(F.col("now") >= F.col("today")).alias("now_known"))


@_df("SELECT s_suppkey, floor(s_acctbal * 10 + 0.5) / 10 AS r FROM supplier")
def compat_round(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "supplier").select("s_suppkey", compat.round_half_up(F.col("s_acctbal"), 1).alias("r"))


# --- changes: each query returns the table after the change ---


@_df("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '2', n_regionkey FROM nation WHERE n_regionkey = 1")
def insert_select(spark: SparkSession, folder: str) -> DataFrame:
    nation = tables.table(spark, folder, "nation")
    return dml.insert(nation, nation.where("n_regionkey = 1").selectExpr("n_nationkey + 100 AS n_nationkey", "n_name || '2' AS n_name", "n_regionkey"))


@_df("SELECT * FROM region UNION ALL VALUES (10, 'NOWHERE'), (11, 'NOWHERE')")
def insert_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.values(spark, [(10,), (11,)], "r_regionkey int")
    return dml.insert(tables.table(spark, folder, "region"), rows, {"r_name": F.lit("NOWHERE")})


@_df("SELECT * FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, 0.0, 'NEW' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 5")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    own = tables.table(spark, folder, "customer")
    changed = own.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).withColumn("c_mktsegment", F.lit("NEW"))
    return dml.upsert(own, changed.unionAll(own.where("c_custkey < 5").withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@_df("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_where(spark: SparkSession, folder: str) -> DataFrame:
    return dml.update(tables.table(spark, folder, "customer"), {"c_acctbal": F.col("c_acctbal") + 100}, F.col("c_mktsegment") == "BUILDING")


@_df("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'BIG' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_subquery(spark: SparkSession, folder: str) -> DataFrame:
    big = tables.table(spark, folder, "orders").where("o_totalprice > 400000").select("o_custkey")
    return dml.update_in(tables.table(spark, folder, "customer"), {"c_mktsegment": F.lit("BIG")}, "c_custkey", big)


@_df("SELECT CASE WHEN r_regionkey >= 3 THEN r_regionkey + 10 ELSE r_regionkey END AS r_regionkey, r_name FROM region")
def update_key(spark: SparkSession, folder: str) -> DataFrame:
    return dml.update(tables.table(spark, folder, "region"), {"r_regionkey": F.col("r_regionkey") + 10}, F.col("r_regionkey") >= 3)


@_df("SELECT * FROM orders WHERE NOT COALESCE(o_orderstatus = 'F' AND NULLIF(o_custkey % 3, 0) = 1, FALSE)")
def delete_where(spark: SparkSession, folder: str) -> DataFrame:
    return dml.delete(tables.table(spark, folder, "orders"), F.expr("o_orderstatus = 'F' AND nullif(o_custkey % 3, 0) = 1"))


@_df("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def delete_subquery(spark: SparkSession, folder: str) -> DataFrame:
    big = tables.table(spark, folder, "orders").where("o_totalprice > 300000").select("o_custkey")
    return dml.delete_in(tables.table(spark, folder, "customer"), "c_custkey", big)


@_df("SELECT * FROM supplier WHERE FALSE")
def truncate(spark: SparkSession, folder: str) -> DataFrame:
    return dml.truncate(tables.table(spark, folder, "supplier"))


@_df("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(row_number) AS BIGINT) AS first_id, CAST(max(row_number) AS BIGINT) AS last_id, CAST(count(DISTINCT row_number) AS BIGINT) AS n_ids FROM (SELECT row_number() OVER () AS row_number FROM orders)")
def auto_increment(spark: SparkSession, folder: str) -> DataFrame:
    rows = dml.numbered(tables.table(spark, folder, "orders").select("o_custkey"), "id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("n_ids"))


@_df("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_check(spark: SparkSession, folder: str) -> DataFrame:
    return keys.duplicates(tables.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@_df("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def foreign_key_check(spark: SparkSession, folder: str) -> DataFrame:
    parents = tables.table(spark, folder, "customer").where("c_custkey % 4 <> 0")
    return keys.orphans(tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], parents, ["c_custkey"])


@_df("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def foreign_key_cascade(spark: SparkSession, folder: str) -> DataFrame:
    gone = tables.table(spark, folder, "customer").where("c_acctbal < 0")
    return keys.cascaded(tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], gone, ["c_custkey"])


@_df("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def foreign_key_set_null(spark: SparkSession, folder: str) -> DataFrame:
    gone = tables.table(spark, folder, "customer").where("c_acctbal < 0")
    return keys.nulled(tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], gone, ["c_custkey"])


@_df("SELECT CAST(count(*) AS BIGINT) AS n_rows, TRUE AS same_in_any_order, TRUE AS differs_if_changed FROM lineitem")
def table_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """The checksum of a table, compared with that of its rows dealt anew and with some values changed."""
    own = tables.table(spark, folder, "lineitem")
    changed = own.withColumn("l_quantity", F.when(F.col("l_linenumber") == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    a, b, c = (admin.checksum(x).select(F.struct("*").alias(n)) for x, n in ((own, "a"), (own.repartition("l_partkey"), "b"), (changed, "c")))
    one = a.join(b).join(c)  # one row each
    return one.select(F.col("a.n_rows").alias("n_rows"), (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("differs_if_changed"))


@_df("SELECT * FROM (VALUES ('query', TRUE), ('logicalplan', TRUE), ('plan', TRUE), ('finalplan', TRUE)) t(name, names_its_table)")
def explain_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = admin.explained(QUERIES["scan_filter_project"](spark, folder), "SELECT ... FROM lineitem")
    return found.select("name", F.col("value").rlike("lineitem|l_orderkey").alias("names_its_table"))


# --- the engine: catalog, statements, transactions, system tables ---


def _engine(spark: SparkSession):
    """An engine over a catalog of its own in the warehouse."""
    import uuid

    from ..engine import Engine

    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    e = Engine(spark, f"{root}/millrace-{uuid.uuid4().hex}")
    e.execute("CREATE TABLE part_of (pk INT PRIMARY KEY, name VARCHAR(20) NOT NULL DEFAULT 'none', size INT, INDEX by_size(size))")
    e.execute("CREATE TABLE note (id LONG AUTO_INCREMENT PRIMARY KEY, part INT, FOREIGN KEY (part) REFERENCES part_of(pk) ON DELETE CASCADE)")
    e.execute("INSERT INTO part_of (pk, size) VALUES (1, 10), (2, 20), (3, NULL)")
    e.execute("INSERT INTO note (part) VALUES (1), (2), (2)")
    return e


@_df("SELECT * FROM (VALUES (1, 'none', 11), (3, 'three', NULL), (4, 'four', 40)) t(pk, name, size)")
def engine_statements(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("UPDATE part_of SET size = size + 1 WHERE pk = ?", [1])
    e.execute("UPSERT INTO part_of VALUES (3, 'three', NULL), (4, 'four', 40)")
    e.execute("DELETE FROM part_of WHERE pk IN (SELECT part FROM note GROUP BY part HAVING count(*) > 1)")
    return e.query("SELECT * FROM part_of")


@_df("SELECT * FROM (VALUES (1, 5), (2, 20), (3, NULL)) t(pk, size)")
def engine_transactions(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    for sql in ("BEGIN TRANSACTION", "DELETE FROM part_of WHERE pk = 1", "ROLLBACK", "BEGIN TRANSACTION", "UPDATE part_of SET size = 5 WHERE pk = 1", "COMMIT"):
        e.execute(sql)
    return e.query("SELECT pk, size FROM part_of")


@_df("SELECT * FROM (VALUES ('note', 'id', 1, 0, 1), ('note', 'part', 2, 1, 0), ('part_of', 'name', 2, 0, 0), ('part_of', 'pk', 1, 0, 0), ('part_of', 'size', 3, 1, 0)) t(table_name, column_name, ordinal_position, is_nullable, auto_increment)")
def system_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT table_name, column_name, ordinal_position, is_nullable, auto_increment FROM syscolumns")


@_df("SELECT * FROM (VALUES ('note', 'part', 'part_of', 'pk', 'CASCADE', 'part_of', 'by_size')) t(child, child_column, parent, parent_column, on_delete, indexed, index_name)")
def system_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT k.child_table_name AS child, k.child_table_column_name AS child_column, k.parent_table_name AS parent, k.parent_table_column_name AS parent_column, k.on_delete_action AS on_delete, i.table_name AS indexed, i.index_name FROM sysforeignkeys k JOIN sysindexes i ON i.table_name = k.parent_table_name")


@_df("SELECT * FROM (VALUES ('default', 'note', 'false'), ('default', 'part_of', 'false')) t(tablespace, table_name, systemtable)")
def system_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT tablespace, table_name, systemtable FROM systables WHERE systemtable = 'false'")


@_df("SELECT 'CREATE TABLE default.part_of (pk int NOT NULL, name varchar(20) NOT NULL DEFAULT ''none'', size int, PRIMARY KEY(pk), INDEX by_size(size))' AS create_statement")
def show_create_table(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SHOW CREATE TABLE part_of WITH INDEXES").select("create_statement")


# --- the engine: parameters, batches, keys ---


@_df("SELECT * FROM (VALUES (2), (3)) t(pk)")
def limit_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT pk FROM part_of ORDER BY pk LIMIT ?, ?", [1, 2])


@_df("SELECT * FROM (VALUES (1), (2)) t(pk)")
def client_max_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT pk FROM part_of ORDER BY pk", max_rows=2)


@_df("SELECT * FROM (VALUES (1), (2)) t(pk)")
def top_in_subquery(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT pk FROM (SELECT TOP ? pk FROM part_of ORDER BY pk) t", [2])


@_df("SELECT k1, CAST(similarity AS DOUBLE) AS similarity FROM (VALUES ('a', 0.97014), ('b', 0.99388), ('c', 1.0)) t(k1, similarity)")
def vector_parameters(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("CREATE TABLE vectors (k1 string PRIMARY KEY, v1 floata)")
    e.execute("INSERT INTO vectors VALUES ('a', CAST(array(0.2, 0.8) AS FLOAT ARRAY)), ('b', array(0.1, 0.9))")
    e.execute("INSERT INTO vectors VALUES (?, ?)", ["c", [0.0, 1.0]])
    return e.query("SELECT k1, round(cast(cosine_similarity(v1, CAST(? AS FLOAT ARRAY)) AS double), 5) AS similarity FROM vectors", [[0.0, 1.0]])


@_df("SELECT * FROM (VALUES (2, 'none', 20)) t(pk, name, size)")
def get_by_key(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    return tables.values(spark, [tuple(e.get("part_of", pk=2).values())], "pk int, name string, size int")


@_df("SELECT CAST(id AS BIGINT) AS id, part FROM (VALUES (4, 3), (5, 3), (6, 1)) t(id, part)")
def batch_with_generated_keys(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute_batch("INSERT INTO note (part) VALUES (?)", [[3], [3], [1]])
    return e.generated_keys().join(e.query("SELECT * FROM note"), "id")


@_df("SELECT * FROM (VALUES (1, 10), (2, 20), (3, NULL)) t(pk, size)")
def select_for_update(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT pk, size FROM part_of FOR UPDATE")


# --- the engine: integrity ---


def _refused(e, sql: str) -> bool:
    try:
        e.execute(sql)
    except ValueError:
        return True
    return False


@_df("SELECT TRUE AS refused, CAST(3 AS BIGINT) AS n_notes, CAST(3 AS BIGINT) AS n_parts")
def refused_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A child that cascades and one that refuses: the statement leaves both as they were."""
    e = _engine(spark)
    e.execute("CREATE TABLE held (id int PRIMARY KEY, part int, FOREIGN KEY (part) REFERENCES part_of(pk))")
    e.execute("INSERT INTO held VALUES (1, 2)")
    refused = _refused(e, "DELETE FROM part_of WHERE pk <= 2")
    return e.query("SELECT ? AS refused, (SELECT count(*) FROM note) AS n_notes, (SELECT count(*) FROM part_of) AS n_parts", [refused])


@_df("SELECT TRUE AS drop_refused, 'code' AS parent_column, TRUE AS orphan_refused")
def referenced_columns(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("ALTER TABLE part_of RENAME COLUMN pk TO code")
    dropped, orphan = _refused(e, "ALTER TABLE part_of DROP COLUMN code"), _refused(e, "INSERT INTO note (part) VALUES (99)")
    return e.query("SELECT ? AS drop_refused, parent_table_column_name AS parent_column, ? AS orphan_refused FROM sysforeignkeys", [dropped, orphan])


@_df("SELECT CAST(1 AS BIGINT) AS n_first, CAST(1 AS BIGINT) AS n_second, TRUE AS clash_refused")
def concurrent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Two sessions over one catalog: neither loses what the other has made; changes of one table clash."""
    from ..engine import Engine

    first = _engine(spark)
    second = Engine(spark, first.catalog.root)
    first.execute("CREATE TABLE made_first (k int PRIMARY KEY)")
    second.execute("CREATE TABLE made_second (k int PRIMARY KEY)")
    for sql in ("BEGIN TRANSACTION", "UPDATE part_of SET size = 0 WHERE pk = 1"):
        first.execute(sql)
    second.execute("UPDATE part_of SET size = 1 WHERE pk = 1")
    clash = _refused(first, "COMMIT")
    first.execute("INSERT INTO made_first VALUES (1)")
    second.execute("INSERT INTO made_second VALUES (1)")
    return Engine(spark, first.catalog.root).query("SELECT (SELECT count(*) FROM made_first) AS n_first, (SELECT count(*) FROM made_second) AS n_second, ? AS clash_refused", [clash])


@_df("SELECT pk, extent, CAST(0.5 AS DOUBLE) AS weight FROM (VALUES (1, 10), (2, 20), (3, NULL)) t(pk, extent)")
def alter_table(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    for sql in ("DROP INDEX by_size", "ALTER TABLE part_of RENAME COLUMN size TO extent", "ALTER TABLE part_of ADD COLUMN weight double DEFAULT 0.5", "ALTER TABLE part_of DROP COLUMN name", "EXECUTE RENAMETABLE 'default', 'part_of', 'piece'"):
        e.execute(sql)
    return e.query("SELECT * FROM piece")


@_df("SELECT * FROM (VALUES ('default', 'part_of')) t(tablespace, table_name)")
def drop_table(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("DROP TABLE note")
    return e.query("SELECT tablespace, table_name FROM systables WHERE systemtable = 'false'")


# --- the engine: log replay, backup, system tables ---


@_df("SELECT * FROM (VALUES (1, 'one', 11), (3, 'none', NULL), (7, 'new', 70)) t(pk, name, size)")
def log_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A change feed applied in two batches; the change that comes late and is older is left out."""
    from ..streaming.replay import follow

    e, schema = _engine(spark), "pk int, name string, size int, op string, seq long"
    feed = f"{e.catalog.root}-feed"
    for rows in ([(1, "one", 11, "upsert", 5), (2, None, None, "delete", 6)], [(1, "old", 9, "upsert", 4), (7, "new", 70, "upsert", 7)]):
        tables.values(spark, rows, schema).coalesce(1).write.mode("append").parquet(feed)
        follow(e, "part_of", feed, f"{e.catalog.root}-marks").awaitTermination()
    return e.query("SELECT * FROM part_of")


@_df("SELECT * FROM (VALUES (1, 10), (2, 20), (3, NULL)) t(pk, size)")
def backup_restore(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    admin.dump(e.catalog, "default", f"{e.catalog.root}-dump")
    admin.restore(e.catalog, "again", f"{e.catalog.root}-dump")
    e.execute("DELETE FROM note")
    e.execute("DELETE FROM part_of")
    return e.query("SELECT pk, size FROM again.part_of")


@_df("SELECT * FROM (VALUES ('note', 'pk', 'id', 1, 1, 1), ('part_of', 'brin', 'size', 1, 0, 0), ('part_of', 'pk', 'pk', 1, 1, 1)) t(table_name, index_type, column_name, ordinal_position, clustered, is_unique)")
def system_index_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT table_name, index_type, column_name, ordinal_position, clustered, unique AS is_unique FROM sysindexcolumns")


@_df("SELECT * FROM (VALUES ('note', CAST(3 AS BIGINT)), ('part_of', CAST(3 AS BIGINT))) t(table_name, tablesize)")
def system_table_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query("SELECT table_name, tablesize FROM systablestats")


@_df("SELECT 'default' AS tablespace, CAST(1 AS BIGINT) AS n, TRUE AS dated")
def system_transactions(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("BEGIN TRANSACTION")
    return e.query("SELECT tablespace, count(*) AS n, min(creationtimestamp) IS NOT NULL AS dated FROM systransactions GROUP BY tablespace")


@_df("SELECT * FROM (VALUES ('default', 1), ('other', 1)) t(tablespace_name, expectedreplicacount)")
def system_table_spaces(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark)
    e.execute("CREATE TABLESPACE 'other'")
    return e.query("SELECT tablespace_name, expectedreplicacount FROM systablespaces")


@_df("SELECT TRUE AS has_node, TRUE AS has_config, CAST(0 AS BIGINT) AS n_replicas, CAST(0 AS BIGINT) AS n_statements, CAST(0 AS BIGINT) AS n_logs, CAST(0 AS BIGINT) AS n_clients")
def system_cluster_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark).query(
        "SELECT (SELECT count(*) FROM sysnodes) = 1 AS has_node, (SELECT count(*) FROM sysconfig WHERE name = 'spark.app.name') = 1 AS has_config, (SELECT count(*) FROM systablespacereplicastate) AS n_replicas, "
        "(SELECT count(*) FROM sysstatements) AS n_statements, (SELECT count(*) FROM syslogstatus) AS n_logs, (SELECT count(*) FROM sysclients) AS n_clients"
    )
