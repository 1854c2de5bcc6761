"""Sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same


def page_after(df: DataFrame, keys: list[str], last: tuple | None, rows: int) -> DataFrame:
    """The next page by keyset: rows after the last seen key, instead of counting off an offset."""
    if last is not None:
        df = df.filter(F.struct(*keys) > F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, last))))
    return df.orderBy(*keys).limit(rows)


def _keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    first = page_after(orders, ["o_custkey", "o_orderkey"], None, 10).collect()[-1]
    return page_after(orders, ["o_custkey", "o_orderkey"], tuple(first), 10)


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random order changes no row."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy(F.rand(1)).select("n_nationkey")


QUERIES = [
    same("o01_order_by", "SELECT n_regionkey, n_name, row_number() OVER (ORDER BY n_regionkey, n_name DESC) AS place FROM {nation} ORDER BY n_regionkey, n_name DESC"),
    same("o02_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    same("o03_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    Query("o03_keyset_page", _keyset, "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET 10"),
    same("o04_top_k", "SELECT p_brand, count(*) AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5"),
    same("o05_order_by_case", "SELECT o_orderkey, o_orderpriority FROM {orders} ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 30"),
    same("o06_order_by_distance", "SELECT s_suppkey FROM {supplier} ORDER BY abs(s_acctbal - 5000), s_suppkey LIMIT 3"),
    Query("o07_random_order", _shuffled, "SELECT n_nationkey FROM nation"),
    same("u01_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}"),
    same("u02_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}"),
    same("u03_union_as_one_pass", "SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM {orders}"),
    same("u04a_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}"),
    same("u04b_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000"),
    same("u05_hot_and_cold", "SELECT tier, count(*) AS n FROM (SELECT 'hot' AS tier, o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' UNION ALL SELECT 'cold', o_orderkey FROM {orders} WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00') t GROUP BY tier"),
]
