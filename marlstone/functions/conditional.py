"""Conditional, mathematical and session functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, bare, same

_T = "(SELECT c_custkey AS id, CASE WHEN c_acctbal > 7000 THEN 'gold' WHEN c_acctbal > 3000 THEN 'silver' WHEN c_acctbal > 0 THEN 'basic' END AS tier, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 300 * (c_custkey % 2) END AS spend, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_name END AS second, CASE WHEN c_custkey % 2 = 0 THEN 'f' || c_name END AS first_ FROM {customer}) AS t"
_D = bare(_T)


def discount(tier: F.Column, spend: F.Column, override: F.Column) -> F.Column:
    """A waterfall: an override first, then the tier, then the spend, then nothing."""
    return F.coalesce(override, F.when(tier == "gold", 0.2).when(tier == "silver", 0.1), F.when(spend > 1000, 0.05), F.lit(0.0))


def _discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    override = F.when(F.col("c_custkey") % 50 == 0, 0.5)
    tier = F.when(F.col("c_acctbal") > 9000, "gold").when(F.col("c_acctbal") > 7000, "silver")
    return customer.select("c_custkey", discount(tier, F.col("c_acctbal"), override).alias("d"))


QUERIES = [
    same("f60_coalesce", f"SELECT id, coalesce(second, first_, 'none') AS mail FROM {_T}"),
    Query("f61_nvl", f"SELECT id, nvl(tier, 'basic') AS t FROM {_T}", f"SELECT id, ifnull(tier, 'basic') AS t FROM {_D}"),
    Query("f62_nvl2", f"SELECT id, nvl2(second, 'has', 'none') AS s FROM {_T}", f"SELECT id, CASE WHEN second IS NOT NULL THEN 'has' ELSE 'none' END AS s FROM {_D}"),
    same("f63_nullif", f"SELECT id, nullif(spend, 0) AS s FROM {_T}"),
    Query("f64_decode", f"SELECT id, decode(tier, 'gold', 1, 'silver', 2, NULL, 0, 9) AS d FROM {_T}", f"SELECT id, CASE WHEN tier = 'gold' THEN 1 WHEN tier = 'silver' THEN 2 WHEN tier IS NULL THEN 0 ELSE 9 END AS d FROM {_D}"),
    same("f65_greatest_least", f"SELECT id, greatest(spend, 50, id) AS g, least(spend, 50) AS l, greatest(0, least(100, coalesce(spend, 500))) AS clamped FROM {_T}"),
    Query("f66_waterfall", _discount, "SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 50 = 0 THEN 0.5 END, CASE WHEN c_acctbal > 9000 THEN 0.2 WHEN c_acctbal > 7000 THEN 0.1 END, CASE WHEN c_acctbal > 1000 THEN 0.05 END, 0) AS DOUBLE) AS d FROM customer"),
    same("f67_math", "SELECT o_orderkey, round(o_totalprice / 1000, 0) AS r, abs(-o_custkey) AS a, mod(o_orderkey, 7) AS m, o_orderkey % 5 AS k, power(2, o_orderkey % 10) AS p FROM {orders}"),
    Query("f68_random", lambda spark, sf_dir: spark.range(1000).select(F.rand(7).alias("r")).agg((F.min("r") >= 0).alias("low"), (F.max("r") < 1).alias("high")), "SELECT true AS low, true AS high"),
    Query("f69_session", "SELECT current_user() IS NOT NULL AS has_user, current_database() = 'default' AS main_, version() LIKE '4.%' AS v4", "SELECT true AS has_user, true AS main_, true AS v4"),
    Query("k01_net_amount", lambda spark, sf_dir: net_amount(spark, sf_dir), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"),
    Query("k02_margin_pct", "SELECT p_brand, round((avg(p_retailprice) - 900) * 100 / nullif(avg(p_retailprice), 0), 4) AS margin FROM {part} GROUP BY p_brand", "SELECT p_brand, round((avg(p_retailprice) - 900) * 100 / nullif(avg(p_retailprice), 0), 4) AS margin FROM part GROUP BY p_brand"),
    Query("k03_sales_tax", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("tax")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_tax, 4) AS tax FROM lineitem"),
    Query("k04_vectorised_udf", lambda spark, sf_dir: vectorised(spark, sf_dir), "SELECT n_nationkey, CAST(length(n_name) * 2 AS BIGINT) AS n FROM nation"),
    Query("k05_churn_rule", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'gone' WHEN n < 8 THEN 'risk' ELSE 'stays' END AS churn FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) o ON o_custkey = c_custkey", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'gone' WHEN n < 8 THEN 'risk' ELSE 'stays' END AS churn FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey"),
    Query("k06_table_function", lambda spark, sf_dir: squares(spark), "SELECT CAST(n AS INT) AS n, CAST(n * n AS INT) AS square FROM range(1, 6) AS t(n)"),
]


def net_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL scalar function, inlined by the optimizer."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION f_net_amount(price DOUBLE, cut DOUBLE) RETURNS DOUBLE RETURN round(price * (1 - cut), 4)")
    return spark.sql("SELECT l_orderkey, l_linenumber, f_net_amount(l_extendedprice, l_discount) AS net FROM {lines}", lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over Arrow batches, where no built-in one would do."""
    @F.pandas_udf("long")
    def doubled(names: pd.Series) -> pd.Series:
        return names.str.len() * 2

    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", doubled("n_name").alias("n"))


def squares(spark: SparkSession) -> DataFrame:
    """A table function."""

    @F.udtf(returnType="n int, square int")
    class Squares:
        def eval(self, start: int, stop: int):
            for n in range(start, stop + 1):
                yield n, n * n

    return Squares(F.lit(1), F.lit(5))
