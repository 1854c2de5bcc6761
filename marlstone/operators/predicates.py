"""Projections, filters and predicates, with the traps their NULL rules set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same


def sargable(df: DataFrame, column: str, day: str, days: int = 1) -> DataFrame:
    """Rows of ``days`` days from one on, as a half-open range on the bare column, which reaches the scan."""
    begin = F.lit(day).cast("timestamp_ntz")
    return df.filter((F.col(column) >= begin) & (F.col(column) < begin + F.expr(f"INTERVAL {int(days)} DAYS")))


def split_valid(df: DataFrame, required: list[str], condition: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns (and the condition), and all others. The test never yields NULL, so no row is lost."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()
    if condition is not None:
        good = good & F.coalesce(condition, F.lit(False))
    return df.filter(good), df.filter(~good)


def _sargable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sargable(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", "1996-03-01", 31)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("amount", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")))
    good, bad = split_valid(orders, ["o_custkey", "amount"], F.col("o_orderstatus") != "P")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    return count(good, "valid").unionByName(count(bad, "invalid"))


_PEOPLE = """(SELECT c_custkey AS id, CASE WHEN c_acctbal > 7000 THEN 'gold' WHEN c_acctbal > 2000 THEN 'silver' END AS tier, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS spend, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS second, CASE WHEN c_custkey % 6 = 0 THEN c_name END AS first_mail FROM {customer}) AS t"""


QUERIES = [
    Query("p22_nested_filter", "SELECT event_type, count(*) AS n FROM {events} WHERE try_variant_get(try_parse_json(props), '$.k', 'int') >= 50 GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50 GROUP BY event_type"),
    same("p01_projection_alias", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM {customer}"),
    same("p02_computed_measure", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS measure FROM {lineitem}"),
    Query("p03_casts", "SELECT CAST('12.50' AS DECIMAL(8,2)) + 0 = 12.5 AS dec_ok, try_cast('x1' AS INT) AS bad_int, try_cast('2024-02-30' AS DATE) IS NULL AS bad_date, CAST(3.7 AS INT) AS cut, CAST(true AS INT) AS one",
          "SELECT CAST('12.50' AS DECIMAL(8,2)) + 0 = 12.5 AS dec_ok, try_cast('x1' AS INT) AS bad_int, try_cast('2024-02-30' AS DATE) IS NULL AS bad_date, CAST(trunc(3.7) AS INT) AS cut, CAST(true AS INT) AS one"),
    Query("p04_half_open_range", _sargable, "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_returnflag"),
    same("p05_wrapped_predicate", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {lineitem} WHERE date_trunc('month', l_shipdate) = TIMESTAMP '1996-03-01 00:00:00' GROUP BY l_returnflag"),
    same("p06_between", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'"),
    same("p07_in_list", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('1-URGENT') GROUP BY o_orderstatus"),
    same("p08_in_subquery", "SELECT count(*) AS n FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')"),
    same("p09_not_in_with_null", "SELECT count(*) AS n FROM {customer} WHERE c_nationkey NOT IN (SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey END FROM {nation})"),
    same("p10_not_exists", "SELECT count(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)"),
    same("p11_like", "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%BRASS' OR p_name ILIKE '%GREEN%' OR p_brand NOT LIKE 'Brand#%'"),
    Query("p12_regex_match", "SELECT p_brand, count(*) AS n FROM {part} WHERE p_brand RLIKE '^Brand#[1-3]' GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]') GROUP BY p_brand"),
    same("p13_is_null", f"SELECT sum(CASE WHEN tier IS NULL THEN 1 ELSE 0 END) AS no_tier, sum(CASE WHEN spend IS NOT NULL THEN 1 ELSE 0 END) AS has_spend FROM {_PEOPLE}"),
    same("p14_distinct_from", f"SELECT id, tier IS DISTINCT FROM 'gold' AS other_tier, second IS NOT DISTINCT FROM first_mail AS same_mail FROM {_PEOPLE}"),
    same("p15_case", f"SELECT id, CASE WHEN spend >= 1000 THEN 'high' WHEN spend > 0 THEN 'some' ELSE 'none' END AS band, CASE tier WHEN 'gold' THEN 1 WHEN 'silver' THEN 2 ELSE 9 END AS rank_ FROM {_PEOPLE}"),
    Query("p16_guarded_division", "SELECT l_linenumber % 3 AS d, count(*) AS n, sum(CASE WHEN try_divide(100, l_linenumber % 3) < 60 THEN 1 ELSE 0 END) AS small FROM {lineitem} GROUP BY 1",
          "SELECT l_linenumber % 3 AS d, count(*) AS n, sum(CASE WHEN 100.0 / nullif(l_linenumber % 3, 0) < 60 THEN 1 ELSE 0 END) AS small FROM lineitem GROUP BY 1"),
    Query("p17_valid_invalid_split", _split, """SELECT CASE WHEN o_totalprice > 1000 AND o_orderstatus <> 'P' THEN 'valid' ELSE 'invalid' END AS part, count(*) AS n, count(DISTINCT o_orderkey) AS keys
          FROM orders GROUP BY 1"""),
    same("p18_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}"),
    same("p19_scalar_subquery", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})"),
    same("p20_correlated_to_join", """WITH pre AS (SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS last_line FROM {lineitem} GROUP BY l_orderkey)
          SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, last_line FROM {orders} LEFT JOIN pre ON o_orderkey = l_orderkey"""),
    Query("p21_explain", lambda spark, sf_dir: spark.createDataFrame([("PushedFilters" in _plan(spark, sf_dir), "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in _plan(spark, sf_dir))], "pushed boolean, pruned boolean"), "SELECT true AS pushed, true AS pruned"),
    same("p23_derived_table", "SELECT upper_name, length(upper_name) AS n FROM (SELECT upper(n_name) AS upper_name FROM {nation}) t"),
]


def _plan(spark: SparkSession, sf_dir: str) -> str:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice")
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
