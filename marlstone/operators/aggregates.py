"""Aggregation: exact, approximate, conditional, multi-level and two-phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same

#: Registers of the sketches are 2**LG_K; the relative error is then about 1.6 per cent.
LG_K = 12


def daily_sketches(events: DataFrame) -> DataFrame:
    """A mergeable sketch of each day's users."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(LG_K)).alias("users"))


def merged_estimate(sketches: DataFrame, *keys: str) -> DataFrame:
    """Distinct users of several days from their sketches, without the events."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("estimate"))


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts must lie within five standard errors of the exact ones."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    near = lambda a, b: F.abs(a / b - 1) <= 0.1
    return orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.countDistinct("o_custkey").alias("exact")).select("o_orderstatus", "exact", near(F.col("a"), F.col("exact")).alias("close"))


def _sketch_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    exact = events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("exact"))
    both = daily_sketches(events).select("day", F.hll_sketch_estimate("users").alias("guess")).join(exact, "day")
    return both.select(F.col("day").cast("string").alias("day"), "exact", (F.abs(F.col("guess") / F.col("exact") - 1) < 0.1).alias("close"))


def _sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = daily_sketches(events).withColumn("week", F.weekofyear("day"))
    exact = events.groupBy(F.weekofyear("ts").alias("week")).agg(F.countDistinct("user_id").alias("exact"))
    return merged_estimate(week, "week").join(exact, "week").select(F.col("week").cast("long").alias("week"), "exact", (F.abs(F.col("estimate") / F.col("exact") - 1) < 0.1).alias("close"))


_PAY = """SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END)"""

QUERIES = [
    same("a01_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty, min(l_discount) AS lo, max(l_discount) AS hi, round(avg(l_quantity), 4) AS mean FROM {lineitem} GROUP BY l_returnflag, l_linestatus"),
    same("a02_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS top FROM {orders}"),
    same("a03_group_by_ordinal", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1, 2"),
    same("a04_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15"),
    same("a05_duplicates", "SELECT count(*) - count(DISTINCT o_custkey) AS repeats, count(DISTINCT o_orderstatus) AS kinds FROM {orders}"),
    Query("a06_approx_distinct", _approximate, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY 1"),
    Query("a07_sketch_build", _sketch_build, "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1"),
    Query("a08_sketch_merge", _sketch_merge, "SELECT weekofyear(ts) AS week, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1"),
    Query("a09_sketch_error", "SELECT event_type, abs(hll_sketch_estimate(hll_sketch_agg(user_id)) - count(DISTINCT user_id)) * 100.0 / count(DISTINCT user_id) < 5 AS within FROM {events} GROUP BY event_type", "SELECT DISTINCT event_type, true AS within FROM events"),
    same("a10_conditional_pivot", "SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM {lineitem} GROUP BY l_linestatus"),
    same("a11_pivot_by_joins", """WITH a AS (SELECT l_linestatus, count(*) AS a FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_linestatus, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY 1),
          r AS (SELECT l_linestatus, count(*) AS r FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) SELECT a.l_linestatus, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM a LEFT JOIN n ON a.l_linestatus = n.l_linestatus LEFT JOIN r ON a.l_linestatus = r.l_linestatus"""),
    same("a12_rollup", """SELECT coalesce(r_name, 'ALL') AS region_, coalesce(n_name, 'ALL') AS nation_, CAST(grouping(r_name) + grouping(n_name) AS INT) AS level_, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""),
    same("a13_levels_by_union", """WITH x AS (SELECT r_name, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)
          SELECT r_name AS region_, n_name AS nation_, count(*) AS n FROM x GROUP BY r_name, n_name UNION ALL SELECT r_name, 'ALL', count(*) FROM x GROUP BY r_name UNION ALL SELECT 'ALL', 'ALL', count(*) FROM x"""),
    same("a14a_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    same("a14b_grouping_sets", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    same("a15_bool_and_or", "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS all_above, bool_or(c_acctbal > 9990) AS any_rich FROM {customer} GROUP BY c_mktsegment"),
    Query("a16_listagg", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name"),
    same("a17_null_sums", "SELECT sum(x) AS plain, sum(coalesce(x, 0)) AS zeroed, round(avg(x), 4) AS mean, round(avg(coalesce(x, 0)), 4) AS zero_mean FROM (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 END AS x FROM {customer}) AS t"),
    same("a18_count_expr", "SELECT count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS large, count(*) AS n FROM {orders}"),
    same("a19_ratio", "SELECT o_orderpriority, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS share FROM {orders} GROUP BY o_orderpriority"),
    same("a20_window_over_aggregate", "SELECT o_orderstatus, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 4) AS pct FROM {orders} GROUP BY o_orderstatus"),
    Query("a21_aggregate_after_unnest", "SELECT tag, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS tag FROM {part}) GROUP BY tag", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag"),
    Query("a22_checksum", "SELECT count(*) AS n, bit_xor(CAST(conv(substring(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 8), 16, 10) AS BIGINT)) AS sum_ FROM {orders}",
          "SELECT count(*) AS n, bit_xor(CAST(('0x' || substring(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 8)) AS BIGINT)) AS sum_ FROM orders"),
    Query("a23_statistics", "SELECT l_returnflag, median(l_quantity) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, bit_xor(l_orderkey) AS bits, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag",
          "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, bit_xor(l_orderkey) AS bits, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag"),
    same("a24_two_phase", "SELECT event_type, count(*) AS active_pairs, sum(n) AS n FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM {events} GROUP BY 1, 2, 3) t GROUP BY event_type"),
    same("a25_mixed_rows_trap", "SELECT k, max(v) AS v, max(at_) AS at_ FROM (SELECT user_id AS k, event_type AS v, event_id AS at_ FROM {events}) AS t GROUP BY k"),
]
