"""Business questions of a retail model: lines are sales, parts are items, brands are departments, suppliers deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, bare, run_sql, same
from ..operators.windows import abc_class, ranked, running_sum

_SALES = """SELECT l_partkey AS item, p_brand AS department, l_suppkey AS supplier, CAST(extract(year FROM l_shipdate) * 12 + extract(month FROM l_shipdate) AS BIGINT) AS month_, CAST(l_quantity AS DECIMAL(12,2)) AS qty,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, l_discount, l_returnflag, l_shipdate, o_orderdate, c_nationkey AS store FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""
_BY_MONTH = f"SELECT department, month_, sum(revenue) AS revenue, sum(qty) AS qty FROM ({_SALES}) s GROUP BY department, month_"



def _abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = run_sql(spark, sf_dir, f"SELECT item, sum(revenue) AS revenue FROM ({_SALES}) s GROUP BY item")
    classes = running_sum(items, [F.desc("revenue"), F.asc("item")], "revenue").groupBy(abc_class(F.col("revenue"), F.col("running"), F.col("total")).alias("class_")).agg(F.count("*").alias("items"))
    whole = classes.agg(F.sum("items").alias("all_items"))
    return classes.join(F.broadcast(whole)).select("class_", "items", F.round(F.col("items") * 100.0 / F.col("all_items"), 4).cast("double").alias("pct"))


def _lost_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by what came back; there are as many as parts, so ranks go by ranges."""
    lost = run_sql(spark, sf_dir, f"SELECT item, sum(qty) AS lost FROM ({_SALES}) s WHERE l_returnflag = 'R' GROUP BY item")
    return ranked(lost, [F.desc("lost")], "dense_rank", "r").select("item", "r")


QUERIES = [
    same("e25_top_items_per_department", f"SELECT department, item, r FROM (SELECT department, item, dense_rank() OVER (PARTITION BY department ORDER BY sum(revenue) DESC) AS r FROM ({_SALES}) s GROUP BY department, item) t WHERE r <= 10"),
    same("e26_comparable_sales", f"""SELECT department, month_, before_, last_year FROM (SELECT department, month_, CAST(lag(revenue, 1) OVER w AS DOUBLE) AS before_, CAST(lag(revenue, 12) OVER w AS DOUBLE) AS last_year FROM ({_BY_MONTH}) m WINDOW w AS (PARTITION BY department ORDER BY month_)) t WHERE month_ >= 1998 * 12"""),
    same("e27_sell_through", f"SELECT department, round(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE qty END) AS DOUBLE) * 100 / CAST(nullif(sum(qty), 0) AS DOUBLE), 4) AS sold_pct FROM ({_SALES}) s GROUP BY department"),
    same("e28_moving_trend", f"""SELECT department, month_, CASE WHEN revenue > avg4 THEN 'UP' WHEN revenue < avg4 THEN 'DOWN' ELSE 'FLAT' END AS trend FROM (SELECT department, month_, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER w AS DOUBLE) / count(*) OVER w AS avg4 FROM ({_BY_MONTH}) m WINDOW w AS (PARTITION BY department ORDER BY month_ ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) t"""),
    Query("e29_abc_classes", _abc, bare(f"""SELECT class_, count(*) AS items, round(CAST(count(*) AS DOUBLE) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM (SELECT item, CASE WHEN running - revenue < 0.8 * total THEN 'A' WHEN running - revenue < 0.95 * total THEN 'B' ELSE 'C' END AS class_
          FROM (SELECT item, revenue, sum(revenue) OVER (ORDER BY revenue DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, sum(revenue) OVER () AS total FROM (SELECT item, sum(revenue) AS revenue FROM ({_SALES}) s GROUP BY item) a) b) c GROUP BY class_""")),
    same("e30_margin_gap", f"SELECT department, rank() OVER (ORDER BY lost DESC) AS r FROM (SELECT department, sum(revenue * CAST(l_discount AS DECIMAL(4,2))) AS lost FROM ({_SALES}) s GROUP BY department) t"),
    same("e31_store_leaderboard", f"SELECT store, rank() OVER (ORDER BY revenue DESC) AS overall, rank() OVER (PARTITION BY n_regionkey ORDER BY revenue DESC) AS in_region FROM (SELECT store, sum(revenue) AS revenue FROM ({_SALES}) s GROUP BY store) t JOIN {{nation}} ON n_nationkey = store".replace("{{nation}}", "{nation}")),
    Query("e32_lost_sales", _lost_sales, bare(f"SELECT item, dense_rank() OVER (ORDER BY lost DESC) AS r FROM (SELECT item, sum(qty) AS lost FROM ({_SALES}) s WHERE l_returnflag = 'R' GROUP BY item) t")),
    same("e33_supplier_on_time", f"SELECT supplier, round(CAST(sum(CASE WHEN l_shipdate < o_orderdate + INTERVAL '60' DAY THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 4) AS on_time FROM ({_SALES}) s GROUP BY supplier"),
    same("e34_promotion_uplift", f"""SELECT department, round(CAST(sum(CASE WHEN l_discount >= 0.05 THEN qty END) AS DOUBLE) / nullif(count(CASE WHEN l_discount >= 0.05 THEN 1 END), 0) - CAST(sum(CASE WHEN l_discount < 0.05 THEN qty END) AS DOUBLE) / nullif(count(CASE WHEN l_discount < 0.05 THEN 1 END), 0), 4) AS uplift FROM ({_SALES}) s GROUP BY department"""),
    same("e35_monthly_health", f"SELECT department, month_, CASE WHEN revenue IS NULL THEN 'NO TRADE' WHEN revenue > 1.1 * before_ THEN 'GROWING' WHEN revenue < 0.9 * before_ THEN 'FALLING' ELSE 'STEADY' END AS band FROM (SELECT department, month_, revenue, lag(revenue) OVER (PARTITION BY department ORDER BY month_) AS before_ FROM ({_BY_MONTH}) m) t"),
    same("e38_cost_by_tag", "SELECT tag, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority LIKE '%-%' THEN split_part(o_orderpriority, '-', 2) ELSE 'none' END AS tag FROM {orders}) t GROUP BY tag"),
]
