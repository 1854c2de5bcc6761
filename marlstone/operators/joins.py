"""Joins: equi, range, interval, point-in-time, fan-out and its cures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Query, same
from ..plans.tables import scratch

#: A side of at most so many rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sized_broadcast(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side, marked for broadcast only after its rows were found to be few."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def bucketed_range_join(facts: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """facts.value between bands.low and bands.high as an equi-join on buckets of a width, then a filter.

    A band is repeated for each bucket that it touches; a width near the usual band keeps that to one or two.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = bands.withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return facts.withColumn("__bucket", bucket(value)).join(spread, "__bucket").filter(F.col(value).between(F.col(low), F.col(high))).drop("__bucket")


def overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows whose interval meets another's of the same key: each row looks at the latest end before it, not at all pairs."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy(start, end).rowsBetween(1, 1)
    meets = F.coalesce(F.max(end).over(w) > F.col(start), F.lit(False)) | F.coalesce(F.min(start).over(ahead) < F.col(end), F.lit(False))
    return df.withColumn("__meets", meets).filter("__meets").drop("__meets")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time: one sort of the union instead of a range join."""
    both = left.select(key, F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    other = right.select(key, F.col(right_time).alias("__t"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").select("__row.*", F.col("__v").alias(value))


def _broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return customer.join(sized_broadcast(nation), customer.c_nationkey == nation.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return orders.hint("merge").join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("low", 900.0, 929.99), ("mid", 930.0, 969.99), ("high", 970.0, 999.99)], "band string, lo double, hi double")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return bucketed_range_join(part, bands, "p_retailprice", "lo", "hi", 40.0).groupBy("band").agg(F.count("*").alias("n"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose spans of account meet another's."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS id", "s_nationkey AS room", "CAST(floor(s_acctbal) AS INT) AS s", "CAST(floor(s_acctbal) AS INT) + 50 + CAST(s_suppkey % 300 AS INT) AS e")
    return overlaps(rows, "room", "s", "e").select("id")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    buys = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = events.filter("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return as_of(buys, views, "user_id", "ts", "ts", "last_event").select("event_id", "last_event")


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows, stored in buckets of the keys: joins and groupings by them need no exchange, however often they run."""
    name = f"marlstone_bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch(df.sparkSession, "bucketed")).saveAsTable(name)
    found = df.sparkSession.table(name)
    found.schema  # resolved, with its buckets, before the name goes; the files stay
    df.sparkSession.sql(f"DROP TABLE {name}")
    return found


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables stored in buckets of the join key: neither the join nor the grouping by that key moves a row."""
    orders = bucketed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], 16)
    spent = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    return orders.join(spent, "o_custkey").filter(F.col("o_totalprice") > F.col("spent") * 0.5).select("o_orderkey", "o_custkey")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one nation, counted from its size: the pairs themselves would be quadratic."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("n"))


#: Segments of customers that changed at a date of their own, some of them known from a later date on only; and orders.
_TEMPORAL = """(SELECT c_custkey AS k, c_mktsegment AS v, DATE '1990-01-01' AS valid_from, CAST('1996-01-31' AS DATE) AS valid_to FROM {customer} WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 'moved', CASE WHEN c_custkey % 3 = 0 THEN DATE '1996-02-01' ELSE DATE '1998-05-01' END, DATE '9999-12-31' FROM {customer} WHERE c_custkey % 5 > 0) AS d"""
_FACTS = "(SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS day_ FROM {orders}) AS f"


QUERIES = [
    same("j01_inner_join", "SELECT o_orderstatus, count(*) AS n FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderstatus"),
    Query("j02_colocated_join", _bucketed, "SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1) USING (o_custkey) WHERE o_totalprice > spent * 0.5"),
    Query("j03_merge_join", _merge, "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus"),
    Query("j04_broadcast_join", _broadcast, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    same("j05_left_join_default", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey"),
    same("j06_left_join_is_null", "SELECT count(*) AS orphans FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_orderkey IS NULL"),
    same("j07_semi_join", "SELECT count(*) AS n FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    same("j08_anti_join", "SELECT count(*) AS n FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 49)"),
    same("j09_using_join", "SELECT k, count(*) AS n FROM (SELECT n_nationkey AS k FROM {nation}) a JOIN (SELECT c_nationkey AS k FROM {customer}) b USING (k) GROUP BY k"),
    Query("j10_self_join", _pairs, "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    same("j10_manager_join", "SELECT a.l_orderkey, a.l_linenumber FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 AND a.l_extendedprice > b.l_extendedprice"),
    same("j11_change_compare", """SELECT a.o_orderkey FROM {orders} a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM {orders}) b ON a.o_orderkey = b.o_orderkey
          WHERE md5(concat(CAST(a.o_orderkey AS STRING), '|', a.o_orderstatus)) <> md5(concat(CAST(b.o_orderkey AS STRING), '|', b.s))"""),
    same("j12_cross_join", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}"),
    Query("j13_range_join", _bands, "SELECT band, count(*) AS n FROM part JOIN (VALUES ('low', 900.0, 929.99), ('mid', 930.0, 969.99), ('high', 970.0, 999.99)) AS b(band, lo, hi) ON p_retailprice BETWEEN lo AND hi GROUP BY band"),
    same("j14_equi_and_range", "SELECT count(*) AS n FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '60' DAY"),
    same("j15_or_join", "SELECT count(*) AS n FROM {nation} a JOIN {nation} b ON a.n_nationkey = b.n_regionkey OR a.n_regionkey = b.n_nationkey"),
    same("j16_or_as_union", """SELECT count(*) AS n FROM (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey = b.n_regionkey
          UNION SELECT a.n_nationkey, b.n_nationkey FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_nationkey) t"""),
    Query("j17_interval_overlap", _intervals, """WITH t AS (SELECT s_suppkey AS id, s_nationkey AS room, floor(s_acctbal) AS s, floor(s_acctbal) + 50 + s_suppkey % 300 AS e FROM supplier)
          SELECT DISTINCT x.id FROM t x JOIN t y ON x.room = y.room AND x.id <> y.id AND x.s < y.e AND x.e > y.s"""),
    same("j18_point_in_time", f"SELECT id, coalesce(v, 'unknown') AS v FROM {_FACTS} LEFT JOIN {_TEMPORAL} ON f.k = d.k AND f.day_ BETWEEN d.valid_from AND d.valid_to"),
    same("j19_point_lookup", f"SELECT k, v FROM {_TEMPORAL} WHERE DATE '1997-05-01' BETWEEN valid_from AND valid_to"),
    same("j20_date_band", "SELECT o_orderkey, count(*) AS n FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL '30' DAY GROUP BY o_orderkey"),
    same("j21_left_join_predicate", "SELECT n_name, count(c_custkey) AS rich FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY n_name"),
    same("j22a_fan_out", "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS inflated FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"),
    same("j22b_grain_aligned", """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, sum(n) AS lines_ FROM {orders} JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"""),
    same("j23_duplicate_dimension", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders_ FROM {orders} JOIN (SELECT c_custkey FROM {customer} UNION ALL SELECT c_custkey FROM {customer} WHERE c_custkey % 10 = 0) d ON o_custkey = c_custkey"),
    same("j24_filter_before_join", """SELECT c_mktsegment, count(*) AS n FROM (SELECT o_custkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00') o JOIN (SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_acctbal > 0) c ON o_custkey = c_custkey GROUP BY c_mktsegment"""),
    same("j25_aggregate_before_join", "SELECT c_mktsegment, sum(n) AS n FROM {customer} JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    same("j26_star_join", """SELECT r_name, p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
          JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {part} ON l_partkey = p_partkey GROUP BY r_name, p_brand"""),
    Query("j27_dense_grid", """WITH spine AS (SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS d), u AS (SELECT DISTINCT user_id FROM {events}),
          seen AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM {events} GROUP BY 1, 2)
          SELECT u.user_id, CAST(spine.d AS STRING) AS d, coalesce(n, 0) AS n FROM spine CROSS JOIN u LEFT JOIN seen ON seen.user_id = u.user_id AND seen.d = spine.d""",
          """WITH spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d), u AS (SELECT DISTINCT user_id FROM events),
          seen AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)
          SELECT u.user_id, CAST(spine.d AS STRING) AS d, coalesce(n, 0) AS n FROM spine CROSS JOIN u LEFT JOIN seen ON seen.user_id = u.user_id AND seen.d = spine.d"""),
    Query("j28_lateral_unnest", "SELECT o_custkey, item FROM (SELECT o_custkey, array_distinct(collect_list(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END)) AS items FROM {orders} GROUP BY o_custkey) LATERAL VIEW explode(items) x AS item",
          "SELECT o_custkey, unnest(items) AS item FROM (SELECT o_custkey, list_distinct(list(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END)) AS items FROM orders GROUP BY o_custkey)"),
    Query("j29_two_unnests", "SELECT DISTINCT o_custkey FROM (SELECT o_custkey, collect_list(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS a, collect_list(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS b FROM {orders} GROUP BY o_custkey) WHERE arrays_overlap(a, b)",
          "SELECT DISTINCT o_custkey FROM (SELECT o_custkey, p, unnest(b) AS q FROM (SELECT o_custkey, b, unnest(a) AS p FROM (SELECT o_custkey, list(o_orderpriority) FILTER (o_orderstatus = 'F') AS a, list(o_orderpriority) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey))) WHERE p = q"),
    same("j31_right_and_full", """SELECT 'right' AS kind, count(*) AS n, count(o_orderkey) AS matched FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey
          UNION ALL SELECT 'full', count(*), count(o_orderkey) FROM (SELECT * FROM {orders} WHERE o_custkey % 2 = 0) o FULL JOIN {customer} ON o_custkey = c_custkey"""),
    Query("j32_as_of", _as_of, """SELECT event_id, (SELECT max(v.event_id) FROM events v WHERE v.event_type <> 'purchase' AND v.user_id = b.user_id AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.event_type <> 'purchase' AND w.user_id = b.user_id AND w.ts <= b.ts)) AS last_event
          FROM events b WHERE event_type = 'purchase'"""),
]
