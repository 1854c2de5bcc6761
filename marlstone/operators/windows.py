"""Window functions: ranking, navigation, frames, shares, islands, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Query, bare, same


def latest_per_key(df: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """One row per key, the first by an order that must break all ties."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def sessions(events: DataFrame, user: str, at: str, gap_seconds: int) -> DataFrame:
    """Numbers each user's sessions: a new one begins after a pause longer than the gap."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return events.withColumn("session", F.sum(F.when(pause > gap_seconds * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_sum(df: DataFrame, order: list[F.Column], value: str, to: str = "running", total: str = "total") -> DataFrame:
    """A running sum over the whole table, and the total, without a single-task window.

    Rows are dealt out by ranges of the order (which must break all ties) and written once, so that the ranges stay
    as they are; sums of the ranges, as many rows as there are partitions, give each its start.
    """
    from ..plans.tables import scratch

    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__start"), F.sum("__sum").over(whole).alias(total))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(starts), "__range").withColumn(to, within + F.col("__start")).drop("__range", "__start")


def _next_after(within: Window, kind: str):
    return {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[kind]().over(within)


def ranked(df: DataFrame, order: list[F.Column], kind: str = "row_number", to: str = "rn", partition_by: list[str] | None = None, tiles: int | None = None) -> DataFrame:
    """ROW_NUMBER, RANK, DENSE_RANK or (with ``tiles``) NTILE over the whole table or over few large partitions, with as
    many tasks as there are ranges rather than one for each partition.

    Rows are dealt out by ranges of partition and order and written once, so that equal rows of the order share a range;
    counts of the ranges give each its start. For ROW_NUMBER and NTILE the order should break all ties.
    """
    from ..plans.tables import scratch

    parts, path = partition_by or [], scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*(F.col(p) for p in parts), *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    own = Window.partitionBy(*parts, "__range").orderBy(*order)
    local = ranged.withColumn("__at", _next_after(own, kind))
    # what each range adds: its rows, or its different values
    sizes = local.groupBy(*parts, "__range").agg((F.max("__at") if kind == "dense_rank" else F.count(F.lit(1))).alias("__n"))
    before = Window.partitionBy(*parts).orderBy("__range")
    whole = Window.partitionBy(*parts)
    starts = sizes.select(*(F.col(p).alias(f"__p{k}") for k, p in enumerate(parts)), F.col("__range").alias("__r"), (F.sum("__n").over(before) - F.col("__n")).alias("__start"), F.sum("__n").over(whole).alias("__all"))
    met = F.col("__range") == F.col("__r")
    for k, p in enumerate(parts):
        met = met & F.col(p).eqNullSafe(F.col(f"__p{k}"))
    place = F.col("__at") + F.col("__start")
    if tiles:
        q, r = F.floor(F.col("__all") / tiles), F.col("__all") % tiles
        place = F.when(place <= r * (q + 1), F.floor((place - 1) / (q + 1)) + 1).otherwise(r + F.floor((place - 1 - r * (q + 1)) / F.greatest(q, F.lit(1))) + 1)
    return local.join(F.broadcast(starts), met).withColumn(to, place.cast("int")).select(*df.columns, to)


def abc_class(value: F.Column, running: F.Column, total: F.Column) -> F.Column:
    """A for what makes the first 80 per cent, B up to 95, C for the rest."""
    return F.when(running - value < total * 0.8, "A").when(running - value < total * 0.95, "B").otherwise("C")


def _pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    found = running_sum(spent, [F.desc("spent"), F.asc("c_custkey")], "spent")
    return found.select("c_custkey", abc_class(F.col("spent"), F.col("running"), F.col("total")).alias("class_"))


def _customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in sequence with running value and tier, and quartiles of all orders of a market segment:
    a segment holds a large share of all rows, so its quartiles go by ranges."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "c_mktsegment")
    tiled = ranked(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], to="quartile", partition_by=["c_mktsegment"], tiles=4)
    mine = Window.partitionBy("o_custkey")
    seq, spent = mine.orderBy("o_orderdate", "o_orderkey"), F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    return tiled.select(
        "o_custkey", "o_orderkey", F.row_number().over(seq).alias("seq"), F.lag("o_orderdate").over(seq).cast("date").cast("string").alias("previous_"),
        spent.over(seq.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("ltv"), "quartile",
        F.when(spent.over(mine) > 2000000, "gold").when(spent.over(mine) > 1000000, "silver").otherwise("basic").alias("tier"),
    )


def _three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey", "c_nationkey")
    for to, parts in (("overall", []), ("in_region", ["n_regionkey"]), ("in_nation", ["c_nationkey"])):
        rows = ranked(rows, [F.desc("c_acctbal")], "rank", to, parts)
    return rows.select("c_custkey", "overall", "in_region", "in_nation")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return latest_per_key(orders, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", 6 * 3600)
    return found.groupBy("user_id").agg(F.max("session").alias("last_session"), F.count("*").alias("n"))


#: Stores by region with a rounded revenue, so that many tie; days of each kind of event; months of orders.
_STORES = """(SELECT r_name AS region_, n_name AS store, CAST(floor(count(*) / 10) * 1000 AS DECIMAL(12,2)) AS revenue FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name) AS t"""
_DAYS = """(SELECT event_type AS store, CAST(extract(day FROM ts) AS INT) AS day_, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS revenue FROM {events} GROUP BY 1, 2) AS t"""
_MONTHS = "(SELECT CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS BIGINT) AS month_, count(CASE WHEN o_orderkey % 40 = 0 THEN 1 END) AS revenue FROM {orders} GROUP BY 1) AS t"


QUERIES = [
    same("w01_row_number", f"SELECT region_, store, row_number() OVER (PARTITION BY region_ ORDER BY revenue DESC, store) AS rn FROM {_STORES}"),
    same("w02_top_one", f"SELECT region_, store FROM (SELECT region_, store, row_number() OVER (PARTITION BY region_ ORDER BY revenue DESC, store) AS rn FROM {_STORES}) x WHERE rn = 1"),
    same("w03_rank", f"SELECT store, rank() OVER (ORDER BY revenue DESC) AS r FROM {_STORES}"),
    same("w04_dense_rank", f"SELECT store, dense_rank() OVER (PARTITION BY region_ ORDER BY revenue DESC) AS r FROM {_STORES}"),
    same("w05_ntile", f"SELECT store, ntile(3) OVER (ORDER BY revenue DESC, store) AS bucket FROM {_STORES}"),
    same("w06_percent_rank", f"SELECT store, round(percent_rank() OVER (ORDER BY revenue DESC), 6) AS p FROM {_STORES}"),
    same("w07_cume_dist", f"SELECT store, round(cume_dist() OVER (ORDER BY revenue DESC), 6) AS c FROM {_STORES}"),
    same("w08_lead", f"SELECT store, day_, CAST(lead(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS next_ FROM {_DAYS}"),
    same("w09_lag", f"SELECT store, day_, CAST(revenue - lag(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS change_, lag(day_, 2, 0) OVER (PARTITION BY store ORDER BY day_) AS back2 FROM {_DAYS}"),
    same("w10_first_value", f"SELECT store, day_, CAST(first_value(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS first_ FROM {_DAYS}"),
    same("w11_last_value", f"""SELECT store, day_, CAST(last_value(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS trap, CAST(last_value(revenue) OVER (PARTITION BY store ORDER BY day_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fixed FROM {_DAYS}"""),
    same("w12_nth_value", f"SELECT store, day_, CAST(nth_value(revenue, 2) OVER (PARTITION BY store ORDER BY day_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS second_ FROM {_DAYS}"),
    same("w13_running_sum", f"SELECT store, day_, CAST(sum(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS running FROM {_DAYS}"),
    same("w14_share_of_total", f"SELECT store, day_, round(CAST(revenue AS DOUBLE) * 100 / CAST(sum(revenue) OVER (PARTITION BY store) AS DOUBLE), 4) AS pct FROM {_DAYS}"),
    same("w15_moving_average", f"SELECT store, day_, round(CAST(avg(CAST(revenue AS DOUBLE)) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE), 6) AS running, round(avg(CAST(revenue AS DOUBLE)) OVER (PARTITION BY store ORDER BY day_ ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM {_DAYS}"),
    same("w16_count_over", f"SELECT store, day_, count(*) OVER (PARTITION BY store ORDER BY day_) AS so_far, count(*) OVER (PARTITION BY store) AS total FROM {_DAYS}"),
    same("w17_running_extremes", f"SELECT store, day_, CAST(min(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS low, CAST(max(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS high, CAST(max(revenue) OVER () AS DOUBLE) AS top FROM {_DAYS}"),
    same("w18_combined", f"SELECT store, day_, rank() OVER (PARTITION BY store ORDER BY revenue DESC) AS r, CAST(lag(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS before_, CAST(sum(revenue) OVER (PARTITION BY store ORDER BY day_) AS DOUBLE) AS running FROM {_DAYS}"),
    same("w19_top_n_with_ties", f"WITH r AS (SELECT region_, store, dense_rank() OVER (PARTITION BY region_ ORDER BY revenue DESC) AS dr FROM {_STORES}) SELECT region_, store, dr FROM r WHERE dr <= 2"),
    Query("w20_growth_percent", f"SELECT month_, (revenue - lag(revenue) OVER w) * 100 DIV nullif(lag(revenue) OVER w, 0) AS whole, round((revenue - lag(revenue) OVER w) * 100.0D / nullif(lag(revenue) OVER w, 0), 4) AS exact FROM {_MONTHS} WINDOW w AS (ORDER BY month_)",
          bare(f"SELECT month_, CAST(trunc((revenue - lag(revenue) OVER w) * 100 / nullif(lag(revenue) OVER w, 0)) AS BIGINT) AS whole, round(CAST((revenue - lag(revenue) OVER w) * 100 AS DOUBLE) / nullif(lag(revenue) OVER w, 0), 4) AS exact FROM {_MONTHS} WINDOW w AS (ORDER BY month_)")),
    same("w21_trailing_seven", "SELECT d, n, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS trailing FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS d, count(*) AS n FROM {events} GROUP BY 1) t"),
    same("w22_centred", "SELECT d, n, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS centred FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS d, count(*) AS n FROM {events} GROUP BY 1) t"),
    same("w23_rows_and_range", f"SELECT region_, store, CAST(sum(revenue) OVER (ORDER BY revenue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS by_range, CAST(sum(revenue) OVER (ORDER BY revenue, store ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS by_rows FROM {_STORES}"),
    same("w24_gaps_and_islands", f"SELECT store, min(day_) AS first_, max(day_) AS last_, count(*) AS streak FROM (SELECT store, day_, day_ - row_number() OVER (PARTITION BY store ORDER BY day_) AS island FROM {_DAYS}) x GROUP BY store, island"),
    same("w25_named_window", f"SELECT store, day_, CAST(sum(revenue) OVER w AS DOUBLE) AS s, CAST(max(revenue) OVER w AS DOUBLE) AS m FROM {_DAYS} WINDOW w AS (PARTITION BY store ORDER BY day_)"),
    same("w26_top_tenth", f"SELECT store, percent_rank() OVER (ORDER BY revenue) >= 0.9 AS top_rank, cume_dist() OVER (ORDER BY revenue) > 0.9 AS top_dist FROM {_STORES}"),
    Query("w27_event_analytics", """SELECT event_id, coalesce(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER w AS TIMESTAMP)), -1) AS gap_us, lead(event_type) OVER w AS next_type, row_number() OVER w = 1 AS first_of_day, event_type = last(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS as_last
          FROM {events} WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)""",
          """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), -1) AS gap_us, lead(event_type) OVER w AS next_type, row_number() OVER w = 1 AS first_of_day, event_type = last(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS as_last
          FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)"""),
    same("w28_daily_ranks", """SELECT o_orderkey, row_number() OVER w AS seq, rank() OVER d AS r, dense_rank() OVER d AS dr, ntile(10) OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS decile, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3
          FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), d AS (PARTITION BY o_orderdate ORDER BY o_totalprice DESC)"""),
    Query("w29_customer_metrics", _customer_metrics, bare("""SELECT o_custkey, o_orderkey, row_number() OVER w AS seq, CAST(CAST(lag(o_orderdate) OVER w AS DATE) AS STRING) AS previous_, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS ltv,
          ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS quartile, CASE WHEN sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) > 2000000 THEN 'gold' WHEN sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) > 1000000 THEN 'silver' ELSE 'basic' END AS tier
          FROM {orders} JOIN {customer} ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")),
    same("w30_dense_activity", "SELECT user_id, d, sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS active7 FROM (SELECT user_id, datediff_days AS d, count(*) AS n FROM (SELECT user_id, CAST(extract(day FROM ts) AS INT) AS datediff_days FROM {events}) e GROUP BY 1, 2) t"),
    Query("w31_latest_per_key", _latest, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"),
    same("w32_trend_flag", f"SELECT store, day_, CASE WHEN revenue > avg(revenue) OVER (PARTITION BY store ORDER BY day_ ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) THEN 'above' ELSE 'not above' END AS trend FROM {_DAYS}"),
    same("w33_lag_many", "SELECT m, n, lag(n, 1) OVER (ORDER BY m) AS last_month, lag(n, 12) OVER (ORDER BY m) AS last_year FROM (SELECT CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS BIGINT) AS m, count(*) AS n FROM {orders} GROUP BY 1) t"),
    Query("w34_pareto", _pareto, """SELECT c_custkey, CASE WHEN running - spent < 0.8 * total THEN 'A' WHEN running - spent < 0.95 * total THEN 'B' ELSE 'C' END AS class_ FROM (SELECT o_custkey AS c_custkey, spent, sum(spent) OVER (ORDER BY spent DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, sum(spent) OVER () AS total
          FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY o_custkey) a) b"""),
    Query("w35_ranks_at_three_levels", _three_levels, bare("""SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS overall, rank() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC) AS in_region, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS in_nation FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")),
    same("w36_total_over", "SELECT n_name, count(*) AS n, sum(count(*)) OVER () AS total FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_name"),
    same("w37_ratio_to_least", f"SELECT store, day_, round(CAST(revenue AS DOUBLE) / CAST(min(revenue) OVER () AS DOUBLE), 4) AS ratio FROM {_DAYS}"),
    Query("w38_top_of_nested", "SELECT id, item, rn FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY item DESC) AS rn FROM VALUES (1, array(3, 9, 4)), (2, array(1)) AS t(id, items) LATERAL VIEW explode(items) x AS item) WHERE rn <= 2",
          "SELECT id, item, rn FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY item DESC) AS rn FROM (SELECT id, unnest(items) AS item FROM (VALUES (1, [3, 9, 4]), (2, [1])) AS t(id, items))) WHERE rn <= 2"),
    Query("w39_sessions", _sessions, """SELECT user_id, max(s) AS last_session, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id"""),
    Query("w40_statistics_over", f"SELECT store, day_, CAST(median(revenue) OVER (PARTITION BY store) AS DOUBLE) AS med, round(CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY store) AS DOUBLE), 6) AS ratio FROM {_DAYS}",
          bare(f"SELECT store, day_, CAST(median(CAST(revenue AS DOUBLE)) OVER (PARTITION BY store) AS DOUBLE) AS med, round(CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY store) AS DOUBLE), 6) AS ratio FROM {_DAYS}")),
]
