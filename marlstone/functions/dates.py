"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query
from . import dialect

_ROWS = [(1, "2024-02-29 23:59:58", "2024-03-03 05:15:00"), (2, "2023-12-31 10:00:00", "2024-01-01 09:00:00"), (3, "2024-05-10 00:00:00", "2024-05-31 12:30:00")]
#: Every order's time, shifted within its day, and one some hours later; and days at which calendars go wrong.
_VALUES = "(SELECT o_orderkey AS id, o_orderdate + to_seconds(o_custkey * 97 % 86400) AS a, o_orderdate + to_seconds(o_custkey * 97 % 86400) + to_hours(o_orderkey % 2000) AS b FROM orders UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, a, b in _ROWS) + ") AS v(id, a, b)) AS t"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([(-i, a, b) for i, a, b in _ROWS], "id long, a string, b string").select("id", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    a = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_custkey * 97 % 86400)")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), a.alias("a"), (a + F.expr("make_dt_interval(0, CAST(o_orderkey % 2000 AS INT))")).alias("b")).unionByName(edges)


def _made(**columns):
    """A query of the rows: column name -> (Spark column of (a, b), DuckDB text)."""
    run = lambda spark, sf_dir: _rows(spark, sf_dir).select("id", *(f(F.col("a"), F.col("b")).alias(n) for n, (f, _) in columns.items()))
    return run, f"SELECT id, {', '.join(f'{text} AS {n}' for n, (_, text) in columns.items())} FROM {_VALUES}"


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select((F.current_date() == F.to_date(F.current_timestamp())).alias("same_day"), (F.now() == F.current_timestamp()).alias("fixed"))


_text = lambda c: c.cast("string")

QUERIES = [
    Query("f01_clock", _clock, "SELECT true AS same_day, true AS fixed"),
    Query("f02_dateadd", *_made(plus_day=(lambda a, b: _text(dialect.dateadd("day", 3, F.to_date(a))), "CAST(CAST(a AS DATE) + 3 AS STRING)"), plus_month=(lambda a, b: _text(dialect.dateadd("month", 1, F.to_date(a))), "CAST(CAST(CAST(a AS DATE) + INTERVAL 1 MONTH AS DATE) AS STRING)"))),
    Query("f03_datediff", *_made(**{p: (lambda a, b, p=p: dialect.datediff(p, a, b), f"date_diff('{p}', a, b)") for p in ("year", "quarter", "month", "day", "hour", "minute")})),
    Query("f03_weeks", *_made(weeks=(lambda a, b: dialect.datediff("week", a, b), "CAST(floor((date_diff('day', DATE '1970-01-01', CAST(b AS DATE)) + 4) / 7) - floor((date_diff('day', DATE '1970-01-01', CAST(a AS DATE)) + 4) / 7) AS BIGINT)"))),
    Query("f04_date_trunc", *_made(**{p: (lambda a, b, p=p: F.date_format(F.date_trunc(p, a), "yyyy-MM-dd HH:mm"), f"strftime(date_trunc('{p}', a), '%Y-%m-%d %H:%M')") for p in ("year", "quarter", "month", "week", "day", "hour")})),
    Query("f05_extract", *_made(**{p: (lambda a, b, p=p: F.extract(F.lit(p), a).cast("long"), f"CAST(extract({p} FROM a) AS BIGINT)") for p in ("year", "quarter", "month", "week", "day", "hour", "minute")}, dow=(lambda a, b: (F.dayofweek(a) - 1).cast("long"), "CAST(extract(dow FROM a) AS BIGINT)"), epoch=(lambda a, b: F.unix_seconds(a.cast("timestamp")), "CAST(epoch(a) AS BIGINT)"))),
    Query("f06_to_char", *_made(full_=(lambda a, b: dialect.to_char(a, "YYYY-MM-DD HH24:MI:SS"), "strftime(a, '%Y-%m-%d %H:%M:%S')"), month_=(lambda a, b: dialect.to_char(a, "Month"), "strftime(a, '%B')"), day_=(lambda a, b: dialect.to_char(a, "Day"), "strftime(a, '%A')"))),
    Query("f07_to_date", "SELECT o_orderkey, CAST(to_date(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS STRING) AS d FROM {orders}", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders"),
    Query("f08_to_timestamp", "SELECT event_id, date_format(to_timestamp(date_format(ts, 'dd.MM.yyyy HH-mm-ss.SSS'), 'dd.MM.yyyy HH-mm-ss.SSS'), 'yyyy-MM-dd HH:mm:ss.SSS') AS t FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS t FROM events"),
    Query("f09_convert_timezone", "SELECT event_id, date_format(convert_timezone('UTC', 'America/New_York', ts), 'yyyy-MM-dd HH:mm') AS winter, date_format(convert_timezone('UTC', 'America/New_York', ts + INTERVAL 180 DAYS), 'yyyy-MM-dd HH:mm') AS summer FROM {events}",
          "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS winter, strftime(ts + INTERVAL 180 DAY - INTERVAL 4 HOUR, '%Y-%m-%d %H:%M') AS summer FROM events"),
    Query("f10_last_day", *_made(last_=(lambda a, b: _text(F.last_day(a)), "CAST(last_day(a) AS STRING)"))),
    Query("f11_add_months", *_made(end_=(lambda a, b: _text(dialect.add_months_end(F.to_date(a), 1)), "CAST(CASE WHEN last_day(a) = CAST(a AS DATE) THEN last_day(CAST(a AS DATE) + INTERVAL 1 MONTH) ELSE CAST(CAST(a AS DATE) + INTERVAL 1 MONTH AS DATE) END AS STRING)"))),
    Query("f12_months_between", *_made(months=(lambda a, b: F.round(F.months_between(F.to_date(b), F.to_date(a)), 6), "round(CASE WHEN day(a) = day(b) OR last_day(a) = CAST(a AS DATE) AND last_day(b) = CAST(b AS DATE) THEN (year(b) - year(a)) * 12 + month(b) - month(a) ELSE (year(b) - year(a)) * 12 + month(b) - month(a) + CAST(day(b) - day(a) AS DOUBLE) / 31 END, 6)"))),
    Query("f13_next_day", *_made(monday=(lambda a, b: _text(F.next_day(F.to_date(a), "Mon")), "CAST(CAST(a AS DATE) + (8 - isodow(a))::INT AS STRING)"))),
    Query("f14_trunc", *_made(day_=(lambda a, b: _text(F.to_date(a)), "CAST(CAST(a AS DATE) AS STRING)"))),
    Query("f15_fiscal", *_made(year_=(lambda a, b: F.when(F.month(a) >= 2, F.year(a)).otherwise(F.year(a) - 1).cast("long"), "CASE WHEN month(a) >= 2 THEN year(a) ELSE year(a) - 1 END"), quarter_=(lambda a, b: (F.floor(F.pmod(F.month(a) - 2, F.lit(12)) / 3) + 1).cast("long"), "CAST((month(a) - 2 + 12) % 12 // 3 + 1 AS BIGINT)"))),
    Query("f16_business_days", *_made(n=(lambda a, b: dialect.business_days(F.next_day(F.to_date(a), "Mon"), F.date_add(F.next_day(F.to_date(a), "Mon"), F.pmod(F.dayofyear(b), F.lit(12)) * 7 + 3)),
          "(SELECT count(*) FROM generate_series(CAST(a AS DATE) + (8 - isodow(a))::INT, CAST(a AS DATE) + (8 - isodow(a))::INT + (dayofyear(b) % 12 * 7 + 2)::INT, INTERVAL 1 DAY) AS g(d) WHERE isodow(d) < 6)"))),
    Query("f17_bucket", *_made(start_=(lambda a, b: F.date_format(dialect.bucket_start(a, 900), "yyyy-MM-dd HH:mm"), "strftime(time_bucket(INTERVAL 15 MINUTE, a), '%Y-%m-%d %H:%M')"))),
    Query("f18_age", *_made(years=(lambda a, b: dialect.datediff("year", a, b), "date_diff('year', a, b)"))),
    Query("f19_iso_week", *_made(week_=(lambda a, b: F.weekofyear(a).cast("long"), "weekofyear(a)"))),
    Query("f20_overlap", *_made(meets=(lambda a, b: (a < F.lit("2024-03-01").cast("timestamp_ntz")) & (b > F.lit("2024-02-01").cast("timestamp_ntz")), "a < TIMESTAMP '2024-03-01' AND b > TIMESTAMP '2024-02-01'"))),
    Query("f21_date_arithmetic", *_made(later=(lambda a, b: _text(F.date_add(F.to_date(a), 10)), "CAST(CAST(a AS DATE) + 10 AS STRING)"), hours=(lambda a, b: F.date_format(a + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm"), "strftime(a + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M')"))),
    Query("f22_retail_calendar", lambda spark, sf_dir: _rows(spark, sf_dir).select("id", dialect.retail_week(F.to_date("a")).alias("r")).select("id", F.col("r.year").alias("year_"), F.col("r.period").alias("period_"), F.col("r.week").alias("week_"), F.col("r.day").alias("day_")),
          f"""SELECT id, CAST(floor(n / 364) + 2023 AS INT) AS year_, CAST((w - 1) // 13 * 3 + CASE WHEN (w - 1) % 13 < 4 THEN 1 WHEN (w - 1) % 13 < 9 THEN 2 ELSE 3 END AS INT) AS period_, CAST(w AS INT) AS week_, CAST((n % 7 + 7) % 7 + 1 AS INT) AS day_
          FROM (SELECT id, n, (n % 364 + 364) % 364 // 7 + 1 AS w FROM (SELECT id, date_diff('day', DATE '2023-01-29', CAST(a AS DATE)) AS n FROM {_VALUES}))"""),
    Query("f23_date_key", *_made(key_=(lambda a, b: (F.year(a) * 10000 + F.month(a) * 100 + F.dayofmonth(a)).cast("long"), "year(a) * 10000 + month(a) * 100 + day(a)"))),
]
