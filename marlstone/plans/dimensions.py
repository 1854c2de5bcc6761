"""Dimensions and the medallion path: typed bronze, validated silver, slowly changing gold, facts by point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query
from ..functions.hashing import row_hash
from ..operators.predicates import split_valid
from ..operators.windows import latest_per_key, ranked
from .tables import merged

FOREVER = "9999-12-31"


def scd1(dim: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """The latest values replace the old ones."""
    return merged(dim, latest_per_key(source, [key], F.desc(order)).select(*dim.columns), [key])


def scd2(dim: DataFrame, source: DataFrame, key: str, tracked: list[str], day: str) -> DataFrame:
    """A changed row ends the day before, and a new one begins. Unchanged rows stay; NULLs compare as values.

    dim: key, tracked, valid_from, valid_to, is_current.
    """
    at = F.lit(day).cast("date")
    now = dim.filter("is_current").select(F.col(key).alias("__k"), row_hash(*tracked).alias("__old"))
    fresh = source.select(key, *tracked).withColumn("__new", row_hash(*tracked)).join(now, F.col(key) == F.col("__k"), "left").filter(F.col("__k").isNull() | (F.col("__old") != F.col("__new"))).select(key, *tracked)
    ended = dim.join(fresh.select(F.col(key).alias("__f")), F.col(key) == F.col("__f"), "left")
    closes = F.col("is_current") & F.col("__f").isNotNull()
    kept = ended.withColumn("valid_to", F.when(closes, F.date_sub(at, 1)).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~closes).drop("__f")
    new = fresh.withColumn("valid_from", at).withColumn("valid_to", F.lit(FOREVER).cast("date")).withColumn("is_current", F.lit(True))
    return kept.unionByName(new.select(*kept.columns))


def scd3(dim: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """The value before stands beside the current one. dim: key, current, previous."""
    both = dim.join(source.select(F.col(key).alias("__k"), F.col(column).alias("__v")), F.col(key) == F.col("__k"), "full")
    moved = F.col("__k").isNotNull() & ~F.col("current").eqNullSafe(F.col("__v"))
    return both.select(F.coalesce(key, "__k").alias(key), F.when(moved, F.col("__v")).otherwise(F.col("current")).alias("current"), F.when(moved & F.col(key).isNotNull(), F.col("current")).otherwise(F.col("previous")).alias("previous"))


def scd6(dim: DataFrame, source: DataFrame, key: str, tracked: list[str], day: str) -> DataFrame:
    """Type 2 history whose every row also carries the current values (type 1) as current_*."""
    history = scd2(dim.drop(*(f"current_{c}" for c in tracked)), source, key, tracked, day)
    current = history.filter("is_current").select(key, *(F.col(c).alias(f"current_{c}") for c in tracked))
    return history.join(current, key, "left")


def at_time(facts: DataFrame, dim: DataFrame, key: str, day: str, value: str, unknown) -> DataFrame:
    """Each fact with the dimension's value on its day."""
    d = dim.select(F.col(key).alias("__k"), "valid_from", "valid_to", F.col(value).alias("__v"))
    return facts.join(d, (F.col(key) == F.col("__k")) & F.col(day).between(F.col("valid_from"), F.col("valid_to")), "left").select(*facts.columns, F.coalesce("__v", F.lit(unknown)).alias(value))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")


def _moved(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return _customers(spark, sf_dir).withColumn("c_mktsegment", F.when(F.col("c_custkey") % every == 0, "MOVED").otherwise(F.col("c_mktsegment")))


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).filter("c_custkey % 5 <> 4").withColumn("valid_from", F.lit("2020-01-01").cast("date")).withColumn("valid_to", F.lit(FOREVER).cast("date")).withColumn("is_current", F.lit(True))


def _scd1(spark, sf_dir):
    source = _moved(spark, sf_dir, 10).withColumn("seq", F.lit(2)).unionByName(_customers(spark, sf_dir).withColumn("seq", F.lit(1)))
    return scd1(_customers(spark, sf_dir), source, "c_custkey", "seq")


def _scd2(spark, sf_dir):
    once = scd2(_dim(spark, sf_dir), _moved(spark, sf_dir, 10), "c_custkey", ["c_mktsegment"], "2024-01-01")
    twice = scd2(once, _moved(spark, sf_dir, 10), "c_custkey", ["c_mktsegment"], "2024-02-01")
    return twice.select("c_custkey", "c_mktsegment", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), "is_current")


def _scd3(spark, sf_dir):
    dim = _customers(spark, sf_dir).select("c_custkey", F.col("c_mktsegment").alias("current"), F.lit(None).cast("string").alias("previous"))
    return scd3(dim, _moved(spark, sf_dir, 10), "c_custkey", "c_mktsegment")


def _scd6(spark, sf_dir):
    return scd6(_dim(spark, sf_dir), _moved(spark, sf_dir, 10), "c_custkey", ["c_mktsegment"], "2024-01-01").groupBy("is_current").agg(F.count("*").alias("n"), F.sum((F.col("current_c_mktsegment") == "MOVED").cast("long")).alias("moved"))


def _fact(spark, sf_dir):
    dim = scd2(_dim(spark, sf_dir), _moved(spark, sf_dir, 10), "c_custkey", ["c_mktsegment"], "1998-01-01")
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), F.add_months(F.to_date("o_orderdate"), 12 * 24).alias("day"))
    dim = dim.withColumn("valid_from", F.add_months("valid_from", 12 * 25))
    return at_time(facts, dim.withColumn("valid_to", F.least(F.col("valid_to"), F.lit(FOREVER).cast("date"))), "c_custkey", "day", "c_mktsegment", "UNKNOWN").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def bronze(raw: DataFrame, key: str, required: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows, one per key, and the rejects."""
    good, bad = split_valid(raw, required)
    return latest_per_key(good, [key], F.desc_nulls_last(order)), bad


def silver(bronze_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON profiles as columns; rejects carry the first reason that holds."""
    field = lambda p: F.nullif(F.get_json_object("js", p), F.lit(""))
    typed = bronze_rows.select("id", F.lower(F.trim(field("$.email"))).alias("email"), field("$.age").try_cast("int").alias("age"), F.col("seq"))
    reason = F.when(~F.coalesce(F.col("email").like("%@%.%"), F.lit(False)), "MALFORMED_EMAIL").when(~F.coalesce(F.col("age").between(0, 120), F.lit(False)), "INVALID_AGE")
    marked = typed.withColumn("reason", reason)
    return latest_per_key(marked.filter("reason IS NULL"), ["id"], F.desc("seq")).drop("reason"), marked.filter("reason IS NOT NULL")


#: A profile for every customer, with bad addresses and ages among them, and for some a later one.
_PROFILE = """concat('{', CASE WHEN c_custkey % 7 > 0 THEN concat('"email": " C', c_custkey, CASE WHEN c_custkey % 11 > 0 THEN '@X.org' ELSE '' END, ' ", ') ELSE '' END, '"age": ', CASE WHEN c_custkey % 13 = 0 THEN '"old"' ELSE CAST(c_custkey % 150 AS STRING) END, '}')"""


def _bronze(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = orders.unionByName(orders.filter("o_orderkey % 20 = 0").withColumn("o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))).withColumn("o_custkey", F.when(F.col("o_orderkey") % 33 != 0, F.col("o_custkey")))
    good, bad = bronze(raw, "o_orderkey", ["o_custkey"], "o_orderdate")
    return good.agg(F.lit("good").alias("part"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("bad").alias("part"), F.count("*").alias("n")))


def _silver_join(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    kept = customer.filter("c_custkey % 9 <> 0")
    return orders.join(kept, orders.o_custkey == kept.c_custkey, "left").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").isNull().cast("long")).alias("orphans"))


def _silver(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    first = customer.selectExpr("c_custkey AS id", f"{_PROFILE} AS js", "1 AS seq")
    later = customer.filter("c_custkey % 5 = 0").selectExpr("c_custkey AS id", "concat('{\"email\": \"new', c_custkey, '@y.org\", \"age\": 50}') AS js", "2 AS seq")
    good, bad = silver(first.unionByName(later))
    return good.select("id", "email", F.col("age").cast("string").alias("note")).unionByName(bad.select("id", "email", F.col("reason").alias("note")))


def with_surrogates(dim: DataFrame, new: DataFrame, key: str, surrogate: str) -> DataFrame:
    """The dimension and rows of new keys, whose surrogates go on from the largest without gaps, in order of the key."""
    top = dim.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
    fresh = new.join(dim.select(key), key, "left_anti")
    numbered = ranked(fresh, [F.asc(key)], to=surrogate)
    return dim.unionByName(numbered.withColumn(surrogate, F.col(surrogate) + F.lit(top)).select(*dim.columns))


def _surrogate(spark, sf_dir):
    """The first third of the customers has surrogates; a load that names all of them adds the others."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    dim = ranked(customer.filter("c_custkey % 3 = 0"), [F.asc("c_custkey")], to="sk").select("sk", "c_custkey", "c_mktsegment")
    return with_surrogates(dim, customer, "c_custkey", "sk").select("sk", "c_custkey")


QUERIES = [
    Query("e01_raw_to_bronze", _bronze, """WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderkey % 33 <> 0 THEN o_custkey END AS k FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 33 <> 0 THEN o_custkey END FROM orders WHERE o_orderkey % 20 = 0)
          SELECT 'good' AS part, count(DISTINCT o_orderkey) AS n FROM raw WHERE k IS NOT NULL UNION ALL SELECT 'bad', count(*) FROM raw WHERE k IS NULL"""),
    Query("e02_bronze_to_silver", _silver_join, "SELECT count(*) AS n, CAST(sum(CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS orphans FROM orders"),
    Query("e03_json_to_silver", _silver, """WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN 'c' || c_custkey || CASE WHEN c_custkey % 11 > 0 THEN '@x.org' ELSE '' END END AS email, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 150 END AS age FROM customer),
          m AS (SELECT *, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'MALFORMED_EMAIL' WHEN age IS NULL OR age > 120 THEN 'INVALID_AGE' END AS reason FROM p)
          SELECT k AS id, email, reason AS note FROM m WHERE reason IS NOT NULL UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN 'new' || k || '@y.org' ELSE email END, CASE WHEN k % 5 = 0 THEN '50' ELSE CAST(age AS VARCHAR) END FROM m WHERE reason IS NULL OR k % 5 = 0"""),
    Query("e04_scd2", _scd2, """WITH d AS (SELECT c_custkey, c_mktsegment, c_custkey % 10 = 0 AS moved, c_custkey % 5 <> 4 AS known FROM customer)
          SELECT c_custkey, c_mktsegment, '2020-01-01' AS valid_from, CASE WHEN moved THEN '2023-12-31' ELSE '9999-12-31' END AS valid_to, NOT moved AS is_current FROM d WHERE known
          UNION ALL SELECT c_custkey, CASE WHEN moved THEN 'MOVED' ELSE c_mktsegment END, '2024-01-01', '9999-12-31', true FROM d WHERE moved OR NOT known"""),
    Query("e05_fact_point_in_time", _fact, """WITH d AS (SELECT c_custkey, c_mktsegment, c_custkey % 10 = 0 AS moved, c_custkey % 5 <> 4 AS known FROM customer), h AS (
          SELECT c_custkey, c_mktsegment, DATE '2045-01-01' AS f, CASE WHEN moved THEN DATE '1997-12-31' ELSE DATE '9999-12-31' END AS t FROM d WHERE known
          UNION ALL SELECT c_custkey, CASE WHEN moved THEN 'MOVED' ELSE c_mktsegment END, DATE '2023-01-01', DATE '9999-12-31' FROM d WHERE moved OR NOT known)
          SELECT coalesce(h.c_mktsegment, 'UNKNOWN') AS c_mktsegment, count(*) AS n FROM orders LEFT JOIN h ON o_custkey = h.c_custkey AND CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE) BETWEEN f AND t GROUP BY 1"""),
    Query("e06_scd1", _scd1, "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    Query("e08_scd3", _scd3, "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS current, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END AS previous FROM customer"),
    Query("e09_scd6", _scd6, """WITH d AS (SELECT c_custkey % 10 = 0 AS moved, c_custkey % 5 <> 4 AS known FROM customer)
          SELECT NOT moved AS is_current, count(*) AS n, CAST(sum(CASE WHEN moved THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM (SELECT moved, moved AS m FROM d WHERE known AND moved) GROUP BY 1
          UNION ALL SELECT true, count(*), CAST(sum(CASE WHEN moved THEN 1 ELSE 0 END) AS BIGINT) FROM d"""),
    Query("e10_surrogate_keys", _surrogate, "SELECT CAST(row_number() OVER (ORDER BY c_custkey % 3 <> 0, c_custkey) AS INT) AS sk, c_custkey FROM customer"),
]
