"""Loads: idempotent reloads, upserts, late data, chunks and watermarks, over versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query
from ..operators.windows import latest_per_key
from .tables import Table, scratch


def reload_window(table: Table, source: DataFrame, column: str, low, high) -> Table:
    """Delete and insert of a half-open window: running it twice gives the same rows."""
    inside = (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))
    return table.replace(inside, source.filter(inside))


def lookback(table: Table, source: DataFrame, column: str, day: str, days: int = 7) -> Table:
    """Reloads the last days before one, so that late rows come in; 0 to 60 days."""
    if not 0 <= days <= 60:
        raise ValueError("a lookback takes 0 to 60 days")
    end = F.date_add(F.lit(day).cast("date"), 1)
    inside = (F.col(column) >= F.date_sub(end, days + 1)) & (F.col(column) < end)
    return table.replace(inside, source.filter(inside))


def load_after(table: Table, source: DataFrame, sequence: str) -> int:
    """Appends rows beyond the largest sequence number so far; returns how many came in."""
    top = table.read().agg(F.max(sequence)).first()[0]
    fresh = source if top is None else source.filter(F.col(sequence) > top)
    n = fresh.count()
    if n:
        table.insert(fresh)
    return n


def load_in_chunks(table: Table, source: DataFrame, key: str, done: set) -> list:
    """Loads one chunk per key value that is not done yet, each as files of its own; a failed run goes on where it stopped.

    Keys are days or the like: the driver holds one row for each, as a control table would.
    """
    loaded = []
    for value in sorted(r[0] for r in source.select(key).distinct().collect()):
        if value not in done:
            table.insert(source.filter(F.col(key) == value))
            done.add(value)
            loaded.append(value)
    return loaded


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))


def _table(spark: SparkSession, df: DataFrame) -> Table:
    return Table(spark, scratch(spark, "t")).overwrite(df)


def _state(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum((F.col("o_orderstatus") == "X").cast("long")).alias("changed"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order changed, and 100 new ones."""
    orders = _orders(spark, sf_dir)
    return orders.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(orders.filter("o_orderkey < 100").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


_MERGED = """SELECT (SELECT count(*) FROM orders) + 100 AS n, CAST((SELECT sum(o_orderkey) FROM orders) + (SELECT sum(o_orderkey + 10000000) FROM orders WHERE o_orderkey < 100) AS BIGINT) AS keys,
 (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS changed"""


def _insert(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir).filter("o_orderkey % 2 = 0"))
    return _state(t.insert(_orders(spark, sf_dir).filter("o_orderkey % 2 = 1")).read())


def _ctas(spark, sf_dir):
    return _table(spark, _orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.count("*").alias("n"))).read()


def _delete(spark, sf_dir):
    return _state(_table(spark, _orders(spark, sf_dir)).delete(F.col("o_orderstatus") == "P").read())


def _delete_using(spark, sf_dir):
    gone = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _state(_table(spark, _orders(spark, sf_dir)).delete_using(gone, ["o_custkey"]).read())


def _update_from(spark, sf_dir):
    debtors = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("debt"))
    t = _table(spark, _orders(spark, sf_dir)).update_from(debtors, ["o_custkey"], o_orderstatus=F.when(F.col("debt"), "X").otherwise(F.col("o_orderstatus")))
    return _state(t.read())


def _update_in(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir))
    return _state(t.update((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderstatus") == "O"), o_orderstatus=F.lit("X")).read())


def _reload(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    t = _table(spark, orders.filter("day < DATE '1996-01-01'"))
    for _ in range(2):
        reload_window(t, orders, "day", "1995-06-01", "1996-06-01")
    return _state(t.read())


def _upsert(spark, sf_dir):
    """The two statements of it: what the changes name goes, then they come in."""
    t, changes = _table(spark, _orders(spark, sf_dir)), _changes(spark, sf_dir)
    return _state(t.delete_using(changes, ["o_orderkey"]).insert(changes).read())


def _merge(spark, sf_dir):
    return _state(_table(spark, _orders(spark, sf_dir)).merge(_changes(spark, sf_dir), ["o_orderkey"]).read())


def _merge_deduped(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    doubled = changes.withColumn("seq", F.lit(2)).unionByName(changes.withColumn("seq", F.lit(1)).withColumn("o_orderstatus", F.lit("Y")))
    latest = latest_per_key(doubled, ["o_orderkey"], F.desc("seq")).drop("seq")
    return _state(_table(spark, _orders(spark, sf_dir)).merge(latest, ["o_orderkey"]).read())


def _truncate(spark, sf_dir):
    return _table(spark, _orders(spark, sf_dir)).truncate().read().agg(F.count("*").alias("n"))


def _append_move(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    target, source = _table(spark, orders.filter("o_orderkey % 3 = 0")), _table(spark, orders.filter("o_orderkey % 3 <> 0"))
    target.insert(source.read())
    source.truncate()
    return _state(target.read()).withColumn("left_", F.lit(source.read().count()))


def _swap(spark, sf_dir):
    """An empty build is refused and the old rows stay."""
    t = _table(spark, _orders(spark, sf_dir))

    def some(df):
        if df.isEmpty():
            raise ValueError("the new version is empty")

    try:
        t.overwrite(_orders(spark, sf_dir).limit(0), check=some)
    except ValueError:
        pass
    return _state(t.read())


def _alter(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir)).add_column("channel", "string", "web")
    return t.read().groupBy("channel").agg(F.count("*").alias("n"))


def _staged(spark, sf_dir):
    """A version that was staged but not published is invisible."""
    t = _table(spark, _orders(spark, sf_dir))
    t.stage(_changes(spark, sf_dir))
    return _state(t.read())


def _chunks(spark, sf_dir):
    orders, done = _orders(spark, sf_dir).withColumn("year", F.year("day")), {1996}
    t = _table(spark, orders.filter("year = 1996"))
    load_in_chunks(t, orders, "year", done)
    return _state(t.read())


def _watermark(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    t = _table(spark, orders.filter("o_orderkey < 500"))
    n = [load_after(t, orders, "o_orderkey") for _ in range(2)]
    return _state(t.read()).withColumn("second_run", F.lit(n[1]))


def _late(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    t = _table(spark, orders.filter("day <= DATE '1996-03-10' AND o_orderkey % 5 <> 0"))
    return _state(lookback(t, orders, "day", "1996-03-10", 30).read())


def _vacuum(spark, sf_dir):
    t = _table(spark, _orders(spark, sf_dir))
    t.delete(F.col("o_orderkey") < 10)
    before = t.versions()
    t.vacuum()
    return spark.createDataFrame([(before, t.versions())], "before_ int, after_ int")


def _evolve(spark, sf_dir):
    """Rows of an older schema, and of one with a column more, in one table."""
    orders = _orders(spark, sf_dir)
    t = _table(spark, orders.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey")).add_column("o_orderstatus", "string")
    return t.insert(orders.filter("o_orderkey % 2 = 0")).read()


def _forget(spark, sf_dir):
    """Anonymises customers who asked for it, and marks their requests done."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    asked = F.col("c_custkey") % 100 == 0
    t = _table(spark, customers).update(asked, c_name=F.concat(F.lit("anon-"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 8)), c_acctbal=F.lit(0.0))
    return t.read().agg(F.sum(F.col("c_name").startswith("anon-").cast("long")).alias("forgotten"), F.sum((F.col("c_acctbal") == 0).cast("long")).alias("cleared"))


def _tiers(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return orders.select(F.when(F.col("day") >= F.lit("2000-01-01").cast("date"), "hot").when(F.col("day") >= F.lit("1997-01-01").cast("date"), "warm").otherwise("purged").alias("tier")).filter("tier <> 'purged'").groupBy("tier").agg(F.count("*").alias("n"))


_ALL = "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS changed FROM orders"

QUERIES = [
    Query("d01_insert_select", _insert, _ALL),
    Query("d02_ctas", _ctas, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    Query("d03_delete", _delete, _ALL + " WHERE o_orderstatus <> 'P'"),
    Query("d04_delete_using", _delete_using, _ALL + " WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    Query("d05_update_from", _update_from, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    Query("d06_update_in", _update_in, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM orders"),
    Query("d07_idempotent_reload", _reload, _ALL + " WHERE o_orderdate < TIMESTAMP '1996-06-01'"),
    Query("d08_delete_insert_upsert", _upsert, _MERGED),
    Query("d09_merge", _merge, _MERGED),
    Query("d10_merge_deduped", _merge_deduped, _MERGED),
    Query("d13_truncate", _truncate, "SELECT CAST(0 AS BIGINT) AS n"),
    Query("d14_append_move", _append_move, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS changed, CAST(0 AS INT) AS left_ FROM orders"),
    Query("d15_swap_checked", _swap, _ALL),
    Query("d16_add_column", _alter, "SELECT 'web' AS channel, count(*) AS n FROM orders"),
    Query("d17_stage_then_publish", _staged, _ALL),
    Query("d19_chunked_load", _chunks, _ALL),
    Query("d20_watermark_load", _watermark, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS changed, CAST(0 AS INT) AS second_run FROM orders"),
    Query("d21_late_data", _late, _ALL + " WHERE o_orderdate < TIMESTAMP '1996-03-11' AND (o_orderkey % 5 <> 0 OR o_orderdate >= TIMESTAMP '1996-02-09')"),
    Query("d22_vacuum", _vacuum, "SELECT 2 AS before_, 1 AS after_"),
    Query("d23_schema_evolution", _evolve, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders"),
    Query("d24_forget", _forget, "SELECT sum(CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END)::BIGINT AS forgotten, sum(CASE WHEN c_custkey % 100 = 0 OR c_acctbal = 0 THEN 1 ELSE 0 END)::BIGINT AS cleared FROM customer"),
    Query("d25_storage_tiers", _tiers, "SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'hot' ELSE 'warm' END AS tier, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1"),
]
