"""Row and column security by policy, masking, audit questions, and table health from file metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same


@dataclass
class Policies:
    """What a role may see of a table. Without a grant no column and without a row policy no row: the default is to deny."""

    columns: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    rows: dict[tuple[str, str], Column] = field(default_factory=dict)
    masks: dict[tuple[str, str, str], Column] = field(default_factory=dict)

    def grant(self, role: str, table: str, columns: list[str]) -> "Policies":
        self.columns[role, table] = columns
        return self

    def attach_rows(self, role: str, table: str, condition: Column) -> "Policies":
        self.rows[role, table] = condition
        return self

    def mask(self, role: str, table: str, column: str, value: Column) -> "Policies":
        self.masks[role, table, column] = value
        return self

    def view(self, role: str, table: str, df: DataFrame) -> DataFrame:
        """The table as the role sees it; policies are plain filters and projections, so they push down."""
        if (role, table) not in self.columns:
            raise PermissionError(f"{role} may not read {table}")
        seen = df.filter(self.rows.get((role, table), F.lit(False)))
        return seen.select(*(self.masks[role, table, c].alias(c) if (role, table, c) in self.masks else F.col(c) for c in self.columns[role, table]))

    def privileges(self) -> list[tuple[str, str, str, str]]:
        """What is granted: role, table, column, and whether rows or the column's values are held back."""
        return sorted((role, table, c, "mask" if (role, table, c) in self.masks else "rows" if (role, table) in self.rows else "none") for (role, table), columns in self.columns.items() for c in columns)

    def protects(self, table: str) -> bool:
        """Whether a materialised view over the table would leak past a policy."""
        return any(t == table for _, t in self.rows) or any(t == table for _, t, _ in self.masks)


def mask_email(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "(^.{2})(.*)(@.*$)", "$1***$3")


def mask_digits(c: Column, shown: int = 4) -> Column:
    """All digits but the last few as X."""
    return F.concat(F.regexp_replace(F.expr(f"left({c._jc.toString()}, greatest(length({c._jc.toString()}) - {shown}, 0))"), "[0-9]", "X"), F.right(c, F.lit(shown)))


def odd_hours(log: DataFrame, first: int = 7, last: int = 19) -> DataFrame:
    """Accesses outside working hours, by user."""
    return log.filter(~F.hour("ts").between(first, last)).groupBy("user_id").agg(F.count("*").alias("n"))


def health(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and skew of a table: the largest group against the mean."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows_"), F.count("*").alias("keys"), F.round(F.max("n") / F.avg("n"), 4).alias("skew"))


def empty_tables(tables: dict[str, DataFrame]) -> list[str]:
    """Names of tables without a row: each is looked at for one row only."""
    return sorted(name for name, df in tables.items() if df.isEmpty())


def _policies() -> Policies:
    return Policies().grant("clerk", "customer", ["c_custkey", "c_name"]).attach_rows("clerk", "customer", F.col("c_nationkey") == 3).mask("clerk", "customer", "c_name", F.concat(F.lit("***"), F.right("c_name", F.lit(3)))).grant("guest", "customer", ["c_custkey"])


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policies().view("clerk", "customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, p = spark.read.parquet(f"{sf_dir}/customer.parquet"), _policies()
    try:
        p.view("nobody", "customer", customer)
        refused = False
    except PermissionError:
        refused = True
    return spark.createDataFrame([(refused, p.view("guest", "customer", customer).count(), p.protects("customer"), p.protects("orders"))], "refused boolean, guest_rows long, protects boolean, free boolean")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "concat(c_mktsegment, '@X.org') AS mail", "concat('12', c_custkey % 10, '-45-', 6000 + c_custkey % 1000) AS ssn")
    return rows.select("c_custkey", mask_email(F.col("mail")).alias("mail"), mask_digits(F.col("ssn")).alias("ssn"))


def _privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants by role and column, with the rows that each role sees."""
    customer, p = spark.read.parquet(f"{sf_dir}/customer.parquet"), _policies()
    return spark.createDataFrame([(*row, p.view(row[0], row[1], customer).count()) for row in p.privileges()], "role string, table_ string, column_ string, held_back string, n long")


#: A log of transactions out of the events: a user holds or awaits a lock on a kind of event, errors are those that wait.
_LOCKS = "SELECT event_id, user_id AS pid, CAST(extract(day FROM ts) AS INT) AS relation_, ts AS txn_start, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Exclusive' ELSE 'AccessShare' END AS lock_mode, event_type <> 'error' AS granted FROM {events}"
#: And a log of queries: the kind of event is the queue, its value the seconds, the payload's number the wait.
_RAN = "SELECT event_id, user_id, event_type AS service_class, ts AS start_time, CAST(value AS DECIMAL(18,4)) AS elapsed, event_id % 40 AS queued, event_id % 5 = 0 AS cache_hit FROM {events}"


def health_report(tables: dict[str, tuple[DataFrame, str]], most_nulls: float = 0.0) -> DataFrame:
    """Each table's rows, distinct keys and null keys, and what to do about them; one pass over each."""
    out = None
    for name, (df, key) in tables.items():
        one = df.agg(F.lit(name).alias("table_"), F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.sum(F.col(key).isNull().cast("long")).alias("nulls"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("action", F.when(F.col("nulls") > F.col("n") * most_nulls, "CLEAN").when(F.col("keys") < F.col("n"), "DEDUPLICATE").otherwise("NONE"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    holes = read("customer").withColumn("c_custkey", F.expr("IF(c_custkey % 50 = 0, NULL, c_custkey)"))
    return health_report({"orders": (read("orders"), "o_orderkey"), "lineitem": (read("lineitem"), "l_orderkey"), "holes": (holes, "c_custkey")})


QUERIES = [
    Query("b04_privileges", _privileges, "SELECT role, 'customer' AS table_, column_, held_back, CASE WHEN role = 'clerk' THEN n ELSE 0 END AS n FROM (VALUES ('clerk', 'c_custkey', 'rows'), ('clerk', 'c_name', 'mask'), ('guest', 'c_custkey', 'none')) AS t(role, column_, held_back) CROSS JOIN (SELECT count(*) AS n FROM customer WHERE c_nationkey = 3)"),
    same("b05_waiting", f"SELECT relation_, count(CASE WHEN granted THEN 1 END) AS holders, count(CASE WHEN NOT granted THEN 1 END) AS waiting, count(CASE WHEN granted AND lock_mode = 'Exclusive' THEN 1 END) AS exclusive_ FROM ({_LOCKS}) l GROUP BY relation_"),
    same("b05_blockers", f"""SELECT w.event_id AS waits, min(h.event_id) AS first_blocker, count(*) AS blockers FROM ({_LOCKS}) w JOIN ({_LOCKS}) h ON h.relation_ = w.relation_ AND h.granted AND NOT w.granted AND h.lock_mode = 'Exclusive' AND h.pid = w.pid AND h.txn_start < w.txn_start GROUP BY w.event_id"""),
    same("b05_oldest_transactions", f"SELECT pid, CAST(min(txn_start) AS VARCHAR(19)) AS oldest, count(*) AS locks FROM ({_LOCKS}) l WHERE granted GROUP BY pid ORDER BY min(txn_start), pid LIMIT 5"),
    same("b06_queues", f"SELECT service_class, count(*) AS queries, round(avg(CAST(queued AS DOUBLE)), 4) AS avg_queue, max(queued) AS max_queue FROM ({_RAN}) q GROUP BY service_class"),
    same("b06_dearest", f"SELECT event_id, user_id, CAST(elapsed AS DOUBLE) AS elapsed FROM ({_RAN}) q WHERE NOT cache_hit ORDER BY elapsed DESC, event_id LIMIT 20"),
    same("b06_cost_by_user", f"SELECT user_id, count(*) AS queries, CAST(sum(elapsed) AS DOUBLE) AS seconds FROM ({_RAN}) q WHERE NOT cache_hit GROUP BY user_id"),
    same("b06_cost_by_day", f"SELECT CAST(CAST(start_time AS DATE) AS VARCHAR(10)) AS day_, CAST(sum(elapsed) AS DOUBLE) AS seconds, count(CASE WHEN cache_hit THEN 1 END) AS cached FROM ({_RAN}) q GROUP BY 1"),
    same("b06_cost_by_hour", f"SELECT CAST(extract(hour FROM start_time) AS INT) AS hour_, count(*) AS queries, CAST(sum(elapsed) AS DOUBLE) AS seconds FROM ({_RAN}) q GROUP BY 1"),
    Query("c19_health_report", _report, """SELECT 'orders' AS table_, count(*) AS n, count(DISTINCT o_orderkey) AS keys, CAST(0 AS BIGINT) AS nulls, 'NONE' AS action FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), 0, 'DEDUPLICATE' FROM lineitem
          UNION ALL SELECT 'holes', count(*), count(DISTINCT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END), count(CASE WHEN c_custkey % 50 = 0 THEN 1 END), 'CLEAN' FROM customer"""),
    Query("y02_column_grant", lambda s, d: Policies().grant("r", "nation", ["n_name"]).attach_rows("r", "nation", F.lit(True)).view("r", "nation", s.read.parquet(f"{d}/nation.parquet")), "SELECT n_name FROM nation"),
    Query("y03_row_policy", _seen, "SELECT c_custkey, '***' || right(c_name, 3) AS c_name FROM customer WHERE c_nationkey = 3"),
    Query("y03_default_deny", _denied, "SELECT true AS refused, CAST(0 AS BIGINT) AS guest_rows, true AS protects, false AS free"),
    Query("y04_masking", _masks, "SELECT c_custkey, left(lower(c_mktsegment), 2) || '***@x.org' AS mail, 'XXX-XX-' || (6000 + c_custkey % 1000) AS ssn FROM customer"),
    Query("y06_odd_hours", lambda s, d: odd_hours(s.read.parquet(f"{d}/events.parquet")), "SELECT user_id, count(*) AS n FROM events WHERE hour(ts) NOT BETWEEN 7 AND 19 GROUP BY 1"),
    Query("b01_table_health", lambda s, d: health(s.read.parquet(f"{d}/orders.parquet"), "o_custkey"), "SELECT CAST(sum(n) AS BIGINT) AS rows_, count(*) AS keys, round(max(n) / avg(n), 4) AS skew FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"),
    Query("b08_recovery_check", lambda s, d: s.createDataFrame([(n,) for n in empty_tables({t: s.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "orders")} | {"gone": s.read.parquet(f"{d}/nation.parquet").limit(0)})], "name string"), "SELECT 'gone' AS name"),
]
