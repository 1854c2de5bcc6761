"""Procedures and orchestration: validated parameters, audited steps, ordered stages, quality gates."""

from __future__ import annotations

import datetime
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query
from ..functions.dialect import quote_ident
from .loads import reload_window
from .tables import Table, scratch

log = logging.getLogger("marlstone")


class StepError(RuntimeError):
    """A step failed; says which, in which batch."""


class BlockingIssue(RuntimeError):
    """A quality check with a blocking threshold failed."""


def check_window(start: datetime.date | None, end: datetime.date | None, today: datetime.date, most_days: int = 31) -> None:
    """Fails early: dates present, in order, not in the future, and not too far apart."""
    if start is None or end is None:
        raise ValueError("start and end are needed")
    if start > end:
        raise ValueError("start lies after end")
    if end > today:
        raise ValueError("end lies in the future")
    if (end - start).days > most_days:
        raise ValueError(f"a window takes {most_days} days at most")


@dataclass
class Audit:
    """A log of steps: name, batch, status, rows, seconds."""

    rows: list[tuple] = field(default_factory=list)

    def step(self, batch: str, name: str, run: Callable[[], int | None]) -> int | None:
        """Runs a step and records how it ended; a failure is recorded, then raised with its context."""
        began = time.monotonic()
        try:
            n = run()
        except Exception as e:
            self.rows.append((batch, name, "FAILED", None, time.monotonic() - began))
            raise StepError(f"step {name} of batch {batch}: {e}") from e
        self.rows.append((batch, name, "DONE", n, time.monotonic() - began))
        log.info("step %s of batch %s: %s rows", name, batch, n)
        return n

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "batch string, step string, status string, n long, seconds double")


def orchestrate(audit: Audit, batch: str, control: list[tuple[int, str, bool]], stages: dict[str, Callable[[], int]]) -> None:
    """Runs the enabled stages of a control table in order; the first failure stops the rest."""
    for _, name, enabled in sorted(control):
        if enabled:
            audit.step(batch, name, stages[name])


@dataclass(frozen=True)
class Check:
    """A quality rule: rows that break it, and how many are too many."""

    name: str
    broken: Column
    warn: int = 0
    block: int | None = None


def quality(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks in one pass: name, rows, status."""
    counts = df.agg(*(F.sum(F.coalesce(c.broken, F.lit(False)).cast("long")).alias(c.name) for c in checks)).first()
    status = lambda c, n: "BLOCKING" if c.block is not None and n > c.block else "WARN" if n > c.warn else "PASS"
    return df.sparkSession.createDataFrame([(c.name, counts[c.name] or 0, status(c, counts[c.name] or 0)) for c in checks], "check_ string, n long, status string")


def gate(results: DataFrame) -> DataFrame:
    """Raises if a check blocks; all results were recorded before."""
    bad = [r["check_"] for r in results.filter("status = 'BLOCKING'").collect()]
    if bad:
        raise BlockingIssue(", ".join(bad))
    return results


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Declared keys are hints; this checks one."""
    twice = df.groupBy(*keys).count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{keys} repeat")


def exactly_one(df: DataFrame):
    """SELECT INTO STRICT: the single row, or an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError("no row" if not rows else "more than one row")
    return rows[0]


def count_rows(spark: SparkSession, view: str, **filters) -> int:
    """Dynamic SQL with quoted names and bound values."""
    if not spark.catalog.tableExists(view):
        raise ValueError(f"no such table: {view}")
    where = " AND ".join(f"{quote_ident(c)} = :{c}" for c in filters) or "true"
    return spark.sql(f"SELECT count(*) FROM IDENTIFIER(:view) WHERE {where}", args={"view": view, **filters}).first()[0]


def _validation(spark, sf_dir):
    d, today = datetime.date, datetime.date(2024, 6, 30)
    cases = [(d(2024, 6, 1), d(2024, 6, 30)), (None, d(2024, 6, 1)), (d(2024, 6, 2), d(2024, 6, 1)), (d(2024, 7, 1), d(2024, 7, 2)), (d(2024, 1, 1), d(2024, 6, 1))]

    def ok(a, b):
        try:
            check_window(a, b, today)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(i, ok(*c)) for i, c in enumerate(cases)], "i int, ok boolean")


def _orchestrated(spark, sf_dir):
    audit, orders = Audit(), spark.read.parquet(f"{sf_dir}/orders.parquet")
    stages = {"load": lambda: orders.count(), "check": lambda: 1 // 0, "publish": lambda: 1, "off": lambda: 1}
    try:
        orchestrate(audit, "b1", [(2, "check", True), (1, "load", True), (3, "publish", True), (0, "off", False)], stages)
    except StepError:
        pass
    return audit.frame(spark).select("step", "status", "n")


def _quality(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return quality(orders, [Check("no_customer", F.col("o_custkey").isNull(), block=0), Check("pending", F.col("o_orderstatus") == "P", warn=10), Check("dear", F.col("o_totalprice") > 1000, block=5)])


def _gate(spark, sf_dir):
    try:
        gate(_quality(spark, sf_dir))
        return spark.createDataFrame([("passed",)], "outcome string")
    except BlockingIssue as e:
        return spark.createDataFrame([(f"blocked: {e}",)], "outcome string")


def _unique(spark, sf_dir):
    orders, out = spark.read.parquet(f"{sf_dir}/orders.parquet"), []
    for keys in (["o_orderkey"], ["o_custkey"]):
        try:
            assert_unique(orders, keys)
            out.append((keys[0], True))
        except ValueError:
            out.append((keys[0], False))
    return spark.createDataFrame(out, "key string, is_unique boolean")


def _strict(spark, sf_dir):
    nation, out = spark.read.parquet(f"{sf_dir}/nation.parquet"), []
    for condition in ("n_nationkey = 3", "n_nationkey < 2", "n_nationkey = -1"):
        try:
            out.append((condition, "one" if exactly_one(nation.filter(condition)) else ""))
        except LookupError as e:
            out.append((condition, str(e)))
    return spark.createDataFrame(out, "condition string, outcome string")


def _dynamic(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("marlstone_orders")
    return spark.createDataFrame([(count_rows(spark, "marlstone_orders", o_orderstatus="F"), count_rows(spark, "marlstone_orders", o_orderstatus="F' OR '1'='1"))], "n long, injected long")


def _loop_or_set(spark, sf_dir):
    """A procedure's loop over control rows and the set form give the same answer; only the set form scales."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    by_set = {r["o_orderstatus"]: r["n"] for r in orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()}
    by_loop = {s: orders.filter(F.col("o_orderstatus") == s).count() for s in ("F", "O", "P")}
    return spark.createDataFrame([(by_set == by_loop,)], "equal_ boolean")


def _master(spark, sf_dir):
    """Validate, stage, replace the window, audit: a pipeline that may be run again."""
    audit, orders = Audit(), spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    table = Table(spark, scratch(spark, "billing")).overwrite(orders.filter("day < DATE '1996-01-10'"))
    for batch in ("b1", "b2"):
        audit.step(batch, "validate", lambda: check_window(datetime.date(1996, 1, 1), datetime.date(1996, 1, 31), datetime.date(2024, 1, 1)))
        audit.step(batch, "reload", lambda: reload_window(table, orders, "day", "1996-01-01", "1996-02-01").read().count())
    return audit.frame(spark).filter("step = 'reload'").select("batch", "status", "n")


def _script(spark, sf_dir):
    spark.sql("DECLARE OR REPLACE VARIABLE marlstone_total INT DEFAULT 0")
    for n in range(1, 6):
        spark.sql(f"SET VAR marlstone_total = marlstone_total + {n}")
    return spark.sql("SELECT marlstone_total AS total")


def _benchmark(spark, sf_dir):
    """Slow form (a scalar lookup per row) and fast form (joins): same rows, by checksum."""
    lines, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    fast = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("p_brand").agg(F.count("*").alias("n"))
    slow = lines.groupBy("l_partkey").agg(F.count("*").alias("k")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("k").alias("n"))
    return fast.exceptAll(slow).unionByName(slow.exceptAll(fast)).agg(F.count("*").alias("differences"))


QUERIES = [
    Query("c04_variables", _script, "SELECT 15 AS total"),
    Query("c06_dynamic_sql", _dynamic, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS injected FROM orders WHERE o_orderstatus = 'F'"),
    Query("c07_select_into_strict", _strict, "SELECT c AS condition, CASE WHEN n = 0 THEN 'no row' WHEN n = 1 THEN 'one' ELSE 'more than one row' END AS outcome FROM (SELECT 'n_nationkey = 3' AS c, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'n_nationkey < 2', count(*) FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 'n_nationkey = -1', count(*) FROM nation WHERE n_nationkey = -1)"),
    Query("c14_parameter_validation", _validation, "SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, false)) AS t(i, ok)"),
    Query("c16_orchestrator", _orchestrated, "SELECT 'load' AS step, 'DONE' AS status, count(*) AS n FROM orders UNION ALL SELECT 'check', 'FAILED', NULL"),
    Query("c17_set_not_loop", _loop_or_set, "SELECT true AS equal_"),
    Query("e12_quality_checks", _quality, """SELECT 'no_customer' AS check_, CAST(0 AS BIGINT) AS n, 'PASS' AS status UNION ALL SELECT 'pending', n, CASE WHEN n > 10 THEN 'WARN' ELSE 'PASS' END FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P')
          UNION ALL SELECT 'dear', n, CASE WHEN n > 5 THEN 'BLOCKING' ELSE 'PASS' END FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000)"""),
    Query("e12_quality_gate", _gate, "SELECT CASE WHEN count(CASE WHEN o_totalprice > 1000 THEN 1 END) > 5 THEN 'blocked: dear' ELSE 'passed' END AS outcome FROM orders"),
    Query("e13_assert_unique", _unique, "SELECT 'o_orderkey' AS key, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders UNION ALL SELECT 'o_custkey', count(*) = count(DISTINCT o_custkey) FROM orders"),
    Query("e20_master_pipeline", _master, "SELECT b AS batch, 'DONE' AS status, n FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01') CROSS JOIN (VALUES ('b1'), ('b2')) AS t(b)"),
    Query("e22_benchmark_gate", _benchmark, "SELECT CAST(0 AS BIGINT) AS differences"),
]
