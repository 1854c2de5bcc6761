"""Everyday operations: procedures that load, rebuild, refresh and diagnose, each with an audit of what it did."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Query, same
from ..operators.aggregates import LG_K
from ..operators.windows import latest_per_key
from ..sources import sinks
from . import control, dimensions, views
from .tables import Outrun, Table, TableLocked, scratch


@dataclass
class QueryLog:
    """What ran, how long it took, what it returned."""

    rows: list[tuple] = field(default_factory=list)

    def run(self, label: str, df: DataFrame) -> list[Row]:
        """Runs a query and logs its rows (counted while it runs) and seconds."""
        seen, began = Observation(), time.monotonic()
        out = df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
        self.rows.append((label, int(seen.get["n"]), time.monotonic() - began))
        return out

    def slowest(self, n: int) -> list[str]:
        return [r[0] for r in sorted(self.rows, key=lambda r: -r[2])[:n]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "label string, n long, seconds double")


def diagnose(df: DataFrame) -> dict[str, int]:
    """What a plan will do: exchanges, broadcasts, scans, Python steps, nested loops."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name: plan.count(text) for name, text in (("exchanges", "Exchange hashpartitioning"), ("broadcasts", "BroadcastExchange"), ("scans", "FileScan"), ("nested_loops", "NestedLoop"), ("cartesian", "CartesianProduct"))}


@dataclass
class Roles:
    """Grants to roles; a role holds what the roles it was granted hold."""

    granted: dict[str, set[str]] = field(default_factory=dict)
    inherits: dict[str, set[str]] = field(default_factory=dict)

    def grant(self, role: str, privilege: str) -> "Roles":
        self.granted.setdefault(role, set()).add(privilege)
        return self

    def grant_role(self, role: str, to: str) -> "Roles":
        self.inherits.setdefault(to, set()).add(role)
        return self

    def may(self, role: str, privilege: str, seen: frozenset = frozenset()) -> bool:
        if role in seen:
            return False
        return privilege in self.granted.get(role, ()) or any(self.may(r, privilege, seen | {role}) for r in self.inherits.get(role, ()))


class Shares:
    """Read-only names for other databases' tables: producer.schema.table."""

    def __init__(self):
        self._held: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> None:
        if name.count(".") != 2:
            raise ValueError("a shared name has three parts")
        self._held[name] = df

    def table(self, name: str) -> DataFrame:
        return self._held[name]


def copy_then_merge(target: Table, staged: DataFrame, keys: list[str]) -> int:
    """Merges a staged load; an empty one is refused, so a failed copy never looks like a finished load."""
    n = staged.count()
    if not n:
        raise ValueError("nothing was staged")
    target.merge(staged, keys)
    return n


def build_daily_sketches(table: Table, events: DataFrame, first: str, last: str) -> int:
    """Sketches of the users, rows and values by day and kind, for some days: theirs are replaced, so a run may be repeated."""
    day = F.to_date("ts")
    inside = lambda c: (c >= F.lit(first).cast("date")) & (c <= F.lit(last).cast("date"))
    made = events.filter(inside(day)).groupBy(day.alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", F.lit(LG_K)).alias("users"), F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    if not table.exists():
        table.overwrite(made.limit(0))
    table.replace(inside(F.col("day")), made)
    return table.read().filter(inside(F.col("day"))).count()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _partitions(spark, sf_dir):
    """Folders that appear are partitions at the next read."""
    path, orders = scratch(spark, "reg"), _t(spark, sf_dir, "orders")
    out = []
    for status in ("F", "O"):
        orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").write.parquet(f"{path}/o_orderstatus={status}")
        out += [(status, r["o_orderstatus"], r["count"]) for r in spark.read.parquet(path).groupBy("o_orderstatus").count().collect()]
    return spark.createDataFrame(out, "after_ string, o_orderstatus string, n long")


def _share(spark, sf_dir):
    shares = Shares()
    shares.add("sales.public.orders", _t(spark, sf_dir, "orders"))
    shares.add("crm.public.customer", _t(spark, sf_dir, "customer"))
    shares.add("ref.public.nation", _t(spark, sf_dir, "nation"))
    o, c, n = (shares.table(x) for x in ("sales.public.orders", "crm.public.customer", "ref.public.nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


def _items(spark, sf_dir):
    """Items of a key-value store: attributes differ from row to row."""
    item = F.expr("""concat('{"name": {"S": "', p_name, '"}', CASE WHEN p_partkey % 3 > 0 THEN concat(', "qty": {"N": "', p_size, '"}') ELSE '' END, '}')""")
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), item.alias("item"))
    v = F.parse_json("item")
    return rows.select("id", F.try_variant_get(v, "$.name.S", "string").alias("name"), F.try_variant_get(v, "$.qty.N", "string").cast("int").alias("qty"))


def _lock(spark, sf_dir):
    """A held lock refuses other writers; a version built before another was published is refused, so no update is lost."""
    path, region = scratch(spark, "locked"), _t(spark, sf_dir, "region")
    mine, other, held = Table(spark, path).overwrite(region), Table(spark, path), []
    with mine.locked():
        try:
            other.insert(region)
        except TableLocked:
            held.append("refused while held")
        mine.insert(region)
    late = other.stage(region)
    mine.insert(region)
    try:
        other.publish(late)
    except Outrun:
        held.append("refused when outrun")
    return mine.read().groupBy("r_regionkey").agg(F.count("*").alias("n"), F.lit(", ".join(held)).alias("what"))


def _databases(spark, sf_dir):
    spark.sql("CREATE DATABASE IF NOT EXISTS marlstone_demo COMMENT 'a schema'")
    made = spark.catalog.databaseExists("marlstone_demo")
    spark.sql("DROP DATABASE marlstone_demo")
    return spark.createDataFrame([(made, spark.catalog.databaseExists("marlstone_demo"))], "made boolean, left_ boolean")


def _mv_by_control(spark, sf_dir):
    """Refreshes the views that a control table enables, in its order, with an audit row for each."""
    r, audit = views.Registry(spark, {"orders": _t(spark, sf_dir, "orders")}), control.Audit()
    r.create(views.View("by_status", lambda b: b["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), ["orders"]))
    r.create(views.View("by_priority", lambda b: b["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("n")), ["orders"]))
    steps = {name: (lambda name=name: len(r.refresh(name)) and r.read(name).count()) for name in r.views}
    control.orchestrate(audit, "nightly", [(2, "by_priority", True), (1, "by_status", True)], steps)
    return audit.frame(spark).select("step", "status", "n")


def _mv_external(spark, sf_dir):
    """A view over files outside goes stale silently: it is refreshed by hand."""
    path = scratch(spark, "outside")
    nation = _t(spark, sf_dir, "nation")
    nation.filter("n_nationkey < 10").write.parquet(path)
    mv = Table(spark, scratch(spark, "mv")).overwrite(spark.read.parquet(path).groupBy("n_regionkey").count())
    nation.filter("n_nationkey >= 10").write.mode("append").parquet(path)
    before = mv.read().agg(F.sum("count")).first()[0]
    mv.overwrite(spark.read.parquet(path).groupBy("n_regionkey").count())
    return spark.createDataFrame([(before, mv.read().agg(F.sum("count")).first()[0])], "before_ long, after_ long")


def _cursor(spark, sf_dir):
    """A loop over a few control rows; data stay in the cluster."""
    names = [r["r_name"] for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").toLocalIterator()]
    return spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")


def _row_count(spark, sf_dir):
    """Rows written, counted while they are written."""
    seen, path = Observation(), scratch(spark, "observed")
    _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.createDataFrame([(int(seen.get["n"]),)], "n long")


def _raise(spark, sf_dir):
    """A failing step is logged, raised with its context, and leaves the table as it was."""
    t, audit = Table(spark, scratch(spark, "err")).overwrite(_t(spark, sf_dir, "region")), control.Audit()
    try:
        audit.step("b7", "insert", lambda: t.overwrite(t.read().selectExpr("CAST(r_name AS INT) AS r_regionkey", "r_name")))
        message = ""
    except control.StepError as e:
        message = str(e)
    return spark.createDataFrame([("step insert of batch b7" in message, t.read().count(), audit.rows[0][2])], "context boolean, n long, status string")


def _nested(spark, sf_dir):
    """A procedure that calls two others and gives back a frame."""
    audit = control.Audit()

    def load() -> int:
        return _t(spark, sf_dir, "nation").count()

    def everything() -> int:
        return (audit.step("b", "load", load) or 0) + (audit.step("b", "again", load) or 0)

    audit.step("b", "all", everything)
    return audit.frame(spark).select("step", "n")


def _stage_table(spark, sf_dir):
    """A shared intermediate is written once and read twice, where a CTE would run twice."""
    spent = Table(spark, scratch(spark, "stage")).overwrite(_t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))).read()
    top = spent.join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return top.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "o_custkey"))).filter("r <= 10").select("c_nationkey", "o_custkey", "r")


def _setting(spark, sf_dir):
    spark.conf.set("marlstone.batch", "b9")
    return spark.createDataFrame([(spark.conf.get("marlstone.batch"),)], "batch string")


def _roles(spark, sf_dir):
    r = Roles().grant("reader", "SELECT orders").grant("writer", "INSERT orders").grant_role("reader", "writer").grant_role("writer", "admin").grant_role("admin", "reader")
    return spark.createDataFrame([(who, r.may(who, "INSERT orders")) for who in ("reader", "writer", "admin", "nobody")], "role string, may_insert boolean")


def _log(spark, sf_dir):
    log = QueryLog()
    log.run("nations", _t(spark, sf_dir, "nation"))
    log.run("regions", _t(spark, sf_dir, "region"))
    return log.frame(spark).select("label", "n")


def _loads(spark, sf_dir):
    """Loads and exports leave rows in a log of their own."""
    path, log = scratch(spark, "log"), []
    for name in ("nation", "region"):
        df = _t(spark, sf_dir, name)
        sinks.unload(df, f"{path}/{name}")
        log.append((name, "unload", df.count()))
        log.append((name, "load", spark.read.parquet(f"{path}/{name}").count()))
    return spark.createDataFrame(log, "table_ string, what string, n long")


def _diagnose(spark, sf_dir):
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    good = diagnose(orders.join(F.broadcast(customer), F.col("o_custkey") == F.col("c_custkey")))
    bad = diagnose(orders.join(F.broadcast(customer), F.col("o_custkey") > F.col("c_custkey")))
    return spark.createDataFrame([(good["nested_loops"] > 0, bad["nested_loops"] > 0)], "good boolean, bad boolean")


def _metrics(spark, sf_dir):
    """Rebuild beside, check, swap."""
    orders = _t(spark, sf_dir, "orders")
    t = Table(spark, scratch(spark, "metrics")).overwrite(orders.limit(0).select("o_custkey", F.lit(0).cast("long").alias("n")))

    def sound(df):
        control.assert_unique(df, ["o_custkey"])

    return t.overwrite(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), check=sound).read()


def _lines(spark, sf_dir):
    """Sales lines with a fingerprint; repeated lines are stopped at the gate."""
    lines = _t(spark, sf_dir, "lineitem")
    keyed = lines.select(F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("line_id"), "l_orderkey")
    repeats = keyed.groupBy("line_id").count().filter("count > 1").count()
    return keyed.dropDuplicates(["line_id"]).agg(F.count("*").alias("n"), F.lit(repeats).cast("long").alias("repeats"))


def _copy_merge(spark, sf_dir):
    t, nation = Table(spark, scratch(spark, "cm")).overwrite(_t(spark, sf_dir, "nation").filter("n_nationkey < 20")), _t(spark, sf_dir, "nation")
    copy_then_merge(t, nation.filter("n_nationkey >= 15").withColumn("n_name", F.lower("n_name")), ["n_nationkey"])
    try:
        copy_then_merge(t, nation.limit(0), ["n_nationkey"])
        refused = False
    except ValueError:
        refused = True
    return t.read().withColumn("refused", F.lit(refused))


def _dedupe(spark, sf_dir):
    """The latest event of each user, ties broken by id: the same rows at every run."""
    events = _t(spark, sf_dir, "events")
    return latest_per_key(events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


def _active(spark, sf_dir):
    """Daily users on a dense calendar, with days of nobody."""
    events = _t(spark, sf_dir, "events").filter("event_type = 'purchase'")
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS d")
    return days.join(events.groupBy(F.to_date("ts").alias("d")).agg(F.countDistinct("user_id").alias("users")), "d", "left").select(F.col("d").cast("string").alias("d"), F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def _sketches(spark, sf_dir):
    """Built for all days, then again for three of them; users of the month come from the sketches alone."""
    events, table = _t(spark, sf_dir, "events"), Table(spark, scratch(spark, "sketches"))
    build_daily_sketches(table, events, "2024-01-01", "2024-12-31")
    again = build_daily_sketches(table, events, "2024-01-10", "2024-01-12")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    found = table.read().groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("value"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("guess"))
    return found.join(exact, "event_type").select("event_type", "n", "value", "users", (F.abs(F.col("guess") / F.col("users") - 1) < 0.1).alias("close"), F.lit(again).cast("long").alias("built_again"))


def _raise_pay(spark, sf_dir):
    """An update with its history: the old and new values add up."""
    staff = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("pay"))
    raised = staff.filter("s_suppkey % 4 = 0").select("s_suppkey", F.col("pay").alias("old"), (F.col("pay") + 100).cast("decimal(18,2)").alias("new"))
    t = Table(spark, scratch(spark, "pay")).overwrite(staff).merge(raised.select("s_suppkey", F.col("new").alias("pay")), ["s_suppkey"])
    moved = raised.agg(F.sum(F.col("new") - F.col("old"))).first()[0]
    total = t.read().agg(F.sum("pay")).first()[0] - staff.agg(F.sum("pay")).first()[0]
    return spark.createDataFrame([(raised.count(), moved == total)], "n long, consistent boolean")


def _elt(spark, sf_dir):
    """Typed rows from payloads, one day reloaded."""
    events = _t(spark, sf_dir, "events")
    typed = events.select("event_id", F.to_date("ts").alias("day"), F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    t = Table(spark, scratch(spark, "elt")).overwrite(typed.filter("k IS NOT NULL"))
    day = typed.filter("day = DATE '2024-01-10' AND k IS NOT NULL")
    return t.replace(F.col("day") == F.lit("2024-01-10").cast("date"), day).read().agg(F.count("*").alias("n"), F.max("k").alias("top"))


def _null_safe_scd2(spark, sf_dir):
    """NULL to value and value to NULL are changes; NULL to NULL is none."""
    begin, end, customer = F.lit("2020-01-01").cast("date"), F.lit(dimensions.FOREVER).cast("date"), _t(spark, sf_dir, "customer")
    v = lambda text: customer.select(F.col("c_custkey").alias("k"), F.expr(text).alias("v"))
    dim = v("CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END").withColumn("valid_from", begin).withColumn("valid_to", end).withColumn("is_current", F.lit(True))
    return dimensions.scd2(dim, v("CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END"), "k", ["v"], "2024-01-01").groupBy("k").agg(F.count("*").alias("n"))


def _score(spark, sf_dir):
    """A logistic model fitted by the engine's own library scores customers in one pass."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    rows = counts.withColumn("label", (F.col("n") < 10).cast("double")).withColumn("tens", F.col("n") / 10.0)
    model = LogisticRegression(maxIter=30).fit(VectorAssembler(inputCols=["tens"], outputCol="features").transform(rows).select("features", "label"))
    # a linear model scores as a plain expression, inside generated code
    churn = 1 / (1 + F.exp(-(F.col("tens") * float(model.coefficients[0]) + float(model.intercept))))
    found = rows.withColumn("right_", ((churn > 0.5).cast("double") == F.col("label")).cast("double"))
    return found.agg((F.avg("right_") > 0.95).alias("good"), F.count("*").alias("n"))


def _reports(spark, sf_dir):
    """Refreshes reports in order of dependence."""
    r = views.Registry(spark, {"orders": _t(spark, sf_dir, "orders")})
    r.create(views.View("base", lambda b: b["orders"].select("o_custkey", "o_orderstatus"), ["orders"]))
    r.create(views.View("mid", lambda b: b["base"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), ["base"]))
    r.create(views.View("top", lambda b: b["mid"].agg(F.sum("n").alias("n")), ["mid"]))
    return spark.createDataFrame([(k, name) for k, name in enumerate(r.refresh("top", cascade=True))], "k int, name string")


def _refused(spark, sf_dir):
    texts = ["SELECT k FROM t ORDER BY k", "SELECT k FROM t LIMIT 1", "SELECT k FROM t OFFSET 2", "SELECT k, min(v) FROM t GROUP BY k"]
    return spark.createDataFrame([(k, views.eligibility(x) == views.REFUSED) for k, x in enumerate(texts)], "k int, refused boolean")


def _team_cost(spark, sf_dir):
    """The cost of statements by the team that their comment names."""
    text = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("/* team="), F.col("event_type"), F.lit(" */ SELECT "), F.col("event_id"))).otherwise(F.concat(F.lit("SELECT "), F.col("event_id")))
    rows = _t(spark, sf_dir, "events").select(text.alias("text"), (F.col("event_id") % 10).alias("cost"))
    return rows.groupBy(F.coalesce(F.nullif(F.regexp_extract("text", r"team=(\w+)", 1), F.lit("")), F.lit("none")).alias("team")).agg(F.sum("cost").alias("cost"))


QUERIES = [
    Query("s04_register_partitions", _partitions, "SELECT after_, o_orderstatus, count(*) AS n FROM orders JOIN (VALUES ('F', 'F'), ('O', 'F'), ('O', 'O')) AS t(after_, s) ON s = o_orderstatus GROUP BY 1, 2"),
    Query("s26_store_items", _items, "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS qty FROM part"),
    Query("s27_shared_tables", _share, "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    Query("d18_table_lock", _lock, "SELECT r_regionkey, 3 * count(*) AS n, 'refused while held, refused when outrun' AS what FROM region GROUP BY 1"),
    Query("d26_schemas", _databases, "SELECT true AS made, false AS left_"),
    Query("v08_refused_definitions", _refused, "SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, false)) AS t(k, refused)"),
    Query("v14_refresh_by_control", _mv_by_control, "SELECT 'by_status' AS step, 'DONE' AS status, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'by_priority', 'DONE', count(DISTINCT o_orderpriority) FROM orders"),
    Query("v16_external_view", _mv_external, "SELECT count(CASE WHEN n_nationkey < 10 THEN 1 END) AS before_, count(*) AS after_ FROM nation"),
    Query("c05_cursor", _cursor, "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INT) AS k, r_name AS name FROM region"),
    Query("c08_row_count", _row_count, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    Query("c09_raise_with_context", _raise, "SELECT true AS context, count(*) AS n, 'FAILED' AS status FROM region"),
    Query("c13_nested_calls", _nested, "SELECT 'load' AS step, count(*) AS n FROM nation UNION ALL SELECT 'again', count(*) FROM nation UNION ALL SELECT 'all', 2 * count(*) FROM nation"),
    Query("c18_stage_table", _stage_table, "SELECT c_nationkey, o_custkey, CAST(r AS INT) AS r FROM (SELECT c_nationkey, o_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, o_custkey) AS r FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey) WHERE r <= 10"),
    Query("c20_session_setting", _setting, "SELECT 'b9' AS batch"),
    Query("y01_roles", _roles, "SELECT * FROM (VALUES ('reader', true), ('writer', true), ('admin', true), ('nobody', false)) AS t(role, may_insert)"),
    Query("b02_query_log", _log, "SELECT 'nations' AS label, count(*) AS n FROM nation UNION ALL SELECT 'regions', count(*) FROM region"),
    Query("b03_load_log", _loads, "SELECT t AS table_, what, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region) CROSS JOIN (VALUES ('unload'), ('load')) AS w(what)"),
    Query("b07_diagnose", _diagnose, "SELECT false AS good, true AS bad"),
    Query("e07_null_safe_scd2", _null_safe_scd2, "SELECT c_custkey AS k, CASE WHEN (c_custkey % 3 = 0) <> (c_custkey % 4 = 0) THEN CAST(2 AS BIGINT) ELSE 1 END AS n FROM customer"),
    Query("e11_metrics_rebuild", _metrics, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"),
    Query("e14_sales_lines", _lines, "SELECT count(DISTINCT line_id) AS n, CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1)) AS BIGINT) AS repeats FROM (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS line_id FROM lineitem)"),
    Query("e15_copy_then_merge", _copy_merge, "SELECT n_nationkey, CASE WHEN n_nationkey >= 15 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey, true AS refused FROM nation"),
    Query("e16_deterministic_dedup", _dedupe, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
    Query("e17_gap_filling", _active, "SELECT CAST(CAST(d AS DATE) AS STRING) AS d, count(DISTINCT user_id) AS users FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) AND event_type = 'purchase' GROUP BY 1"),
    same("e18_merchant_pivot", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS buys FROM {events} GROUP BY user_id"),
    Query("e19_update_with_history", _raise_pay, "SELECT count(*) AS n, true AS consistent FROM supplier WHERE s_suppkey % 4 = 0"),
    Query("e21_daily_sketches", _sketches, "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, count(DISTINCT user_id) AS users, true AS close, (SELECT count(DISTINCT (CAST(ts AS DATE), event_type)) FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS built_again FROM events GROUP BY 1"),
    Query("e23_events_elt", _elt, "SELECT count(*) AS n, CAST(max(CAST(json_extract_string(props, '$.k') AS INT)) AS INT) AS top FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"),
    Query("e36_report_refresh", _reports, "SELECT * FROM (VALUES (0, 'base'), (1, 'mid'), (2, 'top')) AS t(k, name)"),
    Query("e37_batch_scoring", _score, "SELECT true AS good, count(DISTINCT o_custkey) AS n FROM orders"),
    Query("e38_team_cost", _team_cost, "SELECT CASE WHEN event_id % 5 > 0 THEN event_type ELSE 'none' END AS team, CAST(sum(event_id % 10) AS BIGINT) AS cost FROM events GROUP BY 1"),
]
