"""Stored procedures as the warehouse has them: parameter modes, row types, transactions, whose rights count, result cursors,
audited steps, and MERGE statements that are generated as text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Query
from ..functions.dialect import quote_ident
from .control import Audit, exactly_one
from .security import Policies
from .tables import Table, scratch

_NONE = object()


@dataclass(frozen=True)
class Parameter:
    """IN takes a value, OUT gives one, INOUT does both; only IN and INOUT may have a default."""

    name: str
    mode: str = "IN"
    default: Any = _NONE


@dataclass(frozen=True)
class Procedure:
    """A named body over declared parameters. ``definer`` is the role whose rights count; without one the caller's do."""

    name: str
    parameters: tuple[Parameter, ...]
    body: Callable[..., dict[str, Any] | None]
    definer: str | None = None

    def call(self, caller: str = "public", **given: Any) -> dict[str, Any]:
        """Runs the body with the values of IN and INOUT parameters and the role in force; returns those of OUT and INOUT."""
        takes = {p.name: p for p in self.parameters if p.mode != "OUT"}
        if unknown := set(given) - set(takes):
            raise TypeError(f"{self.name} takes no {', '.join(sorted(unknown))}")
        values = {n: given.get(n, p.default) for n, p in takes.items()}
        if missing := [n for n, v in values.items() if v is _NONE]:
            raise TypeError(f"{self.name} needs {', '.join(missing)}")
        out = self.body(role=self.definer or caller, **values) or {}
        gives = [p.name for p in self.parameters if p.mode != "IN"]
        if unset := set(out) - set(gives):
            raise TypeError(f"{self.name} gives no {', '.join(sorted(unset))}")
        return {n: out.get(n, values.get(n)) for n in gives}


def column_type(df: DataFrame, column: str) -> T.DataType:
    """The type that %TYPE stands for."""
    return df.schema[column].dataType


def record_of(df: DataFrame, **values: Any) -> Row:
    """A row of the table's type (%ROWTYPE): values of its columns alone, others NULL."""
    if unknown := set(values) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return Row(**{c: values.get(c) for c in df.columns})


class Transaction:
    """Changes to several tables that are published together at the end, or not at all after an error.

    Each table's new version is staged as it comes; COMMIT moves the pointers one after the other.
    """

    def __init__(self) -> None:
        self._staged: list[tuple[Table, str]] = []

    def insert(self, table: Table, rows: DataFrame) -> None:
        held = table.manifest()
        schema = T.StructType.fromJson(held["schema"])
        self._staged.append((table, table._listed(held["files"] + table._written(table._shaped(rows, schema)), schema)))

    def replace(self, table: Table, rows: DataFrame) -> None:
        self._staged.append((table, table.stage(rows)))

    def commit(self) -> None:
        for table, version in self._staged:
            table.publish(version)
        self._staged.clear()

    def rollback(self) -> None:
        self._staged.clear()  # staged files go with the next vacuum

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.commit() if kind is None else self.rollback()


class Cursor:
    """A result that the caller fetches in portions; rows come partition by partition, never all at once."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        self._rows: Iterator[Row] = df.toLocalIterator()

    def fetch(self, n: int) -> list[Row]:
        return [r for _, r in zip(range(n), self._rows)]


def merge_statement(target: str, source: str, keys: list[str], columns: list[str]) -> str:
    """MERGE text for an upsert of all columns by some keys, names quoted."""
    q = quote_ident
    on = " AND ".join(f"{q(target)}.{q(k)} = {q(source)}.{q(k)}" for k in keys)
    sets = ", ".join(f"{q(c)} = {q(source)}.{q(c)}" for c in columns if c not in keys)
    return f"MERGE INTO {q(target)} USING {q(source)} ON {on} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f'{q(source)}.{q(c)}' for c in columns)})"


_NAME = r"(?:\"(?:[^\"]|\"\")+\"|`(?:[^`]|``)+`|\w+)"
_MERGE = re.compile(rf"\s*MERGE\s+INTO\s+({_NAME})\s+USING\s+({_NAME})\s+ON\s+(.+?)\s+WHEN\s+MATCHED\s+THEN\s+UPDATE\s+SET\s+(.+?)\s+WHEN\s+NOT\s+MATCHED\s+THEN\s+INSERT\s*\((.+?)\)\s*VALUES\s*\((.+?)\)\s*;?\s*\Z", re.I | re.S)


def run_merge(text: str, targets: dict[str, Table], sources: dict[str, DataFrame]) -> Table:
    """Executes a MERGE of the warehouse's grammar: one WHEN MATCHED THEN UPDATE, one WHEN NOT MATCHED THEN INSERT.

    The grammar has no alias for the target and no condition beside MATCHED; both are refused.
    """
    if re.search(r"\bWHEN\s+(?:NOT\s+)?MATCHED\s+AND\b", text, re.I):
        raise SyntaxError("WHEN MATCHED takes no further condition")
    if re.search(rf"\bINTO\s+{_NAME}\s+(?:AS\s+)?(?!USING\b){_NAME}\s+USING\b", text, re.I):
        raise SyntaxError("the target of a MERGE has no alias")
    m = _MERGE.match(text)
    if not m:
        raise SyntaxError("not a MERGE of this grammar")
    bare = lambda n: n.strip().strip('`"').replace("``", "`").replace('""', '"')
    last = lambda n: bare(re.findall(_NAME, n)[-1])
    target, source = targets[bare(m[1])], sources[bare(m[2])]
    keys = [last(pair.split("=")[0]) for pair in re.split(r"\s+AND\s+", m[3], flags=re.I)]
    updated = {last(p.split("=")[0]): last(p.split("=")[1]) for p in m[4].split(",")}
    inserted = dict(zip(map(last, m[5].split(",")), map(last, m[6].split(","))))
    held = target.read()
    beside = source.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"__new_{c}") for c in {*updated.values(), *inserted.values()}))
    # a matched row takes the updated columns and keeps the rest, so it is built from both sides
    matched = held.join(beside, keys, "inner").select(*((F.col(f"__new_{updated[c]}") if c in updated else F.col(c)).alias(c) for c in held.columns))
    fresh = source.join(held.select(*keys), keys, "left_anti").select(*((F.col(inserted[c]) if c in inserted else F.lit(None)).alias(c) for c in held.columns))
    return target.merge(matched.unionByName(fresh, allowMissingColumns=True), keys)


@dataclass
class StepLog(Audit):
    """An audit whose steps are procedures' statements with a batch window."""

    procedure: str = ""
    window: str = ""
    seen: list[str] = field(default_factory=list)

    def run(self, name: str, body: Callable[[], int | None]) -> int | None:
        self.seen.append(name)
        return self.step(self.window, name, body)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parameters(spark, sf_dir):
    """How many orders a status has (OUT), and a discount that grows for large ones (INOUT, with a default)."""
    orders = _t(spark, sf_dir, "orders")

    def body(role, status, least, discount):
        n = orders.filter(F.col("o_orderstatus") == status).count()
        return {"n": n, "discount": discount + (0.15 if n > least else 0.0)}

    p = Procedure("order_discount", (Parameter("status"), Parameter("least", default=1000), Parameter("n", "OUT"), Parameter("discount", "INOUT", 0.05)), body)
    out = [(s, least, *p.call(status=s, least=least).values()) for s in ("F", "O", "P") for least in (0, 1000)]
    out.append(("F", 1000, *p.call(status="F", discount=0.5).values()))
    return spark.createDataFrame(out, "status string, least int, n long, discount double").withColumn("discount", F.round("discount", 2))


def _row_types(spark, sf_dir):
    """The dearest order as a record of the table's row type, and a variable of one column's type."""
    orders = _t(spark, sf_dir, "orders")
    top = exactly_one(orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1))
    kept = record_of(orders, o_orderkey=top["o_orderkey"], o_totalprice=top["o_totalprice"])
    schema = T.StructType([T.StructField(c, column_type(orders, c)) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")])
    return spark.createDataFrame([tuple(kept[c] for c in schema.names)], schema)


def _branches(spark, sf_dir):
    def grade(n: int, total: int) -> str:
        if n * 10 >= total * 4:
            return "major"
        elif n * 10 >= total:
            return "minor"
        return "rare"

    counts = {r["o_orderstatus"]: r["count"] for r in _t(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()}
    return spark.createDataFrame([(s, grade(n, sum(counts.values()))) for s, n in sorted(counts.items())], "status string, grade string")


def _commit(spark, sf_dir):
    """Two tables change together; an error in between leaves both as they were, and what was committed before stays."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    by = lambda s: orders.filter(F.col("o_orderstatus") == s)
    a, b = (Table(spark, scratch(spark, n)).overwrite(by("F")) for n in "ab")
    with Transaction() as t:
        t.insert(a, by("O"))
        t.insert(b, by("O"))
    try:
        with Transaction() as t:
            t.insert(a, by("P"))
            raise ZeroDivisionError
    except ZeroDivisionError:
        pass
    return a.read().groupBy("o_orderstatus").agg(F.count("*").alias("a")).join(b.read().groupBy("o_orderstatus").agg(F.count("*").alias("b")), "o_orderstatus", "full")


def _rights(spark, sf_dir):
    """The same body sees all customers under its owner's rights and a clerk's own under the caller's."""
    customer = _t(spark, sf_dir, "customer")
    p = Policies().grant("owner", "customer", ["c_custkey"]).attach_rows("owner", "customer", F.lit(True)).grant("clerk", "customer", ["c_custkey"]).attach_rows("clerk", "customer", F.col("c_nationkey") == 3)
    body = lambda role: {"n": p.view(role, "customer", customer).count()}
    out = [(mode, Procedure("customers", (Parameter("n", "OUT"),), body, definer).call("clerk")["n"]) for mode, definer in (("DEFINER", "owner"), ("INVOKER", None))]
    try:
        Procedure("customers", (Parameter("n", "OUT"),), body).call("nobody")
    except PermissionError:
        out.append(("REFUSED", 0))
    return spark.createDataFrame(out, "mode string, n long")


def _refcursor(spark, sf_dir):
    """A procedure opens a cursor; its caller fetches two rows at a time."""
    opened = lambda role: {"result": Cursor(_t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority"))}
    cursor, out, portion = Procedure("by_priority", (Parameter("result", "OUT"),), opened).call()["result"], [], 0
    while rows := cursor.fetch(2):
        out += [(portion, r["o_orderpriority"], r["n"]) for r in rows]
        portion += 1
    return spark.createDataFrame(out, "portion int, o_orderpriority string, n long")


def _step_audit(spark, sf_dir):
    """Delete, insert and analyse, each with its rows, status and duration."""
    orders = _t(spark, sf_dir, "orders")
    changes = orders.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    table, log = Table(spark, scratch(spark, "audited")).overwrite(orders), StepLog(procedure="reload", window="w1")

    def delete():
        before = table.read().count()
        return before - table.delete_using(changes, ["o_orderkey"]).read().count()

    def insert():
        before = table.read().count()
        return table.insert(changes).read().count() - before

    for name, body in (("1. delete", delete), ("2. insert", insert), ("3. analyse", lambda: table.read().summary("count").count() * 0)):
        log.run(name, body)
    return log.frame(spark).select("step", "status", "n", (F.col("seconds") > 0).alias("timed"))


def _changes(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders, orders.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(orders.filter("o_orderkey % 10 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))


def _generated(spark, sf_dir):
    orders, changes = _changes(spark, sf_dir)
    t = Table(spark, scratch(spark, "gen")).overwrite(orders)
    run_merge(merge_statement("orders", "delta", ["o_orderkey"], orders.columns), {"orders": t}, {"delta": changes})
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _grammar(spark, sf_dir):
    """A column that UPDATE does not name stays; an alias and a condition are refused; nothing is changed by these."""
    orders, changes = _changes(spark, sf_dir)
    t, refused = Table(spark, scratch(spark, "grammar")).overwrite(orders), []
    good = "MERGE INTO orders USING delta ON orders.o_orderkey = delta.o_orderkey WHEN MATCHED THEN UPDATE SET o_orderstatus = delta.o_orderstatus WHEN NOT MATCHED THEN INSERT (o_orderkey, o_orderstatus) VALUES (delta.o_orderkey, delta.o_orderstatus)"
    for text in (good.replace("INTO orders USING", "INTO orders AS o USING"), good.replace("WHEN MATCHED THEN", "WHEN MATCHED AND delta.o_custkey > 5 THEN"), "MERGE orders"):
        try:
            run_merge(text, {"orders": t}, {"delta": changes})
        except SyntaxError:
            refused.append(text)
    run_merge(good, {"orders": t}, {"delta": changes})
    return t.read().agg(F.count("*").alias("n"), F.count("o_custkey").alias("with_customer"), F.sum((F.col("o_orderstatus") == "X").cast("long")).alias("changed"), F.lit(len(refused)).alias("refused"))


_MERGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders UNION ALL SELECT -o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderkey % 10 = 1"

QUERIES = [
    Query("c01_procedure_parameters", _parameters, """SELECT s AS status, CAST(least AS INT) AS least, n, round(0.05 + CASE WHEN n > least THEN 0.15 ELSE 0 END, 2)::DOUBLE AS discount FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) CROSS JOIN (VALUES (0), (1000)) AS t(least)
          UNION ALL SELECT 'F', 1000, count(*), CASE WHEN count(*) > 1000 THEN 0.65 ELSE 0.5 END FROM orders WHERE o_orderstatus = 'F'"""),
    Query("c02_row_types", _row_types, "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    Query("c03_branches", _branches, "SELECT o_orderstatus AS status, CASE WHEN count(*) * 10 >= t.total * 4 THEN 'major' WHEN count(*) * 10 >= t.total THEN 'minor' ELSE 'rare' END AS grade FROM orders CROSS JOIN (SELECT count(*) AS total FROM orders) t GROUP BY 1, t.total"),
    Query("c10_commit_rollback", _commit, "SELECT o_orderstatus, count(*) AS a, count(*) AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
    Query("c11_definer_invoker", _rights, "SELECT 'DEFINER' AS mode, count(*) AS n FROM customer UNION ALL SELECT 'INVOKER', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'REFUSED', 0"),
    Query("c12_refcursor", _refcursor, "SELECT CAST((row_number() OVER (ORDER BY o_orderpriority) - 1) // 2 AS INT) AS portion, o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)"),
    Query("c15_step_audit", _step_audit, "SELECT s AS step, 'DONE' AS status, CASE WHEN s LIKE '3%' THEN 0 ELSE n END AS n, true AS timed FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 = 0) CROSS JOIN (VALUES ('1. delete'), ('2. insert'), ('3. analyse')) AS t(s)"),
    Query("d11_generated_merge", _generated, f"SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM ({_MERGED}) GROUP BY 1"),
    Query("d12_merge_grammar", _grammar, f"SELECT count(*) AS n, count(o_custkey) AS with_customer, CAST(sum(CASE WHEN o_orderstatus = 'X' THEN 1 ELSE 0 END) AS BIGINT) AS changed, 3 AS refused FROM ({_MERGED})"),
]
