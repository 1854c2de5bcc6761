"""Views and materialised views: eligibility, incremental state, cascades, staleness, and a result cache."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..catalog import Query, same
from .security import Policies
from .tables import Table, scratch

INCREMENTAL, FULL, REFUSED = "INCREMENTAL", "FULL", "REFUSED"
#: What a definition may hold, by what it costs. Fixed rules of the warehouse's refresh documentation.
_REFUSED = (r"\border\s+by\b(?![^()]*\))", r"\blimit\b", r"\boffset\b")
_FULL = (r"\bover\s*\(", r"count\s*\(\s*distinct", r"\bapprox", r"\bhll_", r"\bmedian\s*\(", r"\bpercentile", r"\blistagg\s*\(", r"\bstddev", r"\b(left|right|full)\b[^()]*\bjoin\b", r"\bunion\b", r"\bintersect\b", r"\bexcept\b", r"\b(in|exists)\s*\(\s*select\b", r"\(\s*select\b")
_VOLATILE = (r"\b(now|current_date|current_timestamp|rand|random|uuid|getdate|sysdate)\b",)


def eligibility(text: str) -> str:
    """How a definition can be refreshed: by its changes, by a full rebuild, or not at all."""
    low = re.sub(r"\s+", " ", re.sub(r"'[^']*'", "''", text.lower()))
    if any(re.search(p, low) for p in _REFUSED):
        return REFUSED
    return FULL if any(re.search(p, low) for p in _FULL + _VOLATILE) else INCREMENTAL


def may_refresh_itself(text: str, bases: list[str], external: set[str] = frozenset(), views: set[str] = frozenset()) -> bool:
    """Automatic refresh needs stable functions, local tables and no view below."""
    return eligibility(text) != REFUSED and not any(re.search(p, text.lower()) for p in _VOLATILE) and not (set(bases) & (set(external) | set(views)))


@dataclass
class IncrementalAggregate:
    """SUM, COUNT, MIN, MAX and AVG by keys, kept as mergeable state: AVG as a sum and a count."""

    table: Table
    keys: list[str]
    value: str

    def _partial(self, df: DataFrame) -> DataFrame:
        v = F.col(self.value)
        return df.groupBy(*self.keys).agg(F.sum(v).alias("s"), F.count(v).alias("c"), F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))

    def create(self, df: DataFrame) -> "IncrementalAggregate":
        self.table.overwrite(self._partial(df))
        return self

    def refresh(self, added: DataFrame) -> "IncrementalAggregate":
        """Merges the state of the new rows in: the base is not read again, and of the view only the keys that changed."""
        held, new = self.table.read(), self._partial(added)
        both = held.join(new.select(*self.keys), self.keys, "left_semi").unionByName(new)
        self.table.merge(both.groupBy(*self.keys).agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), self.keys)
        return self

    def read(self) -> DataFrame:
        return self.table.read().select(*self.keys, F.col("s").alias("total"), F.col("n"), F.col("lo"), F.col("hi"), (F.col("s") / F.col("c")).alias("mean"))


@dataclass
class View:
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    bases: list[str]
    schemas: dict[str, StructType] = field(default_factory=dict)
    refreshed: int = 0


#: What makes a view unrefreshable, by code. Fixed values of the warehouse's view states.
BROKEN = {101: "a base column was dropped", 102: "a base column type changed", 103: "a base table was renamed", 104: "a base column was renamed", 105: "a schema was renamed"}


class Registry:
    """Materialised views over tables and each other: refreshed in order of dependence, broken by changes below."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], policies: Policies | None = None):
        self.spark, self.tables, self.views, self.stored, self.clock, self.policies = spark, dict(tables), {}, {}, 0, policies
        self.changed: dict[str, int] = {}

    def change(self, base: str, df: DataFrame) -> None:
        """A base's rows or columns are others from now on."""
        self.clock += 1
        self.tables[base], self.changed[base] = df, self.clock

    def create(self, view: View, leaks: bool = False) -> None:
        """Builds a view. One over a table with row policies or masks stores rows that no policy filters: it is refused."""
        if self.policies and not leaks and any(self.policies.protects(b) for b in view.bases):
            raise PermissionError(f"{view.name} would leak past a policy")
        missing = [b for b in view.bases if b not in self.tables and b not in self.views]
        if missing:
            raise ValueError(f"unknown tables: {missing}")
        self.views[view.name] = view
        self.refresh(view.name)

    def state(self, name: str) -> str:
        """FRESH, STALE (a base was refreshed since) or BROKEN (a base has lost or changed its columns)."""
        view = self.views[name]
        if self.code(name):
            return "BROKEN"
        return "STALE" if any((self.views[b].refreshed if b in self.views else self.changed.get(b, 0)) > view.refreshed for b in view.bases) else "FRESH"

    def code(self, name: str) -> int:
        """0, or why the view cannot be refreshed any more (see ``BROKEN``); it can still be read."""
        for base, was in self.views[name].schemas.items():
            if base not in self.tables and base not in self.views:
                schema, _, table = base.rpartition(".")
                return 105 if schema and any(t.rpartition(".")[2] == table and t.rpartition(".")[0] != schema for t in self.tables) else 103
            now = self._schema(base)
            gone, new = [f for f in was if f.name not in now.names], [f for f in now if f.name not in was.names]
            if gone:
                # one of the same type in the same place is the old column under another name
                return 104 if any(now.names.index(n.name) == was.names.index(g.name) and n.dataType == g.dataType for g in gone for n in new) else 101
            if any(now[f.name].dataType != f.dataType for f in was):
                return 102
        return 0

    def _schema(self, base: str) -> StructType:
        return (self.stored[base].read() if base in self.views else self.tables[base]).schema

    def inventory(self) -> list[tuple[str, str]]:
        """Objects by name and kind."""
        return [(n, "table") for n in sorted(self.tables)] + [(n, "matview") for n in sorted(self.views)]

    def dependencies(self) -> list[tuple[str, str]]:
        """What each view reads: (source, dependent)."""
        return sorted((b, v.name) for v in self.views.values() for b in v.bases)

    def order(self, name: str) -> list[str]:
        """The view and all below it, each after what it reads."""
        out: list[str] = []
        for b in self.views[name].bases:
            if b in self.views:
                out += [v for v in self.order(b) if v not in out]
        return [*out, name]

    def refresh(self, name: str, cascade: bool = False) -> list[str]:
        done = self.order(name) if cascade else [name]
        for v in done:
            if self.views[v].refreshed and self.code(v):
                raise ValueError(f"{v} cannot be refreshed: {BROKEN[self.code(v)]}")
            view = self.views[v]
            bases = {b: self.stored[b].read() if b in self.views else self.tables[b] for b in view.bases}
            table = self.stored.setdefault(v, Table(self.spark, scratch(self.spark, f"mv-{v}")))
            table.overwrite(view.build(bases))
            self.clock += 1
            view.refreshed, view.schemas = self.clock, {b: df.schema for b, df in bases.items()}
        return done

    def read(self, name: str) -> DataFrame:
        return self.stored[name].read()


class ResultCache:
    """Results by query text and the versions of the tables that it reads; volatile queries are never kept."""

    def __init__(self):
        self._held, self.hits = {}, 0

    def run(self, text: str, versions: tuple, build: Callable[[], list]) -> list:
        if any(re.search(p, text.lower()) for p in _VOLATILE):
            return build()
        key = (" ".join(text.split()), versions)
        if key in self._held:
            self.hits += 1
        else:
            self._held[key] = build()
        return self._held[key]


class Rollups:
    """Answers SUM, COUNT, MIN and MAX by some keys from the smallest rollup that holds them, or from the base.

    A rollup is an aggregate by more keys; its sums and counts add up, its extremes are extremes of extremes. One that is
    older than the base answers nothing.
    """

    def __init__(self, spark: SparkSession, base: DataFrame, value: str):
        self.spark, self.base, self.value, self.version = spark, base, value, 0
        self._held: list[tuple[frozenset[str], IncrementalAggregate, int, int]] = []

    def add(self, keys: list[str]) -> "Rollups":
        made = IncrementalAggregate(Table(self.spark, scratch(self.spark, "rollup")), keys, self.value).create(self.base)
        self._held.append((frozenset(keys), made, made.table.read().count(), self.version))
        return self

    def change(self, base: DataFrame) -> "Rollups":
        self.base, self.version = base, self.version + 1
        return self

    def answer(self, keys: list[str]) -> tuple[str, DataFrame]:
        """The rollup that answers, by its keys (or 'base'), and its answer."""
        fit = [(n, sorted(k), mv) for k, mv, n, version in self._held if set(keys) <= k and version == self.version]
        if not fit:
            v = F.col(self.value)
            return "base", self.base.groupBy(*keys).agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        _, by, mv = min(fit, key=lambda f: f[:2])
        rows = mv.table.read().groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return ",".join(by), rows


def _bound(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    df.createOrReplaceTempView("marlstone_v1")
    bound = spark.table("marlstone_v1")
    late = lambda: spark.table("marlstone_v1")
    df.filter("n_nationkey < 5").createOrReplaceTempView("marlstone_v1")
    return spark.createDataFrame([(bound.count(), late().count())], "bound long, late long")


def _incremental(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    mv = IncrementalAggregate(Table(spark, scratch(spark, "mv")), ["o_orderstatus"], "v").create(orders.filter("o_orderkey % 3 <> 0"))
    mv.refresh(orders.filter("o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")).refresh(orders.filter("o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0"))
    return mv.read().select("o_orderstatus", F.col("total").cast("double").alias("total"), "n", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.round(F.col("mean").cast("double"), 3).alias("mean"))


_TEXTS = [("SELECT k, sum(v) FROM t GROUP BY k", INCREMENTAL), ("SELECT k, count(DISTINCT v) FROM t GROUP BY k", FULL), ("SELECT k, sum(v) OVER (ORDER BY k) FROM t", FULL), ("SELECT a.k FROM a LEFT JOIN b ON a.k = b.k", FULL),
          ("SELECT k FROM a UNION SELECT k FROM b", FULL), ("SELECT k FROM a WHERE k IN (SELECT k FROM b)", FULL), ("SELECT k FROM t ORDER BY k LIMIT 5", REFUSED), ("SELECT a.k, avg(v) FROM a JOIN b ON a.k = b.k GROUP BY a.k HAVING avg(v) > 1", INCREMENTAL)]


def _rules(spark, sf_dir):
    return spark.createDataFrame([(i, eligibility(t)) for i, (t, _) in enumerate(_TEXTS)], "i int, kind string")


def _auto(spark, sf_dir):
    plain = "SELECT k, sum(v) FROM t GROUP BY k"
    return spark.createDataFrame([(may_refresh_itself(plain, ["t"]), may_refresh_itself(plain, ["t"], external={"t"}), may_refresh_itself(plain, ["t"], views={"t"}), may_refresh_itself("SELECT now() FROM t", ["t"]))], "plain boolean, external boolean, nested boolean, volatile boolean")


def _cascade(spark, sf_dir):
    r = Registry(spark, {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")})
    r.create(View("daily", lambda b: b["orders"].groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n")), ["orders"]))
    r.create(View("monthly", lambda b: b["daily"].groupBy(F.trunc("d", "month").alias("m")).agg(F.sum("n").alias("n")), ["daily"]))
    states = [r.state("monthly")]
    r.refresh("daily")
    states.append(r.state("monthly"))
    done = r.refresh("monthly", cascade=True)
    states.append(r.state("monthly"))
    r.change("orders", r.tables["orders"].drop("o_orderdate"))
    states.append(r.state("daily"))
    return spark.createDataFrame([(">".join(done), ",".join(states), r.read("monthly").agg(F.sum("n")).first()[0])], "done string, states string, n long")


def _cache(spark, sf_dir):
    cache, ran = ResultCache(), []
    for text, version in (("SELECT 1", 1), ("SELECT  1", 1), ("SELECT 1", 2), ("SELECT now()", 1), ("SELECT now()", 1)):
        cache.run(text, (version,), lambda: ran.append(1) or [1])
    return spark.createDataFrame([(cache.hits, len(ran))], "hits int, ran int")


def _created(spark, sf_dir):
    """A view shows its rows of the last refresh until the next one."""
    orders, counts = spark.read.parquet(f"{sf_dir}/orders.parquet"), []
    r = Registry(spark, {"orders": orders.filter("o_orderkey % 2 = 0")})
    r.create(View("by_status", lambda b: b["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), ["orders"]))
    for change in (None, orders, None):
        if change is not None:
            r.change("orders", change)
        elif counts:
            r.refresh("by_status")
        counts.append((len(counts), r.state("by_status"), r.read("by_status").agg(F.sum("n")).first()[0]))
    return spark.createDataFrame(counts, "step int, state string, n long")


def _broken(spark, sf_dir):
    """Every change of a base that ends refreshing, its code, and that the view can still be read."""
    orders, out = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), []
    changes = {
        "none": lambda t: t["s.orders"].filter("o_orderkey > 5"),
        "drop": lambda t: t["s.orders"].drop("o_totalprice"),
        "type": lambda t: t["s.orders"].withColumn("o_totalprice", F.col("o_totalprice").cast("string")),
        "rename column": lambda t: t["s.orders"].withColumnRenamed("o_totalprice", "price"),
        "rename table": lambda t: t.update({"s.sales": t.pop("s.orders")}),
        "rename schema": lambda t: t.update({"archive.orders": t.pop("s.orders")}),
    }
    for what, change in changes.items():
        r = Registry(spark, {"s.orders": orders})
        r.create(View("mv", lambda b: b["s.orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), ["s.orders"]))
        made = change(r.tables)
        if made is not None:
            r.change("s.orders", made)
        try:
            refreshed = bool(r.refresh("mv"))
        except (ValueError, KeyError):
            refreshed = False
        out.append((what, r.code("mv"), refreshed, r.read("mv").count()))
    return spark.createDataFrame(out, "what string, code int, refreshed boolean, groups_ long")


def _rewritten(spark, sf_dir):
    """Totals come from a rollup where one is fresh and fine enough, and are the same wherever they come from."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    held, out = Rollups(spark, orders, "v").add(["o_orderstatus", "o_orderpriority"]).add(["o_orderstatus", "o_orderpriority", "o_custkey"]), None
    asked = [held.answer(["o_orderstatus"]), held.answer(["o_orderstatus", "o_custkey"])]
    asked.append(held.change(orders).answer(["o_orderstatus"]))
    for source, rows in asked:
        one = rows.groupBy("o_orderstatus").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"), F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi")).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out


def _leak(spark, sf_dir):
    """A view over a table with row policies is refused; one that is forced holds what the policy hides."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    p = Policies().grant("clerk", "customer", ["c_custkey"]).attach_rows("clerk", "customer", F.col("c_nationkey") == 3)
    r, mv = Registry(spark, {"customer": customer}, p), View("mv", lambda b: b["customer"].select("c_custkey"), ["customer"])
    try:
        r.create(mv)
        refused = False
    except PermissionError:
        refused = True
    r.create(mv, leaks=True)
    return spark.createDataFrame([(refused, p.view("clerk", "customer", customer).count(), r.read("mv").count())], "refused boolean, by_policy long, in_view long")


def _nightly(spark, sf_dir) -> Registry:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    r = Registry(spark, {"orders": orders, "customer": customer})
    r.create(View("spent", lambda b: b["orders"].groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v")), ["orders"]))
    r.create(View("by_segment", lambda b: b["spent"].join(b["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("v").alias("v")), ["spent", "customer"]))
    return r


def _inventory(spark, sf_dir):
    """Objects by kind, with the rows of each."""
    r = _nightly(spark, sf_dir)
    return spark.createDataFrame([(n, kind, (r.tables[n] if kind == "table" else r.read(n)).count()) for n, kind in r.inventory()], "name string, kind string, n long")


def _dependencies(spark, sf_dir):
    """What reads what, and how many rows a change of the source would have the dependent read again."""
    r = _nightly(spark, sf_dir)
    return spark.createDataFrame([(a, b, (r.tables[a] if a in r.tables else r.read(a)).count()) for a, b in r.dependencies()], "source string, dependent string, n long")


QUERIES = [
    Query("v04_create_and_refresh", _created, "SELECT 0 AS step, 'FRESH' AS state, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, 'STALE', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, 'FRESH', count(*) FROM orders"),
    Query("v10_broken_states", _broken, "SELECT what, CAST(code AS INT) AS code, code = 0 AS refreshed, g AS groups_ FROM (VALUES ('none', 0), ('drop', 101), ('type', 102), ('rename column', 104), ('rename table', 103), ('rename schema', 105)) AS t(what, code) CROSS JOIN (SELECT count(DISTINCT o_orderstatus) AS g FROM orders)"),
    Query("v12_query_rewrite", _rewritten, "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, source FROM orders CROSS JOIN (VALUES ('o_orderpriority,o_orderstatus'), ('o_custkey,o_orderpriority,o_orderstatus'), ('base')) AS t(source) GROUP BY o_orderstatus, source"),
    Query("y05_view_leak", _leak, "SELECT true AS refused, count(CASE WHEN c_nationkey = 3 THEN 1 END) AS by_policy, count(*) AS in_view FROM customer"),
    Query("b04_inventory", _inventory, """SELECT 'orders' AS name, 'table' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'customer', 'table', count(*) FROM customer UNION ALL SELECT 'spent', 'matview', count(DISTINCT o_custkey) FROM orders
          UNION ALL SELECT 'by_segment', 'matview', count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey"""),
    Query("b04_dependencies", _dependencies, "SELECT 'orders' AS source, 'spent' AS dependent, count(*) AS n FROM orders UNION ALL SELECT 'customer', 'by_segment', count(*) FROM customer UNION ALL SELECT 'spent', 'by_segment', count(DISTINCT o_custkey) FROM orders"),
    Query("v01_bound_and_late_views", _bound, "SELECT count(*) AS bound, count(CASE WHEN n_nationkey < 5 THEN 1 END) AS late FROM nation"),
    same("v03_bi_view", "SELECT n_name AS nation_, CAST(extract(year FROM o_orderdate) AS INT) AS year_, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2"),
    Query("v05_incremental_refresh", _incremental, "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3) AS mean FROM orders GROUP BY 1"),
    Query("v06_eligibility", _rules, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(_TEXTS)) + ") AS t(i, kind)"),
    Query("v07_auto_refresh_rules", _auto, "SELECT true AS plain, false AS external, false AS nested, false AS volatile"),
    Query("v09_cascade", _cascade, "SELECT 'daily>monthly' AS done, 'FRESH,STALE,FRESH,BROKEN' AS states, (SELECT count(*) FROM orders) AS n"),
    same("v11_finer_grain", "SELECT d_month, count(*) AS customers, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS d_month, o_custkey, count(*) AS n FROM {orders} GROUP BY 1, 2) t GROUP BY d_month"),
    same("v11_join_for_in", "SELECT count(*) AS n FROM {orders} JOIN (SELECT DISTINCT c_custkey FROM {customer} WHERE c_acctbal > 5000) c ON o_custkey = c_custkey"),
    Query("v17_result_cache", _cache, "SELECT 1 AS hits, 4 AS ran"),
]
