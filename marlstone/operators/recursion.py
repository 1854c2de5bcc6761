"""Recursive queries over hierarchies held as edges, and the loop that stands in for very deep ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, bare, run_sql, same
from .joins import sized_broadcast

#: Suppliers as staff: number n reports to n / 3; parts of parts: number n holds 2n and 2n + 1; and links in loops.
_STAFF = "staff(id, name, boss, pay) AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey > 1 THEN CAST(floor(s_suppkey / 3) AS BIGINT) END, CAST(floor(s_acctbal) AS BIGINT) FROM {supplier} WHERE s_suppkey > 0)"
_PARTS = "bom(parent, child, qty) AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT), p_partkey, p_size % 3 + 1 FROM {part} WHERE p_partkey > 1)"
_LOOP = "edge(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM {nation} UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25 FROM {nation} WHERE n_nationkey % 4 = 0)"


def closure(edges: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """Nodes reached from ``start`` (node), level by level with a loop of joins: for depths beyond the recursion limit.

    Each level keeps only nodes not seen before, so cycles end and the work is one pass over the edges per level.
    """
    seen = start.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]).checkpoint()
    level = seen
    for depth in range(1, most + 1):
        level = level.join(edges, level.node == edges.a).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def exploded(edges: DataFrame, root: int, most: int = 100) -> DataFrame:
    """Every item under a root with the sum, over all ways to it, of the products of the quantities (parent, child, qty).

    Level by level: an item's ways of one length are added up before they go on, which leaves the sums as they are, so a
    level has a row for each of its items however many ways there are. More than ``most`` levels, as of a loop, are an error.
    The edges are dealt out and kept once, since every level reads them all.
    """
    edges = edges.withColumn("qty", F.col("qty").cast("long")).repartition("parent").checkpoint()
    level = edges.filter(F.col("parent") == root).groupBy(F.col("child").alias("item")).agg(F.sum("qty").alias("sum")).checkpoint()
    found, depth = level, 1
    while not level.isEmpty():
        if depth > most:
            raise RecursionError(f"more than {most} levels of parts under {root}")
        level = edges.join(sized_broadcast(level, 10_000), edges.parent == level.item).groupBy(F.col("child").alias("item")).agg(F.sum(F.col("sum") * F.col("qty")).alias("sum")).checkpoint()
        found, depth = found.unionByName(level), depth + 1
    return found.groupBy("item").agg(F.sum("sum").alias("qty"))


def _bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a recursive CTE as a loop: Spark ends the CTE at a million rows."""
    from ..plans.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return exploded(run_sql(spark, sf_dir, f"WITH {_PARTS} SELECT parent, child, qty FROM bom"), 1)


def _loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part hangs under the one of half its number, and some lead back up: steps from the first, loops and all."""
    from ..plans.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 1")
    edges = part.selectExpr("CAST(floor(p_partkey / 2) AS BIGINT) AS a", "p_partkey AS b").unionByName(part.filter("p_partkey % 9 = 0").selectExpr("p_partkey AS a", "CAST(floor(p_partkey / 9) AS BIGINT) AS b"))
    return closure(edges, spark.createDataFrame([(1,)], "node long"))


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT CAST(d AS STRING) AS d FROM (SELECT explode(sequence(DATE '2024-01-01', DATE '2027-12-31')) AS d)")


QUERIES = [
    Query("r01_date_spine", _spine, "SELECT CAST(CAST(d AS DATE) AS STRING) AS d FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2027-12-31', INTERVAL 1 DAY)) AS d)"),
    same("r01_recursive_spine", "WITH RECURSIVE s(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 90) SELECT n FROM s"),
    same("r02_upward_chain", f"WITH RECURSIVE {_STAFF}, up(id, name, boss, path, depth) AS (SELECT id, name, boss, name, 0 FROM staff WHERE id = 6 UNION ALL SELECT s.id, s.name, s.boss, concat(up.path, '>', s.name), up.depth + 1 FROM staff s JOIN up ON s.id = up.boss) SELECT id, path, depth FROM up"),
    same("r03_downward_subtree", f"""WITH RECURSIVE {_STAFF}, down(id, name, depth, pay) AS (SELECT id, name, 0, pay FROM staff WHERE id = 2 UNION ALL SELECT s.id, s.name, down.depth + 1, s.pay FROM staff s JOIN down ON s.boss = down.id)
          SELECT id, concat(repeat('  ', depth), name) AS label, depth, sum(pay) OVER () AS payroll FROM down"""),
    same("r04_closure_per_manager", f"""WITH RECURSIVE {_STAFF}, reach(top, id, pay) AS (SELECT id, id, pay FROM staff UNION ALL SELECT reach.top, s.id, s.pay FROM reach JOIN staff s ON s.boss = reach.id)
          SELECT top, count(*) - 1 AS team, sum(CASE WHEN id <> top THEN pay ELSE 0 END) AS team_pay FROM reach GROUP BY top"""),
    Query("r05_bill_of_materials", _bill, bare(f"""WITH RECURSIVE {_PARTS}, x(item, qty) AS (SELECT child, qty FROM bom WHERE parent = 1 UNION ALL SELECT b.child, x.qty * b.qty FROM x JOIN bom b ON b.parent = x.item) SELECT item, sum(qty) AS qty FROM x GROUP BY item""")),
    Query("r06_cycle_safe", f"""WITH RECURSIVE {_LOOP}, walk(node, seen, depth) AS (SELECT 1, array(1), 0 UNION ALL SELECT e.b, concat(seen, array(e.b)), depth + 1 FROM walk JOIN edge e ON e.a = node WHERE NOT array_contains(seen, e.b) AND depth < 20) SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
          bare(f"""WITH RECURSIVE {_LOOP}, walk(node, seen, depth) AS (SELECT 1, [1], 0 UNION ALL SELECT e.b, list_concat(seen, [e.b]), depth + 1 FROM walk JOIN edge e ON e.a = node WHERE NOT list_contains(seen, e.b) AND depth < 20) SELECT node, min(depth) AS depth FROM walk GROUP BY node""")),
    Query("r07_level_loop", _loop, "SELECT p_partkey AS node, CAST(floor(log2(p_partkey + 0.5)) AS INT) AS depth FROM part WHERE p_partkey > 0"),
    same("r08_view_dependencies", "WITH RECURSIVE dep(v, base) AS (SELECT * FROM (VALUES ('daily', 'orders'), ('weekly', 'daily'), ('report', 'weekly'), ('report', 'customer')) AS d(v, base)), r(v, base, depth) AS (SELECT v, base, 1 FROM dep UNION ALL SELECT r.v, dep.base, r.depth + 1 FROM r JOIN dep ON dep.v = r.base) SELECT v, base, depth FROM r"),
]
