"""Helpers that queries do not reach."""

import datetime
import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone import catalog
from marlstone.functions import dialect, geometry
from marlstone.operators.joins import bucketed, bucketed_range_join, sized_broadcast
from marlstone.operators.recursion import exploded
from marlstone.operators.windows import ranked
from marlstone.plans import control, views
from marlstone.plans.security import Policies
from marlstone.plans.tables import Outrun, Table, TableLocked, ensure_checkpoint_dir, scratch

from .oracle import FOLDER, compare, connect

#: Runs a query where executors are processes of their own, as on a cluster, and prints its rows.
APART = """
import json, sys
from pyspark.sql import SparkSession
from marlstone import catalog
name, sf_dir, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": shared}
print(json.dumps([list(r) for r in catalog.queries()[name](SparkSession.builder.config(map=conf).getOrCreate(), sf_dir).collect()]))
"""


def test_datediff_counts_boundaries(spark):
    row = spark.createDataFrame([("2023-12-31 23:59:59", "2024-01-01 00:00:01")], "a string, b string").select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in "ab"))
    found = row.select(*(dialect.datediff(p, F.col("a"), F.col("b")).alias(p) for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"))).first()
    assert tuple(found) == (1, 1, 1, 0, 1, 1, 1, 2)


def test_month_end_stays_month_end(spark):
    row = spark.createDataFrame([("2026-02-28",), ("2026-08-31",)], "d string").select(dialect.add_months_end(F.to_date("d"), 1).alias("d")).collect()
    assert [r["d"] for r in row] == [datetime.date(2026, 3, 31), datetime.date(2026, 9, 30)]


def test_quoting_survives(spark):
    text = "a'b\\c`d"
    assert spark.sql(f"SELECT {dialect.quote_literal(text)} AS {dialect.quote_ident('x`y')}").first()[0] == text


def test_range_join_equals_brute_force(spark):
    facts = spark.range(200).select((F.col("id") * 7 % 113).cast("double").alias("v"))
    bands = spark.createDataFrame([(k, k * 10.0, k * 10.0 + 13) for k in range(10)], "band int, lo double, hi double")
    got = bucketed_range_join(facts, bands, "v", "lo", "hi", 13.0).groupBy("band").count().collect()
    values = [k * 7 % 113 for k in range(200)]
    assert {r["band"]: r["count"] for r in got} == {k: sum(k * 10 <= v <= k * 10 + 13 for v in values) for k in range(10)}


def test_large_side_is_not_broadcast(spark):
    plan = sized_broadcast(spark.range(50), most=10)._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()


def test_failed_check_keeps_version(spark):
    t = Table(spark, scratch(spark, "t")).overwrite(spark.range(3))

    def refuse(df):
        raise ValueError

    with pytest.raises(ValueError):
        t.overwrite(spark.range(9), check=refuse)
    assert t.read().count() == 3


def test_step_error_names_step(spark):
    audit = control.Audit()
    with pytest.raises(control.StepError, match="step x of batch b"):
        audit.step("b", "x", lambda: 1 / 0)
    assert audit.rows[0][2] == "FAILED"


def test_refused_definitions():
    assert views.eligibility("SELECT k FROM t ORDER BY k") == views.REFUSED
    assert views.eligibility("SELECT sum(v) OVER (ORDER BY k) FROM t") == views.FULL
    assert views.eligibility("SELECT 'limit' FROM t") == views.INCREMENTAL


def test_no_grant_no_rows(spark):
    with pytest.raises(PermissionError):
        Policies().view("r", "t", spark.range(1))


def test_point_on_edge_is_outside(spark):
    ring = geometry.from_wkt(F.lit("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"))
    row = spark.range(1).select(geometry.contains(ring, geometry.point(4, 2)), geometry.contains(ring, geometry.point(1, 1))).first()
    assert tuple(row) == (False, True)


def test_running_sum_equals_brute_force(spark):
    from marlstone.operators.windows import running_sum

    rows = [(k, (k * 37) % 11) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = {r["k"]: (r["running"], r["total"]) for r in running_sum(df, [F.desc("v"), F.asc("k")], "v").collect()}
    total, so_far = sum(v for _, v in rows), 0
    for k, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        so_far += v
        assert got[k] == (so_far, total)


def test_publish_replaces_in_one_rename(spark):
    t = Table(spark, scratch(spark, "p")).overwrite(spark.range(2)).overwrite(spark.range(4))
    assert t.read().count() == 4 and t.versions() == 2
    t.vacuum()
    assert t.versions() == 1 and t.read().count() == 4


def files(t):
    return {f["file"] for f in t.manifest()["files"]}


def ids(t):
    return sorted(r[0] for r in t.read().select("id").collect())


def test_writes_touch_the_files_they_change(spark):
    t = Table(spark, scratch(spark, "w")).overwrite(spark.range(100), cluster_by=["id"])
    first = files(t)
    t.insert(spark.range(100, 110))
    assert first < files(t) and ids(t) == list(range(110))
    added = files(t) - first
    t.delete(F.col("id") >= 100)
    assert files(t) == first and ids(t) == list(range(100)) and added
    t.delete(F.col("id") > 1000)
    assert files(t) == first
    t.merge(spark.createDataFrame([(5,), (200,)], "id long"), ["id"])
    assert len(first - files(t)) == 1 and ids(t) == [*range(100), 200]
    t.replace(F.col("id") == 200, spark.range(300, 302))
    assert ids(t) == [*range(100), 300, 301]
    before = files(t)
    t.add_column("kind", "string", "old").insert(spark.createDataFrame([(400, "new"), (401, None)], "id long, kind string"))
    assert before < files(t)
    assert {(r["id"] >= 400, r["kind"]) for r in t.read().collect()} == {(False, "old"), (True, "new"), (True, None)}
    t.update(F.col("id") == 301, kind=F.lit("changed"))
    assert t.read().filter("kind = 'changed'").count() == 1 and t.read().filter("kind = 'old'").count() == 101
    held = ids(t)
    t.vacuum()
    assert ids(t) == held and t.versions() == 1
    assert t.compact(["id"]).truncate().read().count() == 0 and t.read().columns == ["id", "kind"]


def test_update_from_another_table(spark):
    t = Table(spark, scratch(spark, "u")).overwrite(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string"))
    t.update_from(spark.createDataFrame([(2, "x"), (3, "y"), (9, "z")], "id int, w string"), ["id"], v=F.concat(F.coalesce("v", F.lit("-")), F.col("w")))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "bx"), (3, "-y")]


def test_two_rows_of_a_key_are_refused(spark):
    t = Table(spark, scratch(spark, "m")).overwrite(spark.range(3))
    for twice in (spark.createDataFrame([(1,), (1,)], "id long"), spark.createDataFrame([(7,), (7,)], "id long")):
        with pytest.raises(ValueError):
            t.merge(twice, ["id"])
    assert ids(t) == [0, 1, 2]


def test_lost_updates_are_refused(spark):
    path = scratch(spark, "l")
    mine, other = Table(spark, path).overwrite(spark.range(1)), Table(spark, path)
    late = other.stage(spark.range(5))
    mine.insert(spark.range(1, 2))
    with pytest.raises(Outrun):
        other.publish(late)
    with mine.locked(), pytest.raises(TableLocked):
        other.insert(spark.range(1))
    assert ids(mine) == [0, 1]


@pytest.mark.parametrize("parts", [[], ["g"]])
def test_ranks_by_ranges_equal_windows(spark, parts):
    rows = [(k, (k * 37) % 11, k % 3 if k % 7 else None) for k in range(301)]
    df = spark.createDataFrame(rows, "k int, v int, g int").repartition(5)
    whole = Window.partitionBy(*parts)
    for kind, order in (("row_number", [F.desc("v"), F.asc("k")]), ("rank", [F.desc("v")]), ("dense_rank", [F.desc("v")])):
        want = {r["k"]: r["r"] for r in df.withColumn("r", getattr(F, kind)().over(whole.orderBy(*order))).collect()}
        assert {r["k"]: r["rn"] for r in ranked(df, order, kind, partition_by=parts).collect()} == want
    for tiles in (4, 500):
        order = [F.desc("v"), F.asc("k")]
        want = {r["k"]: r["r"] for r in df.withColumn("r", F.ntile(tiles).over(whole.orderBy(*order))).collect()}
        assert {r["k"]: r["rn"] for r in ranked(df, order, partition_by=parts, tiles=tiles).collect()} == want


def test_buckets_spare_the_exchange(spark):
    rows = bucketed(spark.range(1000).selectExpr("id", "id % 50 AS k"), ["k"], 4)
    plan = rows.join(rows.groupBy("k").count(), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_bill_of_materials_outgrows_the_row_limit(spark):
    name = "r05_bill_of_materials"
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        compare(catalog.queries()[name](spark, FOLDER), connect(), catalog.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_quantities_add_up_over_all_ways(spark):
    ensure_checkpoint_dir(spark)
    rows = [(1, 2, 3), (1, 3, 2), (2, 4, 5), (3, 4, 7), (3, 4, 1), (4, 5, 2000000000), (1, 5, None), (3, 6, None), (6, 7, 4), (8, 9, 1)]
    got = exploded(spark.createDataFrame(rows, "parent long, child long, qty int"), 1)
    assert {r["item"]: r["qty"] for r in got.collect()} == {2: 3, 3: 2, 4: 31, 5: 62000000000, 6: None, 7: None}
    with pytest.raises(RecursionError):
        exploded(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "parent long, child long, qty int"), 1, most=5)
    assert exploded(spark.createDataFrame(rows, "parent long, child long, qty int"), 99).count() == 0


def test_executors_read_the_other_database(spark, tmp_path):
    home = tmp_path / "home"  # Spark's, as executors write their logs there
    home.mkdir()
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).parents[1])}
    run = subprocess.run([sys.executable, "-c", APART, "s25_federated", FOLDER, f"file://{tmp_path}/shared"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    want = connect().execute(catalog.oracle_sql()["s25_federated"]).fetchall()
    assert sorted(map(tuple, json.loads(run.stdout))) == sorted(want)


def test_the_other_database_holds_nulls_and_no_rows(spark, tmp_path):
    columns = "c_custkey long, c_nationkey int, c_acctbal double"
    for name, rows in (("none", []), ("odd", [(None, 1, 2.5), (-7, None, 1e-9), (3, 1, None), (None, None, None), (9, 1, -1.0)])):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}/customer.parquet")
        got = catalog.queries()["s25_federated"](spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got), key=str) == ([(1, 1, None), (None, 1, -7)] if rows else [])
