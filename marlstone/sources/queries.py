"""Queries over sources and sinks: each writes files under the shared folder and reads them back."""

from __future__ import annotations

import contextlib
import glob
import json
import os
import shutil
import zipfile
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Query
from ..plans.tables import scratch
from . import readers, sinks

_ORDER = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("at", T.DateType()), T.StructField("amount", T.DecimalType(10, 2))])
#: A line for every customer: of ten keys one has a key that is no number, one a date that is none, one blanks for NULL.
_LINE = """concat_ws(',', CASE WHEN c_custkey % 10 = 3 THEN concat('x', c_custkey) ELSE CAST(c_custkey AS STRING) END, CASE WHEN c_custkey % 10 = 5 THEN '\\\\N' ELSE concat(' ', c_name, ' ') END,
 CASE WHEN c_custkey % 10 = 4 THEN 'not a date' ELSE CAST(date_add(DATE '2024-05-06', CAST(c_custkey % 20 AS INT)) AS STRING) END, CASE WHEN c_custkey % 10 = 5 THEN '' ELSE CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS STRING) END)"""
_GOOD = """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 5 THEN c_name END AS name, CAST(DATE '2024-05-06' + (c_custkey % 20)::INT AS STRING) AS at_, CASE WHEN c_custkey % 10 <> 5 THEN CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) END AS amount FROM customer WHERE c_custkey % 10 NOT IN (3, 4)"""
_BAD = "FROM customer WHERE c_custkey % 10 IN (3, 4)"


def _text(spark: SparkSession, lines: list[str], name: str) -> str:
    path = scratch(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def _lines(spark: SparkSession, sf_dir: str, table: str = "customer", line: str = _LINE) -> str:
    """A folder of text files with a line for every row of a table."""
    path = scratch(spark, "lines")
    spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{line} AS value").write.text(path)
    return path


def _copied(spark: SparkSession, sf_dir: str, max_errors: int = 1 << 30):
    return readers.copy_csv(spark, _lines(spark, sf_dir), _ORDER, max_errors=max_errors, header=False)


def _plain(df: DataFrame) -> DataFrame:
    return df.select("id", "name", F.col("at").cast("string").alias("at_"), F.col("amount").cast("double").alias("amount"))


def _permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_csv(spark, _lines(spark, sf_dir), _ORDER, header=False)
    return rows.agg(F.count("*").alias("n"), F.count(readers.CORRUPT).alias("bad"))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    return readers.external_table(spark, _lines(spark, sf_dir, "nation", "concat_ws('|', n_nationkey, n_name)"), schema, "csv", sep="|")


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "parts")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sinks.unload(orders, path, partition_by=["o_orderstatus"], max_records=5000)
    return spark.read.parquet(path).filter("o_orderstatus = 'F'").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


def _catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("marlstone_region")
    return spark.table("marlstone_region").select("r_name")


def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_copied(spark, sf_dir)[0])


def _max_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error more than allowed stops the load; as many as allowed do not."""
    bad = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 10 IN (3, 4)").count()
    out = []
    for most in (bad, bad - 1):
        try:
            out.append((bad - most, False, _copied(spark, sf_dir, most)[0].count()))
        except readers.TooManyErrors:
            out.append((bad - most, True, 0))
    return spark.createDataFrame(out, "missing int, refused boolean, n long")


def _copy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pq")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(path)
    return spark.read.parquet(path)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = {"entries": [{"url": f"{sf_dir}/region.parquet", "mandatory": True}]}
    return readers.read_manifest(spark, _text(spark, [json.dumps(entries)], "manifest"))


_JSON = """concat('{"id": ', s_suppkey, ', "who": {', CASE WHEN s_suppkey % 3 > 0 THEN concat('"name": "', s_name, '"') ELSE '' END, '}', CASE WHEN s_suppkey % 2 = 0 THEN concat(', "tags": ["t', s_nationkey, '", "b"]') ELSE ', "extra": true' END, '}')"""


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("who", T.StructType([T.StructField("name", T.StringType())]))])
    return readers.read_json(spark, _lines(spark, sf_dir, "supplier", _JSON), schema).select("id", F.col("who.name").alias("name"))


def _jsonpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_jsonpaths(spark, _lines(spark, sf_dir, "supplier", _JSON), {"id": ("$.id", "long"), "name": ("$.who.name", "string"), "tag": ("$.tags[0]", "string")})


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, sf_dir, "orders", "concat_ws(',', CAST(o_totalprice AS DECIMAL(10,2)), o_orderkey)")
    return readers.copy_csv(spark, path, _ORDER, columns=["amount", "id"], header=False)[0].select("id", F.col("amount").cast("double").alias("amount"))


def _presorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sorted")
    spark.read.parquet(f"{sf_dir}/orders.parquet").repartitionByRange(4, "o_orderdate").sortWithinPartitions("o_orderdate").write.parquet(path)
    return spark.read.parquet(path).filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").agg(F.count("*").alias("n"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load_errors(_copied(spark, sf_dir)[1])


def _csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "out")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sinks.unload_csv(nation, path)
    return readers.external_table(spark, path, nation.schema, "csv", header="true")


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, many = scratch(spark, "one"), scratch(spark, "many")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(4)
    sinks.unload(rows, one, single=True)
    sinks.unload(rows, many)
    return spark.createDataFrame([(len(spark.read.parquet(one).inputFiles()), len(spark.read.parquet(many).inputFiles()))], "one int, many int")


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "quarantine")
    bad = _copied(spark, sf_dir)[1].select("raw_line", "reason")
    for run_ts in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        sinks.quarantine(bad, path, run_ts)
    return spark.read.parquet(path).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("quarantined_at").alias("runs"))


def _rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status; then one status is written again, and the others' files stay."""
    path = scratch(spark, "rebuild")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderkey")
    sinks.overwrite_partitions(rows, path, ["o_orderstatus"])
    sinks.overwrite_partitions(rows.filter("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey")), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted defects: orphans, repeated ids, missing names, bad quantities, all from the row number."""
    rows = readers.generate(spark, 1000, id=lambda n: F.when(n % 50 == 0, n - 1).otherwise(n), customer=lambda n: F.when(n % 40 == 0, 9999).otherwise(n % 100), name=lambda n: F.when(n % 25 != 0, F.concat(F.lit("c"), n)), quantity=lambda n: F.when(n % 30 == 0, -1).otherwise(n % 7 + 1))
    return rows.agg((F.count("*") - F.countDistinct("id")).alias("repeats"), F.sum((F.col("customer") == 9999).cast("long")).alias("orphans"), F.sum(F.col("name").isNull().cast("long")).alias("nameless"), F.sum((F.col("quantity") < 1).cast("long")).alias("bad"))


def _unloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported by status, no file above a size, the second export in place of the first."""
    path, orders = scratch(spark, "unloaded"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    for _ in range(2):
        sinks.unload(orders, path, partition_by=["o_orderstatus"], max_records=500)
    files = spark.read.parquet(path).groupBy("o_orderstatus", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return files.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("within"))


def _database(spark: SparkSession, rows: DataFrame, columns: str) -> str:
    """The URL of another database that holds the rows as its table CUSTOMER.

    The driver's embedded engine loads the files that the executors wrote. A database that can be written belongs to one
    process, so it is then closed and put, as read-only, into an archive in the shared folder: every executor opens that.
    """
    folder, jvm = scratch(spark, "database"), spark.sparkContext._jvm
    if jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        raise ValueError(f"an embedded database needs a shared folder that is mounted on all machines, not {folder}")
    at, manager = urlsplit(folder).path, jvm.java.sql.DriverManager
    rows.write.csv(f"{folder}/rows")
    link = manager.getConnection(f"jdbc:derby:{at}/remote;create=true")
    try:
        link.createStatement().execute(f"CREATE TABLE customer ({columns})")
        for part in sorted(glob.glob(f"{at}/rows/part-*")):
            if os.path.getsize(part):
                link.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'CUSTOMER', '{part}', ',', '\"', 'UTF-8', 0)")
    finally:
        link.close()
        with contextlib.suppress(Py4JJavaError):  # the engine reports the end of a database as an exception
            manager.getConnection(f"jdbc:derby:{at}/remote;shutdown=true")
    with zipfile.ZipFile(f"{at}/remote.jar", "w", zipfile.ZIP_STORED) as jar:  # not compressed: pages are read at their offsets
        for name in sorted(glob.glob("**", root_dir=f"{at}/remote", recursive=True)):
            jar.write(f"{at}/remote/{name}", f"remote/{name}")
    shutil.rmtree(f"{at}/remote")
    shutil.rmtree(f"{at}/rows")
    return f"jdbc:derby:jar:({at}/remote.jar)remote"


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of another database (an embedded one) read over JDBC: the query runs there, and the read is split by a
    numeric column."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    url = _database(spark, customer, '"c_custkey" BIGINT, "c_nationkey" INTEGER, "c_acctbal" DOUBLE PRECISION')
    top = customer.agg(F.max("c_custkey")).first()[0] or 0
    remote = readers.federated(spark, url, 'SELECT "c_custkey", "c_nationkey" FROM customer WHERE "c_acctbal" > 0', '"c_custkey"', (0, top), 4)
    return remote.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("top"))


QUERIES = [
    Query("s17_unload_partitioned", _unloaded, "SELECT o_orderstatus, count(*) AS n, true AS within FROM orders GROUP BY 1"),
    Query("s25_federated", _federated, "SELECT c_nationkey, count(*) AS n, max(c_custkey) AS top FROM customer WHERE c_acctbal > 0 GROUP BY 1"),
    Query("s01_csv_permissive", _permissive, "SELECT count(*) AS n, count(CASE WHEN c_custkey % 10 IN (3, 4) THEN 1 END) AS bad FROM customer"),
    Query("s02_external_text", _external, "SELECT n_nationkey AS k, n_name AS v FROM nation"),
    Query("s03_partitioned_table", _partitioned, "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F'"),
    Query("s05_catalog_view", _catalog_view, "SELECT r_name FROM region"),
    Query("s08_copy_csv", _copy, _GOOD),
    Query("s08_max_errors", _max_errors, "SELECT 0 AS missing, false AS refused, count(CASE WHEN c_custkey % 10 NOT IN (3, 4) THEN 1 END) AS n FROM customer UNION ALL SELECT 1, true, 0"),
    Query("s09_copy_parquet", _copy_parquet, "SELECT * FROM nation"),
    Query("s10_manifest", _manifest, "SELECT * FROM region"),
    Query("s11_json", _json, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS name FROM supplier"),
    Query("s12_jsonpaths", _jsonpaths, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_nationkey END AS tag FROM supplier"),
    Query("s13_column_list", _columns, "SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS amount FROM orders"),
    Query("s14_presorted", _presorted, "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"),
    Query("s16_load_errors", _errors, f"SELECT 'does not fit the schema' AS reason, count(*) AS n {_BAD}"),
    Query("s18_unload_csv", _csv_out, "SELECT * FROM nation"),
    Query("s19_single_file", _single, "SELECT 1 AS one, 4 AS many"),
    Query("s20_quarantine", _quarantine, f"SELECT 'does not fit the schema' AS reason, 2 * count(*) AS n, CAST(2 AS BIGINT) AS runs {_BAD}"),
    Query("s21_overwrite_partitions", _rebuild, "SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS keys FROM orders GROUP BY 1"),
    Query("s22_generator", lambda s, d: readers.generate(s, 500, n=lambda i: i, k=lambda i: i % 7), "SELECT range AS n, range % 7 AS k FROM range(500)"),
    Query("s23_multiplier", lambda s, d: s.read.parquet(f"{d}/nation.parquet").crossJoin(s.range(3).withColumnRenamed("id", "copy_")).groupBy("copy_").agg(F.count("*").alias("n")), "SELECT copy_, count(*) AS n FROM nation CROSS JOIN (SELECT range AS copy_ FROM range(3)) GROUP BY copy_"),
    Query("s24_defect_generator", _defects, "SELECT CAST(19 AS BIGINT) AS repeats, CAST(25 AS BIGINT) AS orphans, CAST(40 AS BIGINT) AS nameless, CAST(34 AS BIGINT) AS bad"),
    Query("s28_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)"),
]
