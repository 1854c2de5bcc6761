"""Where intermediate tables and files live: a folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

def carried(df: DataFrame, added: Iterable[str], keep: list[str] | None = None) -> list[str]:
    """Names of the columns to carry along, quoted, without those that an added column replaces (in any case)."""
    replaced = {c.lower() for c in added}
    return ["`" + c.replace("`", "``") + "`" for c in (df.columns if keep is None else keep) if c.lower() not in replaced]


def numbered(columns: list[str]) -> list[Column]:
    """Carried columns under plain names, for the functions over Arrow batches, which refuse some names."""
    return [F.col(c).alias(f"__c{k}") for k, c in enumerate(columns)]


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: as many as tasks read them, and no fewer than the session's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it is unset, as in local tests, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Fewer rows to an Arrow batch, and about so many bytes, where the session has the defaults: a row here is a whole text.

    An executor's JVM and each of its Python workers hold several copies of a batch, and the JVM keeps their memory."""
    for name, default, fewer in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", most_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        if fewer and spark.conf.get(name) == default:
            spark.conf.set(name, str(fewer))


#: Bytes of an Arrow batch of texts at about most, where all of a table's columns travel; a longer text makes a batch of its own.
BATCH_BYTES = 2 << 20


def small_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """The driver's rows as a table, by way of Arrow: of plain rows Spark makes one in Python workers of another pool, which
    then stay in each executor beside those of the operators."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not all(isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType)) for f in schema):
        return spark.createDataFrame(rows, schema)
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema.names), schema)


_held = threading.local()


def _scopes() -> list[list[str]]:
    """The thread's open scopes."""
    if not hasattr(_held, "scopes"):
        _held.scopes = []
    return _held.scopes


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were checkpointed inside it; ``lasting`` ones belong to the scope around it."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            remove(spark, path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    store, at = _path(spark, path)
    store.delete(at, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """A written folder goes when the driver's JVM ends, whether or not the session was stopped before."""
    store, at = _path(spark, path)
    store.deleteOnExit(at)


def checkpointed(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The rows, written once as a table in the shared folder: lineage ends here and lost executors cost nothing.

    Tables are Parquet rather than serialised rows: smaller, read by column, and of a size that the planner knows.
    They go with their ``scope``, and outside of any when the driver ends; a table that a lazy result reads must be ``lasting``.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "table")
    df.write.parquet(path)
    scopes = _scopes()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append(path)
    else:
        until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
