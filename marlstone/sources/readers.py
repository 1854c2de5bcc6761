"""Loading files: schemas are given, never inferred; bad rows are split off with a reason."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import scratch

CORRUPT, FILE = "_corrupt_record", "_file"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """CSV by a schema; a line that does not fit keeps its text in ``_corrupt_record``.

    The parsed rows are staged in the shared folder: a parser only checks the columns that a query asks for, and
    good and bad rows are both read from one parse.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    held = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "header": True} | options
    rows = spark.read.options(**{k: str(v) for k, v in held.items()}).schema(wide).csv(path).withColumn(FILE, F.input_file_name())
    staged = scratch(spark, "parsed")
    rows.write.parquet(staged)
    return spark.read.schema(rows.schema).parquet(staged)


class TooManyErrors(ValueError):
    """A load had more bad rows than it may have."""


def copy_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, max_errors: int = 0, blanks_as_null: bool = True, trim: bool = True, null_as: str = "\\N", date_format: str = "yyyy-MM-dd", timestamp_format: str = "yyyy-MM-dd HH:mm:ss", columns: list[str] | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """COPY: (good rows, errors with file, raw line and reason). Raises if there are more than ``max_errors``.

    Errors are counted up to that bound only.
    """
    picked = T.StructType([schema[c] for c in columns]) if columns else schema
    options = {"nullValue": null_as, "dateFormat": date_format, "timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format, "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "header": header}
    rows = read_csv(spark, path, picked, **options)
    if blanks_as_null:
        for f in picked.fields:
            if isinstance(f.dataType, T.StringType):
                rows = rows.withColumn(f.name, F.when(F.trim(f.name) != "", F.col(f.name)))
    missing = F.lit(None).cast("string")
    for f in picked.fields:
        if not f.nullable:
            missing = F.coalesce(missing, F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is missing")))
    marked = rows.withColumn("_reason", F.when(F.col(CORRUPT).isNotNull(), F.lit("does not fit the schema")).otherwise(missing))
    bad = marked.filter(F.col("_reason").isNotNull()).select("_file", F.col(CORRUPT).alias("raw_line"), F.col("_reason").alias("reason"))
    found = bad.limit(max_errors + 1).count()
    if found > max_errors:
        raise TooManyErrors(f"more than {max_errors} bad rows")
    return marked.filter(F.col("_reason").isNull()).select(*picked.names), bad


def read_manifest(spark: SparkSession, manifest: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files by an exact list: {"entries": [{"url": ..., "mandatory": true}]}."""
    text = "\n".join(r["value"] for r in spark.read.text(manifest).collect())
    urls = [e["url"] for e in json.loads(text)["entries"]]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*urls)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by name: keys that the schema lacks are ignored, missing ones are NULL."""
    return spark.read.schema(schema).json(path)


def read_jsonpaths(spark: SparkSession, path: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """JSON lines by paths: column -> (path, type)."""
    return spark.read.text(path).select(*(F.get_json_object("value", p).cast(kind).alias(c) for c, (p, kind) in paths.items()))


def external_table(spark: SparkSession, path: str, schema: T.StructType, form: str = "csv", **options) -> DataFrame:
    """A table over files outside; partition columns come from folder names."""
    return spark.read.format(form).schema(schema).options(**options).load(path)


def load_errors(quarantined: DataFrame) -> DataFrame:
    """Errors by reason."""
    return quarantined.groupBy("reason").agg(F.count("*").alias("n"))


def federated(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A remote table over JDBC; filters are pushed down, and a numeric column splits the read."""
    options = {"url": url, "dbtable": f"({query}) AS q"}
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def generate(spark: SparkSession, rows: int, **columns) -> DataFrame:
    """Deterministic rows: each column is a function of the row number."""
    return spark.range(rows).select(*(f(F.col("id")).alias(n) for n, f in columns.items()))
