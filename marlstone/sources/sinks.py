"""Writing files: exports, quarantine, rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unload(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None, max_records: int | None = None, single: bool = False, **options) -> None:
    """UNLOAD: replaces the folder. ``single`` writes one file, for small results only."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").options(**options)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(form).save(path)


def unload_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Compressed CSV with a header."""
    unload(df, path, "csv", single=single, header=True, compression="gzip")


def quarantine(bad: DataFrame, path: str, run_ts: str) -> None:
    """Appends rejected rows with the time of the run."""
    bad.withColumn("quarantined_at", F.lit(run_ts).cast("timestamp")).write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that the rows touch."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
