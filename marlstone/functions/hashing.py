"""Hashes: row fingerprints, tokens, buckets, change detection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same

#: Fixed by the definition of the 64-bit FNV-1a hash.
_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def row_hash(*columns: str) -> Column:
    """MD5 over columns in a form in which NULL differs from the empty text and no two rows run together."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns)))


def fnv(value: Column, seed: int = _FNV_OFFSET) -> Column:
    """64-bit FNV-1a, in batches."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = seed
            for b in (t or "").encode():
                h = (h ^ b) * _FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            out.append(h - (1 << 64) if h >> 63 else h)
        return pd.Series(out, dtype="int64")

    return run(value)


def table_checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum, as one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(row_hash(*df.columns)).cast("decimal(38,0)")).alias("checksum"))


def _same_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a, b = table_checksum(nation).first(), table_checksum(nation.orderBy(F.desc("n_name"))).first()
    c = table_checksum(nation.withColumn("n_name", F.lower("n_name"))).first()
    return spark.createDataFrame([(a == b, a == c)], "order_free boolean, blind boolean")


QUERIES = [
    same("h01_md5", "SELECT c_custkey, md5(concat_ws('|', c_custkey, c_name, c_mktsegment)) AS h FROM {customer}"),
    Query("h02_sha1", "SELECT n_nationkey, sha1(n_name) AS h FROM {nation}", "SELECT n_nationkey, sha1(n_name) AS h FROM nation"),
    Query("h03_sha2", "SELECT n_nationkey, sha2(n_name, 256) AS h FROM {nation}", "SELECT n_nationkey, sha256(n_name) AS h FROM nation"),
    Query("h04_checksum", "SELECT crc32('123456789') AS c", "SELECT CAST(3421780262 AS BIGINT) AS c"),
    Query("h05_fnv", lambda s, d: s.createDataFrame([("a",), ("foobar",)], "t string").select("t", fnv(F.col("t")).alias("h")), "SELECT * FROM (VALUES ('a', CAST(-5808556873153909620 AS BIGINT)), ('foobar', CAST(-8821353812377114648 AS BIGINT))) AS x(t, h)"),
    Query("h06_murmur", "SELECT count(DISTINCT hash(c_name)) = count(DISTINCT c_name) AS spread FROM {customer}", "SELECT true AS spread"),
    Query("h07_tokens", "SELECT c_custkey, substring(sha2(concat('salt', c_name), 256), 1, 12) AS token, CAST(conv(substring(md5(c_name), 1, 4), 16, 10) AS BIGINT) % 10 AS bucket FROM {customer}",
          "SELECT c_custkey, substring(sha256(concat('salt', c_name)), 1, 12) AS token, CAST(('0x' || substring(md5(c_name), 1, 4)) AS BIGINT) % 10 AS bucket FROM customer"),
    same("h08_change_detection", "SELECT count(*) AS changed FROM {customer} a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM {customer}) b ON a.c_custkey = b.c_custkey WHERE md5(a.c_mktsegment) <> md5(b.seg)"),
    Query("h09_table_state", _same_state, "SELECT true AS order_free, false AS blind"),
    Query("h10_xor", "SELECT c_custkey, crc32(c_name) ^ crc32(c_name) AS zero FROM {customer}", "SELECT c_custkey, CAST(0 AS BIGINT) AS zero FROM customer"),
    Query("h10_xor_keys", "SELECT c_custkey, c_custkey ^ c_nationkey AS one, bit_xor(c_custkey) OVER (PARTITION BY c_nationkey) AS of_nation FROM {customer}", "SELECT c_custkey, xor(c_custkey, c_nationkey) AS one, bit_xor(c_custkey) OVER (PARTITION BY c_nationkey) AS of_nation FROM customer"),
    same("h11_password_check", "SELECT c_custkey, md5(concat('s', c_name)) = md5(concat('s', CASE WHEN c_custkey % 7 = 0 THEN 'wrong' ELSE c_name END)) AS good FROM {customer}"),
]
