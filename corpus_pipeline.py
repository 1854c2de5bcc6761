"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the next one's
docs. All but the last keep the columns of documents. The mixing stage drops nothing: its decision is the order,
which its files hold: by their numbers, and by the rows in each. A scan deals files out in another order, so the packing
stage finds each row's position from its file and row number and goes by it: task p packs the p-th range of positions,
in order, and sequence ids ascend with the tasks. Inside a task the groups of windows follow the mix; a group's pieces
are dealt out among its windows.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marlstone.llm import exact_dedup, mixing, near_dedup, packing, quality
from marlstone.llm.storage import carried, fresh_dir, remove, small_table, until_exit, unused

TOKENIZER = "word_bpe_49k.json"
#: Words in a generation of the encoder's cache: fewer than the operator has alone, as executors here hold what earlier stages left.
CACHE_WORDS = 100_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    network, score = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), unused(docs, "quality_score")
    return quality.score(docs, network, to=score).filter(F.col(score) >= quality.THRESHOLD).select(*carried(docs, ()))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix of their sources."""
    return mixing.mixed_in_order(docs).select(*carried(docs, ()))


def in_file_order(docs: DataFrame) -> DataFrame:
    """Documents read from Parquet files, in the order in which the files were written; others as they come."""
    spark, kept = docs.sparkSession, carried(docs, ("mix_position",))
    file, row, before_file = (unused(docs, n) for n in ("mix_file", "mix_row", "mix_before"))
    try:
        rows = docs.select(*kept, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # no files, no order
        return docs
    # a file's number is that of the task that wrote it, however many digits it has; a task's further files go by name
    number = lambda path: (int(m[1]) if (m := re.search(r"part-(\d+)[^/]*$", path)) else 0, path)
    sizes = sorted(rows.groupBy(file).count().collect(), key=lambda r: number(r[file]))  # one row for each file
    before = [0, *itertools.accumulate(r["count"] for r in sizes)]
    firsts = small_table(spark, [(r[file], n) for r, n in zip(sizes, before)], f"{file} string, {before_file} long")
    placed = rows.join(F.broadcast(firsts), file).select(*kept, (F.col(before_file) + F.col(row)).alias("mix_position"))
    tasks = max(len(sizes), int(spark.conf.get("spark.sql.shuffle.partitions")))  # the mix has a file for each task that read its input
    return mixing.in_order(placed, before[-1], tasks).select(*kept)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences, in the order of the mix."""
    import public_tokenizers

    return packing.pack_documents(in_file_order(docs), public_tokenizers.path(TOKENIZER), cache_words=CACHE_WORDS)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("MinHash near-dedup", different_documents),
    ("mixing sources", mixed_documents),
    ("packing", packed_sequences),
]

#: The classifier, similarity estimates and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over a folder's documents. A stage's table goes once the next one is written."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            remove(spark, f"{out}/{k - 1}")
    until_exit(spark, out)
    return docs
