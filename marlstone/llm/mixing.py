"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. A slot of the mix takes one block. In the ideal mix every source is served all the time,
at a rate in proportion to its weight among the sources that still have rows. Block j of a source is released in the
slot in which the ideal mix begins it, and due by the slot in which the ideal mix ends it; among the released blocks
the one that is due earliest goes first (ties: the source that sorts first). The ideal mix is itself a fractional schedule
of the same releases and deadlines, so none is missed, and after every slot each source deviates from the ideal mix by
less than one block, from the first slot to the last, whichever sources have run out by then. While none has, the ideal
mix gives each source exactly its target weight. Weights are taken as they are given, as exact fractions.

A source that runs out leaves, and the others go on by their weights, so every row is used exactly once and none is
dropped or repeated. Sources whose weight is zero, or missing from the weights given, get no slot while one with a
weight has rows; they come after all others, as equals. The order is the mix: ``mix`` adds block, slot and position,
and ``in_order`` lays rows out by position in files of equal numbers of rows.

The schedule depends on weights and numbers of blocks alone. It is made on the driver: an entry for each source and 4 bytes
for each slot, both of which the tasks get, too. A block has ``BLOCK_ROWS`` rows, or more where a table would need more
than about ``SLOTS`` slots, so the schedule's size does not grow with the table. Rows look their slots up; they are
never walked through in order.

Within a source, rows are ordered by a seeded hash. A source is dealt out in buckets of bounded size, at most
about ``MAX_BUCKETS`` in all, whose counts give each bucket's first row; so a source with a third of all rows is
numbered by many tasks.

Defined results: rows without a source form a source of their own; null ids and texts are values like others, and texts of
any length travel as they are; equal rows are interchangeable (and share a bucket); negative weights are refused; an
empty table gives an empty result; columns named like an added one are replaced, whatever the others are called.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import carried, numbered, parts, small_table

BLOCK_ROWS, SLOTS, ALPHA = 16, 1 << 20, 0.5
BUCKET_ROWS, MAX_BUCKETS = 1000, 100_000
#: Sources that are broadcast; of more, the others meet their rows in a shuffle.
MOST_BROADCAST = 100_000
ADDED = ("mix_block", "mix_slot", "mix_position")


class Ideal:
    """When the ideal mix has served so many blocks of a source, in slots, for sources with positive whole weights."""

    def __init__(self, weights: list[int], blocks: list[int]):
        self.weights = weights
        order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], weights[i]))  # as they run out
        self._w, self._n = [weights[i] for i in order], [blocks[i] for i in order]
        self._before = [0, *accumulate(self._n)]
        total = sum(weights)
        self._live = [total - w for w in (0, *accumulate(self._w))]
        self._ends = [n / w for n, w in zip(self._n, self._w)]

    def served(self, i: int, count: int) -> tuple[int, int]:
        """The slot time, as a fraction's numerator and denominator, at which ``count`` blocks of source i are served."""
        w = self.weights[i]
        k = bisect_right(self._ends, count / w)  # of the sources that have run out by then; exact from here on
        while k < len(self._n) and self._n[k] * w <= count * self._w[k]:
            k += 1
        while k and self._n[k - 1] * w > count * self._w[k - 1]:
            k -= 1
        return self._before[k] * w + self._live[k] * count, w


def earliest_deadlines(weights: list[int], blocks: list[int]) -> np.ndarray:
    """The source of each slot: earliest deadline first among the released blocks. All weights and numbers are positive."""
    ideal, slots = Ideal(weights, blocks), sum(blocks)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    waiting: list[tuple[int, int, int]] = []  # (release, source, deadline)
    ends, done = [0] * len(blocks), [0] * len(blocks)
    for i in range(len(blocks)):
        numerator, w = ideal.served(i, 1)
        ready.append((-(-numerator // w), i))
        ends[i] = numerator // w  # the next block's release
    heapq.heapify(ready)
    out = np.empty(slots, np.int32)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, i, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i))
        _, i = heapq.heappop(ready)
        out[slot] = i
        done[i] += 1
        if done[i] < blocks[i]:
            release = ends[i]
            numerator, w = ideal.served(i, done[i] + 1)
            ends[i], due = numerator // w, -(-numerator // w)
            if release <= slot + 1:
                heapq.heappush(ready, (due, i))
            else:
                heapq.heappush(waiting, (release, i, due))
    return out


class Schedule:
    """Slots of all blocks of sources with given whole weights, of any size, and numbers of blocks."""

    def __init__(self, weights: list[int], blocks: list[int]):
        some = [i for i, n in enumerate(blocks) if n and weights[i]]
        none = [i for i, n in enumerate(blocks) if n and not weights[i]]
        taken = [np.zeros(0, np.int32)]  # the source of each slot
        for tier, of in ((some, [weights[i] for i in some]), (none, [1] * len(none))):
            if tier:
                shared = gcd(*of)
                taken.append(np.array(tier, np.int32)[earliest_deadlines([w // shared for w in of], [blocks[i] for i in tier])])
        by_slot = np.concatenate(taken)
        self.slots = len(by_slot)
        self._first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        #: The slots of all blocks, by source and block.
        self._slots = np.argsort(by_slot, kind="stable").astype(np.int32 if self.slots < 2**31 else np.int64)
        #: For each source the slot of its last block.
        self.last = [int(self._slots[b - 1]) if b > a else -1 for a, b in zip(self._first[:-1].tolist(), self._first[1:].tolist())]

    def slot(self, source: int | np.ndarray, block: np.ndarray) -> np.ndarray:
        """The slots of a source's blocks, or of blocks of several sources."""
        return self._slots[self._first[source] + block].astype(np.int64)


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the weights' ratios."""
    given = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in given.values()):
        raise ValueError("a weight is negative")
    shared = lcm(*(w.denominator for w in given.values()))
    return {s: int(w * shared) for s, w in given.items()}


def mix(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """The rows with mix_block (of their source), mix_slot and mix_position (0, 1, .. without gaps).

    Without ``weights`` a source's weight is its number of rows to the power ``alpha``.
    """
    spark = df.sparkSession
    kept = carried(df, ADDED)
    plain = [F.col(c) for c, (_, kind) in zip(kept, df.select(*kept).dtypes) if not kind.startswith(("map", "array", "struct", "variant"))]
    key = F.col("`" + id_col.replace("`", "``") + "`")
    rows = df.select(*numbered(kept), F.coalesce(F.col("`" + source_col.replace("`", "``") + "`").cast("string"), F.lit("\0")).alias("source"), F.xxhash64(*plain, F.lit(seed)).alias("hash"), key.alias("id"))
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # one row for each source
    names, total = sorted(counts), sum(counts.values())
    whole = whole_weights({s: (weights or {}).get(s, 0) if weights else counts[s] ** alpha for s in names})
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // SLOTS))
    blocks = [-(-counts[s] // block_rows) for s in names]
    plan = Schedule([whole[s] for s in names], blocks)

    per_bucket = max(BUCKET_ROWS, -(-total // MAX_BUCKETS))
    side = [(s, k, -(-counts[s] // per_bucket)) for k, s in enumerate(names)]
    schema = "source string, k int, buckets long"
    large = small_table(spark, sorted(side, key=lambda r: -r[2])[:MOST_BROADCAST], schema)
    named = rows.join(F.broadcast(large), "source")
    if len(side) > MOST_BROADCAST:  # the others hold less than a MOST_BROADCAST-th of all rows each
        named = named.unionByName(rows.join(F.broadcast(large), "source", "left_anti").join(small_table(spark, side, schema), "source"))
    rows = named.withColumn("bucket", F.pmod("hash", "buckets"))
    tasks = parts(df)
    sizes = rows.filter("buckets > 1").groupBy("k", "bucket").count().collect()  # at most 2 * MAX_BUCKETS rows
    before: list[tuple[int, int, int]] = []
    sums = [0] * len(names)
    for k, bucket, n in sorted(map(tuple, sizes)):
        before.append((k, bucket, sums[k]))
        sums[k] += n
    firsts = small_table(spark, before, "k int, bucket long, before long")
    order = Window.partitionBy("k", "bucket").orderBy("hash", "id")
    index = F.coalesce("before", F.lit(0)) + F.row_number().over(order) - 1
    placed = rows.repartition(tasks, "k", "bucket").join(F.broadcast(firsts), ["k", "bucket"], "left").withColumn("at", index).withColumn("block", F.floor(F.col("at") / block_rows))

    ends = sorted((last, n * block_rows - counts[s]) for last, n, s in zip(plan.last, blocks, names))
    end_slots, missing = np.array([e for e, _ in ends] or [0]), np.concatenate([[0], np.cumsum([m for _, m in ends])])

    @F.pandas_udf(T.LongType())
    def slot_of(k: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series(plan.slot(k.to_numpy(), block.to_numpy()))

    @F.pandas_udf(T.LongType())
    def first_of(slot: pd.Series) -> pd.Series:
        s = slot.to_numpy()
        return pd.Series(s * block_rows - missing[np.searchsorted(end_slots, s, "left")])

    placed = placed.withColumn("slot", slot_of("k", "block")).withColumn("position", first_of("slot") + F.pmod(F.col("at"), F.lit(block_rows)))
    names_kept = df.select(*kept).columns
    return placed.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(names_kept)), *(F.col(c.removeprefix("mix_")).alias(c) for c in ADDED))


def in_order(mixed: DataFrame, rows: int, files: int) -> DataFrame:
    """The mix laid out by position: partition p holds the p-th of ``files`` equal ranges, sorted."""
    at = F.least(F.floor(F.col("mix_position") * files / max(rows, 1)), F.lit(files - 1)).cast("int")
    return mixed.repartitionById(files, at).sortWithinPartitions("mix_position")


def mixed_in_order(df: DataFrame, **options) -> DataFrame:
    """``mix`` laid out in about as many partitions as read the table."""
    return in_order(mix(df, **options), df.count(), parts(df))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in a mix of all sources, the weights being square roots of their sizes."""
    return mixed_in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
