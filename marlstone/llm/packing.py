"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document is encoded, ended by an end id and cut into pieces: whole windows first, which need no packing,
then a remainder in pieces of at most ``max_piece``. A task gathers remainders until they fill
``group_windows`` windows and balances them by differencing: each piece starts as a partition with one
filled window; the two partitions of the largest spread merge, the fullest windows of one onto the emptiest
of the other, until one is left. If a window exceeds the capacity, the count of windows rises and the
differencing starts again. Groups are local to a task, so nothing shuffles; memory is bounded by one group and the ids of
one run of texts, or of one text that is longer (its windows leave the task as they are cut).

Sequence ids are unique over the table: the task's partition in the upper bits, a counter in the lower ones.

Defined results: a null or empty text gives one piece, its end id; equal rows are packed each for itself; an
empty table gives no pieces; other columns are ignored; null ids stay null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordtok
from .storage import BATCH_BYTES, small_batches

CAPACITY, MAX_PIECE, GROUP_WINDOWS, END_ID = 2048, 256, 64, 1
#: A group is closed at this share of its windows' capacity: differencing leaves the fullest window about so much above the mean.
FILL = 0.995
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each window, for near-equal sums.

    A partition is its ascending window sums. Merges are noted with the order they led to; at the end the final
    windows are handed down through them to the items, each of which began in its partition's last window.
    """
    sums = np.zeros((len(sizes), windows), np.int64)
    sums[:, -1] = sizes
    held = dict(enumerate(sums))
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = held.pop(a) + held.pop(b)[::-1]
        rank = merged.argsort()
        merged = merged[rank]
        node = len(sizes) + len(merges)
        merges.append((a, b, rank))
        held[node] = merged
        heapq.heappush(heap, (int(merged[0] - merged[-1]), node))
    out: list[list[int]] = [[] for _ in range(windows)]
    places = {heap[0][1]: np.arange(windows)} if heap else {}
    for node in range(len(sizes) + len(merges) - 1, len(sizes) - 1, -1):
        a, b, rank = merges[node - len(sizes)]
        at = np.empty(windows, np.int64)
        at[rank] = places.pop(node)
        places[a], places[b] = at, at[::-1]
    for i, at in places.items():
        out[at[-1]].append(i)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of near-equal sums, none over the capacity; their count rises as long as one is."""
    if any(s > capacity for s in sizes):
        raise ValueError("a piece exceeds the capacity")
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += max(1, windows // 200)


class _Output:
    def __init__(self, first: int):
        self.next, self.rows = first, []

    def window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, total, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)), []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, max_piece: int = MAX_PIECE, group_windows: int = GROUP_WINDOWS, cache_words: int = wordtok.CACHE_WORDS) -> DataFrame:
    """One row per piece, with its ids (little-endian uint32) and its place in a sequence."""
    small_batches(df.sparkSession, BATCH_BYTES)
    if not 0 < max_piece <= capacity:
        raise ValueError("max_piece must lie between 1 and the capacity")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = wordtok.load(tokenizer, cache_words), np.array([end_id], "<u4").tobytes()
        out = _Output(TaskContext.get().partitionId() << 32)
        goal = max(capacity, int(capacity * group_windows * FILL))
        rest: list[tuple] = []
        waiting = 0
        for batch in rows:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in wordtok.batches(batch.column(1).to_pylist()):
                for doc, coded in zip(ids[at : at + len(texts)], tok.encode(texts)):
                    coded += end
                    total = len(coded) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        out.window([(doc, start, coded[4 * start : 4 * (start + capacity)], total)])
                        if len(out.rows) >= 2048:
                            yield out.take()
                    cuts = [*range(whole, total, max_piece), total]  # the odd ends are what differencing evens out with
                    rest += [(doc, a, coded[4 * a : 4 * b], total) for a, b in zip(cuts, cuts[1:])]
                    waiting += total - whole
                    if waiting >= goal:
                        taken, sizes = 0, []
                        for p in rest:
                            if taken + len(p[2]) // 4 > goal:
                                break
                            sizes.append(len(p[2]) // 4)
                            taken += sizes[-1]
                        for w in pack(sizes, capacity):
                            out.window([rest[i] for i in sorted(w)])
                        rest, waiting = rest[len(sizes) :], waiting - taken
                at += len(texts)
                if out.rows:
                    yield out.take()
        if rest:
            for w in pack([len(p[2]) // 4 for p in rest], capacity):
                out.window([rest[i] for i in sorted(w)])
        if out.rows:
            yield out.take()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids."""
    import public_tokenizers

    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
