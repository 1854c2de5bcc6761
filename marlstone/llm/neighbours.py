"""Approximate nearest neighbours by an inverted multi-index.

Vectors are turned so that no two coordinates vary together (by a rotation fitted on a bounded sample, which changes no
distance) and cut into two halves of about equal spread. Each half has its own k-means centroids, fitted on the
sample, and a vector's entry is kept under its pair of centroids. A query walks the pairs by the sum of its distances to the two centroids,
from the nearest on, with a heap, until the pairs hold enough entries; those are reranked by the exact distance.

How many entries are enough, as a share of the index, is fitted on the sample too: the share that reaches
``TARGET_RECALL`` there. Neighbours in the whole table are nearer than those in a sample, so its recall is no
lower. (Vectors without any structure need a large share; nothing in the walk bounds it.)

Every row is indexed. Pairs are packed into shards of about ``SHARD_BYTES``, a large pair is cut into several,
and queries stream past their shards' entries in blocks, so memory is bounded by a shard and a block. The cut before the exact distances
holds ``k`` distinct ids, however many entries these have. Equal vectors are merged where they are read: of a distinct vector no more than the ``k`` + 1 smallest ids can be among anyone's nearest.

Defined results: vectors that are null or zero, hold null or non-finite components or have another length than
most rows (of equally many the longer) take no part, nor do null ids; a repeated id counts as one row; ties go to the smaller id; fewer
candidates than ``k`` give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import checkpointed

K, SAMPLE, SAMPLE_BYTES, TARGET_RECALL, MAX_CENTROIDS = 10, 20_000, 32 << 20, 0.94, 256
#: Bytes of a shard's vectors, and distances that are held at once.
SHARD_BYTES, BLOCK = 8 << 20, 1 << 22


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


class MultiIndex:
    """Centroids of both halves, and the share of all entries that a query looks at."""

    def __init__(self, sample: np.ndarray, centroids: int, k: int = K, target: float = TARGET_RECALL, seed: int = 5, ids: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.dim, self.cut = sample.shape[1], sample.shape[1] // 2
        axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(self.dim, self.dim))[1] if len(sample) > 1 else np.eye(self.dim)
        #: Axes by falling variance go to the halves in turn.
        self.axes = np.concatenate([axes[:, ::-1][:, 1::2], axes[:, ::-1][:, ::2]], axis=1)
        turned = sample @ self.axes
        self.left, self.right = (_kmeans(h, centroids, rng) for h in (turned[:, : self.cut], turned[:, self.cut :]))
        queries = rng.choice(len(sample), min(200, len(sample)), replace=False)
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=self.size)
        needed, repeated = [], ids is not None and len(np.unique(ids)) < len(ids)
        for q in queries.tolist():
            d = ((sample - sample[q]) ** 2).sum(1)
            if repeated:  # of each other id the nearest row
                d[ids == ids[q]] = np.inf
                by_d = np.argsort(d, kind="stable")
                near = by_d[np.sort(np.unique(ids[by_d], return_index=True)[1])[:k]]
            else:
                d[q] = np.inf
                near = np.argpartition(d, min(k, len(d) - 1))[:k]
            sums = self._sums(sample[q])
            order = np.argsort(sums, kind="stable")
            reach = np.empty(self.size, np.int64)
            reach[order] = np.cumsum(counts[order]) - counts[order]  # entries before a pair is opened
            needed += (reach[cells[near]] / len(sample)).tolist()
        self.share = float(np.quantile(needed, target)) if needed else 1.0

    @property
    def size(self) -> int:
        return len(self.left) * len(self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The pair of each vector."""
        x = x @ self.axes
        return _squares(x[:, : self.cut], self.left).argmin(1) * len(self.right) + _squares(x[:, self.cut :], self.right).argmin(1)

    def _sums(self, q: np.ndarray) -> np.ndarray:
        q = q @ self.axes
        return (_squares(q[None, : self.cut], self.left)[0][:, None] + _squares(q[None, self.cut :], self.right)[0]).ravel()

    def walk(self, q: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Pairs by summed distance, until they hold more than ``enough`` entries."""
        q = q @ self.axes
        a, b = _squares(q[None, : self.cut], self.left)[0], _squares(q[None, self.cut :], self.right)[0]
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, by_a, by_b = a[by_a].tolist(), b[by_b].tolist(), by_a.tolist(), by_b.tolist()
        heap, opened, out, held, width = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0, len(b)
        while heap and held <= enough:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * width + by_b[j]
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            opened[i] = j + 1
            # a pair is pushed once both pairs before it, in its row and in its column, have been taken
            if i + 1 < len(a) and opened[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < width and (i == 0 or opened[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def nearest(df: DataFrame, every: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, sample: int = SAMPLE, target: float = TARGET_RECALL) -> DataFrame:
    """The ``k`` nearest found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = _usable(df, id_col, vector_col)
    most = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not most:
        return spark.createDataFrame([], schema)
    dim, rows = most["dim"], most["count"]
    usable = usable.filter(F.size("v") == dim)
    # the sample's ids first, which are few bytes to sort; then only its vectors come
    wanted = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    ids = spark.createDataFrame(usable.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).distinct().collect(), "vec_id long")
    held = usable.join(F.broadcast(ids), "vec_id").limit(wanted).toArrow().sort_by("vec_id").combine_chunks()
    centroids = int(min(MAX_CENTROIDS, max(4, 2 ** round(np.log2(max(1.0, rows**0.5 / 8))))))
    index = MultiIndex(_matrix(held.column("v").combine_chunks(), dim), centroids, k, target, ids=held.column("vec_id").to_numpy())
    del held

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1), dim), batch.column(0).to_pylist()
            same: dict[bytes, list[int]] = {}
            for raw, i in zip((row.tobytes() for row in x), ids):
                same.setdefault(raw, []).append(i)
            keys = list(same)
            cells = index.cells(np.frombuffer(b"".join(keys), np.float64).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array([sorted(set(same[r]))[: k + 1] for r in keys], pa.list_(pa.int64())), pa.array(keys, pa.binary())], ["cell", "ids", "v"])

    held_rows = checkpointed(usable.mapInArrow(entries, "cell int, ids array<long>, v binary"))
    counts = np.zeros(index.size, np.int64)
    for r in held_rows.groupBy("cell").count().collect():  # as many rows as there are pairs of centroids
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    # consecutive pairs share a shard; a pair of more than a shard's rows has several of its own
    shard_rows = max(256, SHARD_BYTES // (8 * dim))
    parts = np.maximum(1, -(-counts // shard_rows))
    first, shard, room = np.zeros(index.size, np.int64), -1, 0
    for c in np.flatnonzero(counts).tolist():
        if parts[c] > 1:
            first[c], shard, room = shard + 1, shard + int(parts[c]), 0
        else:
            if counts[c] > room:
                shard, room = shard + 1, shard_rows
            first[c], room = shard, room - int(counts[c])
    shards = shard + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            least = np.array([ids[0] for ids in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + least % parts[cell]).astype(np.int32)), pa.array(np.zeros(len(cell), np.int8)), *batch.columns, pa.nulls(len(cell), pa.list_(pa.int32()))], ["shard", "role", "cell", "ids", "v", "cells"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = int(index.share * total)
        for batch in batches:
            out: list[tuple] = []
            for i, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dim)):
                stops: dict[int, list[int]] = {}
                for cell in index.walk(q, counts, enough):
                    for part in range(int(parts[cell])):
                        stops.setdefault(int(first[cell]) + part, []).append(cell)
                out += [(s, 1, None, [i], q.tobytes(), cells) for s, cells in stops.items()]
            kinds = (pa.int32(), pa.int8(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "role", "cell", "ids", "v", "cells"])

    def scored(part: pa.RecordBatch, x: np.ndarray, size: np.ndarray, present: np.ndarray, cell: np.ndarray, ids: list[list[int]]) -> list[tuple[int, int, float]]:
        """A block of queries against the entries of their pairs in a shard."""
        out: list[tuple[int, int, float]] = []
        q = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(-1, dim)
        rough = size - 2 * (q @ x.T) + (q * q).sum(1)[:, None]
        for row, vector, (query,), cells in zip(rough, q, part.column(3).to_pylist(), part.column(5)):
            cells = cells.values.to_numpy()
            at = np.minimum(np.searchsorted(present, cells), len(present) - 1)
            opened = np.zeros(len(present), bool)
            opened[at[present[at] == cells]] = True
            near = np.flatnonzero(opened[cell])
            some = row[near]
            wanted = k + 1  # the query's own vector may be one of them
            while True:
                kept = near
                if len(near) > wanted:  # ties at the edge stay in
                    edge = np.partition(some, wanted - 1)[wanted - 1]
                    kept = near[some <= edge + 1e-9 * (1 + abs(edge) + vector @ vector)]
                if len(kept) == len(near) or len({i for n in kept.tolist() for i in ids[n]} - {query}) >= k:
                    break
                wanted *= 2  # entries of repeated ids fill the cut
            exact = np.sqrt(((x[kept] - vector) ** 2).sum(1)).tolist()
            least: dict[int, float] = {}
            for d, i in sorted((d, i) for d, n in zip(exact, kept.tolist()) for i in ids[n] if i != query):
                least.setdefault(i, d)
            out += [(query, i, d) for i, d in list(least.items())[:k]]
        return out

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh, x, size, present, cell, ids = None, [], None, None, None, None, []
        for batch in batches:
            shard_of, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple[int, int, float]] = []
            cuts = [0, *(np.flatnonzero(np.diff(shard_of.astype(np.int64) * 2 + role)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if now != shard_of[a]:
                    now, fresh, x = shard_of[a], [], None
                if role[a] == 0:
                    fresh.append(part)
                    continue
                if not fresh:  # a part of a large pair that no id fell into
                    continue
                if x is None:
                    x = np.frombuffer(b"".join(v for p in fresh for v in p.column(4).to_pylist()), np.float64).reshape(-1, dim)
                    present, cell = np.unique(np.concatenate([p.column(2).to_numpy() for p in fresh]), return_inverse=True)
                    ids = [i for p in fresh for i in p.column(3).to_pylist()]
                    size = (x * x).sum(1)
                step = max(1, BLOCK // len(x))
                for c in range(0, part.num_rows, step):
                    out += scored(part.slice(c, step), x, size, present, cell, ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    wide = "shard int, role byte, cell int, ids array<long>, v binary, cells array<int>"
    queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    met = held_rows.mapInArrow(place, wide).unionByName(queries.mapInArrow(visit, wide))
    tasks = max(1, min(shards, 20_000))
    dealt = met.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks))).sortWithinPartitions("shard", "role")
    found = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 100)
