"""Connected components of a graph that is held as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import checkpointed

#: Edges that one step of the local contraction holds.
HELD = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (child, parent) of one task as stars: each node under the smallest that it is joined with there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def stars() -> pa.RecordBatch:
        child = [x for x in up if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array([up[x] for x in child], pa.int64())], ["child", "parent"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > HELD:
            yield stars()
            up.clear()
    yield stars()


def _told(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node that can be reached.

    Edges are first contracted within tasks. Then stars alternate: small-star hangs every node and its smaller
    neighbours under the smallest of them, large-star moves the larger ones on to that one's own parent. Rows stay
    in proportion to the edges; a node's neighbours are never gathered, and after the contraction a node has at most one
    parent from each task, so a window over them is short. Rounds grow with the logarithm of the graph's diameter. Each round is one written table.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    now = checkpointed(pairs.mapInArrow(_contracted, "child long, parent long").distinct())
    seen = _told(now)
    while seen[0]:
        low = F.min("parent").over(Window.partitionBy("child"))
        hung = now.withColumn("low", low).select(F.explode(F.array(F.struct("child", F.col("low").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("low").alias("parent")))).alias("e"))
        small = hung.select("e.*").filter("child <> parent").distinct()
        above = small.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("top"))
        now = checkpointed(small.join(above, small.parent == above.node, "left").select("child", F.coalesce("top", "parent").alias("parent")).distinct())
        before, seen = seen, _told(now)
        if before == seen:
            break
    return now.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(now.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
