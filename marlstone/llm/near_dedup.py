"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of five lower-cased words. Each of ``REGISTERS`` registers keeps the
smallest of the set's exponential variates of rate ``RATE``, exponentially spaced and truncated:
floor(1 - log_b(minimum)), within two bytes. Equal registers are about as likely as the sets' similarity.

1. Documents with equal sets form a class; one stands for all, so copies are never paired.
2. Bands of four registers put the classes into buckets. At a similarity of 0.75 two classes miss each other
   in all 36 bands with probability 1e-6.
3. Each bucket pairs its smallest id with the others: one pair per member, never all pairs. The similarity of a pair
   is estimated jointly from both sketches and set sizes by maximum likelihood; pairs within five standard errors
   of the threshold, or above, are verified on the full sets.
4. Links give components. A bucket whose members still lie in different components may hide further links: members
   whose sketches agree enough with one of another component are brought together with their texts, and every two
   of different components are compared on full sets. A link is kept where it joins components, so a block of
   s members returns fewer than s links. Buckets of any size are dealt out in blocks.

Classes are named by 64 bits of their set's key, not by ids, so rows that share an id and differ in their text are
documents of their own. Shingles are compared by 64-bit hashes of their words throughout, on the full sets.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and stays; rows of
a null id take no part in links, get a null component and stay; repeated rows share a component, and in the report all
with its smallest id count as kept. ``drop_near`` keeps exactly one row of each component, that of its smallest id
(of several with that id one of the smallest text hash); an empty table gives an empty result; other columns,
whatever their names, are ignored by the report and carried along by ``drop_near``. Texts are cut into words in segments,
so a long one takes 8 bytes for each of its words and a few for each byte of a segment.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordtok
from .graph import components
from .storage import BATCH_BYTES, carried, checkpointed, numbered, scope, small_batches
from .textkit import Words, mixed, noise, runs, windows

WIDTH, REGISTERS, ROWS, BASE, RATE, TOP = 5, 144, 4, 1.001, 20.0, 65534
PERCENT, ERRORS = 75, 5
#: Members of one block of a bucket, and members verified against one copy of their centre's text.
BLOCK, SHARE = 1024, 256
#: Bits of the filter that spares documents without a candidate the shuffle: at most 2**20 broadcast rows.
MAX_BITS = 1 << 26

_MULTIPLIERS = noise(REGISTERS, 11) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a run of texts, and where each text's begin; repeated ones are not yet merged."""
    words = Words(texts, lower=True)
    h, counts = words.hashes(), np.diff(words.first)
    long = windows(h, WIDTH)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = words.first[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    out = np.zeros(int(first[-1]), np.uint64)
    whole = counts[owner] >= WIDTH
    out[whole] = long[at[whole]]
    for k in np.flatnonzero((counts > 0) & (counts < WIDTH)).tolist():
        part = h[words.first[k] : words.first[k + 1]]
        out[first[k]] = windows(part, len(part), 100 + len(part))[0]
    return out, first


def registers(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers for each text whose set isn't empty."""
    held = np.flatnonzero(np.diff(first))
    most = np.empty((REGISTERS, len(held)), np.uint64)
    for a in range(0, len(held), 256):  # a stretch at a time stays in the processor's cache
        some = held[a : a + 256]
        part = shingles[first[some[0]] : first[some[-1] + 1]]
        begin = first[some] - first[some[0]]
        for i, c in enumerate(_MULTIPLIERS):
            most[i, a : a + 256] = np.maximum.reduceat(part * c, begin)
    smallest = (np.float64(2.0**64) - most.astype(np.float64)) / 2.0**64  # least of uniform variates
    minimum = -np.log1p(-np.clip(smallest, 2.0**-60, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, TOP).astype("<u2").T


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of each pair of sketches, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    spaced = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * spaced) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0) for n, x in ((more, up), (less, down), (same, 1 - up - down))]
        return sum(terms)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _least_likely(percent: int) -> float:
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / REGISTERS) ** 0.5


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_key (16 bytes that tell sets apart), registers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordtok.release()
        for batch in rows:
            ids, hashes, at = batch.column(0), batch.column(1), 0
            for texts in runs(batch.column(2).to_pylist()):
                shingles, first = shingle_sets(texts)
                regs = iter(registers(shingles, first))
                sizes, keys, held = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    distinct = np.unique(shingles[a:b])
                    sizes.append(len(distinct))
                    keys.append(np.array([np.bitwise_xor.reduce(mixed(distinct)), mixed(distinct ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes() if b > a else None)
                    held.append(next(regs).tobytes() if b > a else None)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), hashes.slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "registers"])
                at += len(texts)

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, registers binary")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.col(text_col).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("text"))


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow the similarity."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    least = _least_likely(percent)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
                keep = likeliest(a, b, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float)) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _flagged(rows: DataFrame, key: str, keys: DataFrame, most: int) -> DataFrame:
    """The rows with ``maybe``: false means that a row's key isn't among the keys (one column). The filter that tells
    it has a bounded size and is broadcast, so nothing shuffles; a fuller one lets more rows pass."""
    bits = 1 << max(10, min(MAX_BITS.bit_length() - 1, (most * 32).bit_length()))

    def place(c) -> tuple:
        h = F.xxhash64(c, F.lit(5))
        return F.pmod(h, F.lit(bits // 64)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int"))

    word, mask = place(F.col(keys.columns[0]))
    bloom = keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    word, mask = place(F.col(key))
    return rows.join(F.broadcast(bloom), word == F.col("word"), "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask) != 0, F.lit(False))).drop("word", "bits")


def _needed(texts: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, text) of those rows that may have one of the ids; of repeated rows one."""
    return _flagged(texts, "id", ids, most).filter("maybe").groupBy("id").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b), those whose full sets are similar enough. ``texts`` has a row (id, text) for every id in pairs.

    The texts of a's partners are brought to copies of a's text, ``SHARE`` to a copy, however many there are.
    """
    many = checkpointed(pairs.groupBy("a").agg((F.count(F.lit(1)) / SHARE).cast("int").alias("last")))
    members = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("part"), F.col("b").alias("id"), F.lit(1).alias("role"))
    centres = many.select("a", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"), F.col("a").alias("id"), F.lit(0).alias("role"))
    wanted = members.unionByName(centres)
    brought = wanted.join(_needed(texts, wanted.select("id"), 2 * pairs.count()), "id").repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.uint64)
        for batch in rows:
            a, part, ids, role = (batch.column(k).to_numpy() for k in range(4))
            out, k = [], 0
            for texts in runs(batch.column(4).to_pylist()):
                shingles, first = shingle_sets(texts)
                for i in range(len(texts)):
                    mine = np.unique(shingles[first[i] : first[i + 1]])
                    if role[k] == 0:
                        at, centre = (a[k], part[k]), mine
                    elif at == (a[k], part[k]):
                        both = np.isin(mine, centre, assume_unique=True, kind="sort").sum() if len(mine) else 0
                        if 100 * both >= percent * (len(mine) + len(centre) - both):
                            out.append((a[k], ids[k]))
                    k += 1
            if out:
                found = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return brought.select("a", "part", "id", "role", "text").mapInArrow(run, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of sorted rows with equal values in the first three columns."""
    carried: list[pa.RecordBatch] = []  # the last run, which the next batch may go on with
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            carried.append(batch)
            if all(batch.column(k)[-1] == carried[0].column(k)[0] for k in range(3)):
                continue  # the run may go on; its batches are put together once
        if not carried:
            continue
        table = pa.Table.from_batches(carried).combine_chunks()
        keys = [table.column(k).to_numpy() for k in range(3)]
        cuts = [*np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])).tolist(), table.num_rows]
        if batch is not None:
            carried, cuts = table.slice(cuts[-2]).to_batches(), cuts[:-1]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)


def _open_members(members: DataFrame, percent: int) -> DataFrame:
    """Of (bucket, rep, root, n, registers), the members that may resemble one of another component of their bucket.

    A bucket is dealt out in pairs (i, j) of blocks, so that any two members meet in one of them.
    """
    spread = checkpointed(members.groupBy("bucket").agg(F.floor((F.count(F.lit(1)) - 1) / BLOCK).cast("int").alias("last")))
    mine = F.pmod(F.xxhash64("rep"), F.col("last") + 1).cast("int")
    dealt = members.join(spread, "bucket").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "root", "n", "registers")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    # estimated similarity and share of equal registers go together; a tenth less than needed loses nothing
    equal = _least_likely(percent) * REGISTERS * 0.9

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows):
            root, n = (block.column(k).to_numpy() for k in (4, 5))
            kinds, counts = np.unique(root, return_counts=True)
            if len(kinds) < 2:
                continue
            regs = np.frombuffer(b"".join(block.column(6).to_pylist()), "<u2").reshape(-1, REGISTERS)
            near = np.zeros(len(root), bool)
            for x in np.flatnonzero(root != kinds[counts.argmax()]).tolist():
                y = np.flatnonzero((root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
                y = y[np.count_nonzero(regs[y] == regs[x], axis=1) >= equal]
                near[y] = True
                near[x] |= len(y) > 0
            if near.any():
                yield from block.select(["bucket", "i", "j", "rep", "root"]).filter(pa.array(near)).to_batches()

    return dealt.mapInArrow(run, "bucket long, i int, j int, rep long, root long")


def _open_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of each block, found on full sets: every pair of different components is
    compared, and a link is returned where it joins two components that were still apart, so at most one per member."""
    brought = members.join(_needed(texts, members.select(F.col("rep").alias("id")), members.count()), F.col("rep") == F.col("id"))
    brought = brought.select("bucket", "i", "j", "rep", "root", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows):
            rep, root = block.column(3).to_numpy(), block.column(4).to_numpy().copy()
            sets = []
            for part in runs(block.column(5).to_pylist()):
                shingles, first = shingle_sets(part)
                sets += [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:])]
            sizes = np.array([len(x) for x in sets])
            begin = np.cumsum(sizes) - sizes
            words, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            mark, out = np.zeros(len(words), bool), []
            kinds, counts = np.unique(root, return_counts=True)
            for x in np.flatnonzero(root != kinds[counts.argmax()]).tolist():
                own = numbers[begin[x] : begin[x] + sizes[x]]
                mark[own] = True
                both = np.add.reduceat(mark[numbers], begin, dtype=np.int64)
                mark[own] = False
                for y in np.flatnonzero(100 * both >= percent * (sizes + sizes[x] - both)).tolist():
                    if root[y] != root[x]:
                        out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                        root[root == root[y]] = root[x]
            if out:
                both = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return brought.mapInArrow(run, "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per row: doc_id, text_hash, n_shingles, component_id."""
    small_batches(df.sparkSession, BATCH_BYTES)
    with scope(df.sparkSession):
        rows = checkpointed(sketch(df, id_col, text_col), lasting=True)
        linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        # a class is named by the smallest of its rows, whose text stands for all
        least = F.min(F.struct("doc_id", "text_hash")).alias("least")
        classes = linked.groupBy("set_key").agg(least, F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
        classes = checkpointed(classes.select("set_key", F.xxhash64("least.doc_id", "least.text_hash").alias("rep"), F.col("least.doc_id").alias("doc_id"), "n", "registers"))
        texts = _texts(df, id_col, text_col).filter("doc_id IS NOT NULL").select(F.xxhash64("doc_id", "text_hash").alias("id"), "text")
        size = 2 * ROWS
        bands = classes.select("rep", F.explode(F.array(*[F.xxhash64(F.substring("registers", 1 + size * k, size), F.lit(k)) for k in range(REGISTERS // ROWS)])).alias("bucket"))
        buckets = checkpointed(bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
        stars = bands.join(buckets, "bucket").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        edges = checkpointed(_verified(checkpointed(_screened(stars, classes, percent)), texts, percent))
        roots = checkpointed(components(edges))
        members = bands.join(buckets.filter("members > 2"), "bucket").filter("rep <> a").join(roots, F.col("rep") == F.col("node"), "left")
        members = checkpointed(members.select("bucket", "rep", F.coalesce("root", "rep").alias("root")))
        undecided = checkpointed(members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket"))
        left = members.join(undecided, "bucket", "left_semi").join(classes.select("rep", "n", "registers"), "rep")
        more = checkpointed(_open_links(checkpointed(_open_members(left, percent)), texts, percent))
        if not more.isEmpty():
            roots = checkpointed(components(edges.unionByName(more)))
        rooted = checkpointed(classes.join(roots, F.col("rep") == F.col("node"), "left").select("set_key", "doc_id", "root"))
        joined = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component"))
        named = checkpointed(rooted.join(joined, "root", "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id")), lasting=True)
    out = linked.join(named, "set_key").select("doc_id", "text_hash", "n_shingles", "component_id")
    return out.unionByName(rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _grouped(df, id_col, text_col, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with the input's columns: one row of each component, and all without words or of a null id.

    A filter of bounded size tells which rows may have to go; only these are joined, the others pass straight through.
    """
    with scope(df.sparkSession):
        grouped = checkpointed(_grouped(df, id_col, text_col, percent).filter("doc_id IS NOT NULL AND n_shingles > 0"))
        key = F.xxhash64("doc_id", "text_hash")
        stays = grouped.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select(F.xxhash64("least.doc_id", "least.text_hash").alias("stays"))
        rows = grouped.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        # rows that go, and those that stay but are there several times
        told = rows.join(stays, F.col("key") == F.col("stays"), "left").filter("stays IS NULL OR rows > 1")
        told = checkpointed(told.select("key", F.col("stays").isNull().alias("goes")), lasting=True)
    kept = carried(df, ())
    named = df.select(F.struct(*numbered(kept)).alias("row"), F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("binary"))).alias("key"), F.col(id_col).isNotNull().alias("has"))
    named = _flagged(named, "key", told.select("key"), told.count())
    straight = named.filter(~(F.col("maybe") & F.col("has"))).select("row.*")
    asked = named.filter(F.col("maybe") & F.col("has")).join(told.withColumnRenamed("key", "told"), F.col("key") == F.col("told"), "left")
    once = asked.filter("goes IS NULL").select("row.*")
    one = asked.filter("NOT goes").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return straight.unionByName(once).unionByName(one).toDF(*df.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS s FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
