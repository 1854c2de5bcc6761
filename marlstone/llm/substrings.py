"""Removal of repeated passages: exact counting of windows of words by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash among its runs of ``MER``
words. Consecutive windows with the same minimiser form a super-k-mer, which travels as one packed string to its
minimiser's bucket; equal windows have equal minimisers, so they meet there. A bucket sorts the windows of its
strings by hashes and compares neighbours of equal hash byte by byte, runs of them at once; that tells exactly which
occur more than once. Their places come back to their documents, where every word that such a window covers is removed.

A first pass over the texts counts minimisers: a task holds at most ``HELD`` counts, the smallest of which are taken
off all when there are more (so a count is short by a ``HELD``-th of the task's super-k-mers at most). Windows of a
minimiser that is very common (``HOT`` super-k-mers or more, and more than a ``MOST_HOT``-th of all) go each by the hash of
its own words instead, so that what surrounds a passage of a third of all documents spreads over all buckets.

A task merges equal strings before they travel: their windows are then known to repeat, one copy of the string
goes on, and the other places take any bucket. A passage that a third of all documents share so reaches its
bucket once per task, not once per document. Strings and places of a bucket are packed and compressed.

Defined results: null or empty texts have no words; texts shorter than a window lose nothing; rows are told apart by
id and text, so repeated rows all lose what they share; null ids are ids like others; an empty table gives
an empty result; other columns are carried along, and those named like an added column are replaced. Words are never
held one by one, so a very long text takes a few times its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried, checkpointed, numbered, scope, small_batches
from .textkit import Words, runs, windows

WINDOW, MER = 35, 4
#: Bytes of packed strings for a bucket and before a task sends them on; packed strings take about so many times the text.
BUCKET_BYTES, FLUSH_BYTES, EXPANSION = 24 << 20, 48 << 20, 3.2
MOST_BUCKETS, MOST_PARTITIONS = 1 << 20, 20_000
#: Super-k-mers that make a minimiser too common for one bucket, minimisers in that list, and what a task holds and tells.
HOT, MOST_HOT, HELD, TOLD = 1 << 16, 100_000, 1 << 18, 2

_PLACE = np.dtype([("doc", "<i8"), ("none", "u1"), ("text", "<i8"), ("start", "<i8"), ("windows", "<i8"), ("known", "u1")])


def super_kmers(words: Words, hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: each super-k-mer's text, first word (counted in the run), number of windows and minimiser."""
    counts = np.diff(words.first)
    sizes = np.maximum(counts - window + 1, 0)
    total = int(sizes.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = words.first[:-1][owner] + np.arange(total) - (np.cumsum(sizes) - sizes)[owner]
    low, span, want = windows(hashes, mer), 1, window - mer + 1
    while span < want:  # the least of `span` neighbours, doubled until it spans the window
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    value = low[at]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], at[begin], np.diff(np.append(begin, total)), value[begin]


_RUN = re.compile(rb"[\x20\x09-\x0D]+")


def plain(text: bytes) -> bytes:
    """The text's words, joined by one space."""
    return b" ".join(text.split()) if len(text) < 1 << 20 else _RUN.sub(b" ", text).strip(b" ")


class _Outbox:
    """Packed strings and places on their way to the buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.size, self.seen = 0, {}
        self.places: dict[int, list[list]] = {}
        self.strings: dict[int, list[bytes]] = {}
        self.extra: dict[int, list[tuple]] = {}

    def add(self, bucket: int, string: bytes, place: tuple) -> None:
        held = self.seen.get(string)
        if held is None:
            held = self.seen[string] = [*place, 0]
            self.places.setdefault(bucket, []).append(held)
            self.strings.setdefault(bucket, []).append(string)
            self.size += len(string) + 200
        else:
            held[-1] = 1
            self.extra.setdefault((place[2] + place[3]) % self.buckets, []).append((*place, 1))
            self.size += 100

    def flush(self) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        out: list[tuple[int, bytes]] = []
        for bucket in sorted(self.places.keys() | self.extra.keys()):
            strings = self.strings.get(bucket, [])
            places = [tuple(p) for p in self.places.get(bucket, [])] + self.extra.get(bucket, [])
            raw = np.array(places, _PLACE).tobytes()
            out.append((bucket, press.compress(len(strings).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + raw + b"\n".join(strings))))
            if sum(len(x) for _, x in out[-64:]) > 4 << 20:
                yield self._batch(out)
                out = []
        if out:
            yield self._batch(out)
        self.clear()

    @staticmethod
    def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "packed": pa.array([x for _, x in rows], pa.binary())})


def _equal_runs(p: np.ndarray, q: np.ndarray, begin: np.ndarray, stop: np.ndarray, data: bytes) -> bool:
    """Whether the windows p are those at q, byte by byte; neighbours that go on together are compared as one."""
    if not len(p):
        return True
    order = np.argsort(p)
    p, q = p[order], q[order]
    on = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1) & (begin[p[1:]] < stop[p[:-1]]) & (begin[q[1:]] < stop[q[:-1]])  # overlap: the same string
    first, last = np.flatnonzero(np.append(True, ~on)), np.flatnonzero(np.append(~on, True))
    view = memoryview(data)
    spans = zip(begin[p[first]].tolist(), stop[p[last]].tolist(), begin[q[first]].tolist(), stop[q[last]].tolist())
    return all(view[a:b] == view[c:d] for a, b, c, d in spans)


def _repeated(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window of the strings occurs elsewhere among them, and how many windows each string has."""
    prints, sizes, begins, stops, size = [], [], [], [], 0
    for run in runs(strings):
        words = Words(run)
        counts = np.maximum(np.diff(words.first) - window + 1, 0)
        at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        prints.append(windows(words.hashes(), window, 21)[at] if len(at) else np.zeros(0, np.uint64))
        begins.append(words.starts[at].astype(np.int64) + size)
        stops.append(words.ends[at + window - 1].astype(np.int64) + size)
        size += len(words.data)
        sizes.append(counts)
    first, begin, stop = np.concatenate(prints), np.concatenate(begins), np.concatenate(stops)
    order = np.argsort(first, kind="stable")
    same = first[order][1:] == first[order][:-1]
    out = np.zeros(len(first), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    data = b"".join(strings)
    if not _equal_runs(order[1:][same], order[:-1][same], begin, stop, data):  # different windows of one hash: told apart by their bytes
        again: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(out).tolist():
            again.setdefault(data[begin[k] : stop[k]], []).append(k)
        out[[k[0] for k in again.values() if len(k) == 1]] = False
    return out, np.concatenate(sizes)


def _count(packed: list[bytes], window: int) -> Iterator[np.ndarray]:
    """The places of a bucket's repeated windows, runs of them as one."""
    strings, places, known = [], [], []
    for blob in packed:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, size = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
        held = np.frombuffer(raw, _PLACE, size // _PLACE.itemsize, 16)
        places.append(held[:n])
        known.append(held[n:])
        strings += raw[16 + size :].split(b"\n") if n else []
    yield np.concatenate(known)
    if not strings:
        return
    place = np.concatenate(places)
    again, sizes = _repeated(strings, window)
    again |= np.repeat(place["known"].astype(bool), sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | ~again[:-1]
    begin = np.flatnonzero(edge & again)
    stop = np.flatnonzero(again & np.append((owner[1:] != owner[:-1]) | ~again[1:], True))
    out = place[owner[begin]].copy()
    out["start"] += within[begin]
    out["windows"] = stop - begin + 1
    yield out


def _survey(df: DataFrame, window: int, mer: int) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the minimisers that are too common for one bucket."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, size, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        fresh: list[np.ndarray] = []

        def merge() -> None:
            nonlocal values, counts
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *fresh]), return_counts=True)
            fresh.clear()
            both, at = np.unique(np.concatenate([values, new]), return_inverse=True)
            values, counts = both, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
            if len(values) > HELD:
                counts -= np.partition(counts, -HELD - 1)[-HELD - 1]
                values, counts = values[counts > 0], counts[counts > 0]

        for batch in rows:
            for texts in runs(batch.column(0).to_pylist()):
                words = Words(texts)
                fresh.append(super_kmers(words, words.hashes(), window, mer)[3])
                size, total = size + sum(map(len, texts)), total + len(fresh[-1])
                if sum(map(len, fresh)) > HELD:
                    merge()
        merge()
        often = counts >= TOLD
        told = values[often].view(np.int64)
        zeros = np.zeros(len(told), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None] + told.tolist(), pa.int64()), pa.array(np.append(total, counts[often])), pa.array(np.append(size, zeros))], ["value", "n", "bytes"])

    counted = checkpointed(df.select("text").mapInArrow(run, "value long, n long, bytes long").groupBy("value").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    whole = counted.filter("value IS NULL").first()
    least = max(HOT, (whole["n"] if whole else 0) // MOST_HOT + 1)
    hot = [r["value"] for r in counted.filter("value IS NOT NULL").filter(F.col("n") >= least).collect()]
    return (whole["bytes"] if whole else 0), np.array(sorted(hot), np.int64).view(np.uint64)


def _apart(owner: np.ndarray, at: np.ndarray, count: np.ndarray, value: np.ndarray, hashes: np.ndarray, hot: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers, those of hot minimisers cut into windows that go by their own hash."""
    far = np.isin(value, hot)
    if not far.any():
        return owner, at, count, value
    each = np.repeat(np.flatnonzero(far), count[far])
    begin = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(count[far]) - count[far], count[far])
    parts = ((owner[~far], owner[each]), (at[~far], begin), (count[~far], np.ones(len(each), np.int64)), (value[~far], windows(hashes, window, 23)[begin]))
    return tuple(np.concatenate(p) for p in parts)


def repeated_windows(df: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """Of rows (doc_id, text_hash, text as binary): where windows start that also start elsewhere, as (doc_id, text_hash, start, windows)."""
    size, hot = _survey(df, window, mer)
    buckets = max(1, min(MOST_BUCKETS, int(size * EXPANSION / BUCKET_BYTES) + 1))
    partitions = min(buckets, MOST_PARTITIONS)

    def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(buckets)
        for batch in rows:
            docs, hashes, k0 = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for texts in runs(batch.column(2).to_pylist()):
                words = Words(texts := list(map(plain, texts)))
                first = words.first.tolist()
                data, starts, ends = words.data.tobytes(), words.starts, words.ends
                of_words = words.hashes()
                owner, at, count, value = super_kmers(words, of_words, window, mer)
                if len(hot):
                    owner, at, count, value = _apart(owner, at, count, value, of_words, hot, window)
                begin, stop = starts[at].tolist(), ends[at + count + window - 2].tolist()
                for k, a, n, b, x, y in zip(owner.tolist(), at.tolist(), count.tolist(), (value % np.uint64(buckets)).tolist(), begin, stop):
                    doc = docs[k0 + k]
                    box.add(b, data[x:y], (doc or 0, doc is None, hashes[k0 + k], a - first[k], n))
                k0 += len(texts)
                if box.size >= FLUSH_BYTES:
                    yield from box.flush()
        yield from box.flush()

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for p in _count(held, window):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p["doc"], mask=p["none"].astype(bool)), pa.array(p["text"]), pa.array(p["start"]), pa.array(p["windows"])], ["doc_id", "text_hash", "start", "windows"])

        for batch in rows:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held:
                    yield from found()
                    held.clear()
                now = bucket
                held.append(packed)
        if held:
            yield from found()

    sent = df.select("doc_id", "text_hash", "text").mapInArrow(scatter, "bucket int, packed binary")
    dealt = sent.repartitionById(partitions, F.pmod(F.col("bucket"), F.lit(partitions)))
    return (dealt.sortWithinPartitions("bucket") if partitions < buckets else dealt).mapInArrow(gather, "doc_id long, text_hash long, start long, windows long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns in ``keep``, with n_words, n_removed and kept_text (the words left, joined by one space)."""
    if not 0 < mer <= window:
        raise ValueError("mer must lie between 1 and the window")
    small_batches(df.sparkSession)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("text"))
    with scope(df.sparkSession):
        found = repeated_windows(keyed, window, mer).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "windows")).alias("places"))
        places = checkpointed(found, lasting=True)
    places = places.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "places")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    kept = carried(df, (f.name for f in added), keep)
    schema = T.StructType([*df.select(*kept).schema.fields, *added])
    rows = df.select(*numbered(kept), F.col(id_col).cast("long").alias("__id"), raw.alias("__text"), F.xxhash64(raw).alias("__key"))
    met = rows.join(places, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__hash")), "left").drop("__id", "__key", "__doc", "__hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, found in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                text = plain(text)
                n_words.append(text.count(b" ") + 1 if text else 0)
                n_removed.append(0)
                if found:
                    change = np.zeros(n_words[-1] + 1, np.int64)
                    np.add.at(change, [p["start"] for p in found], 1)
                    np.add.at(change, [p["start"] + p["windows"] + window - 1 for p in found], -1)
                    stays = np.cumsum(change[:-1]) == 0
                    n_removed[-1] = n_words[-1] - int(np.count_nonzero(stays))
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                    edges = np.diff(np.concatenate([[False], stays, [False]]).astype(np.int8))
                    begin, stop = np.append(-1, spaces)[np.flatnonzero(edges == 1)] + 1, np.append(spaces, len(text))[np.flatnonzero(edges == -1) - 1]
                    text = b" ".join([text[a:b] for a, b in zip(begin.tolist(), stop.tolist())])
                texts.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], schema.names)

    return met.mapInArrow(run, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that start anywhere else."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i FROM cut WHERE len(words) >= 35),
wins AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS w FROM starts JOIN cut USING (doc_id)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM twice),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM cut),
left_ AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT cut.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN left_ USING (doc_id)
"""
