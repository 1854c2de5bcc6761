"""Token sequences in length-delimited binary record files, with a separate offset index.

A record is: its length (8 bytes, little-endian), the masked CRC-32C of those 8 bytes, the data, and the masked
CRC-32C of the data. The data are a 1-byte flag (1: the document has an id), the id (8 bytes) and the token ids
(2 bytes each if the vocabulary allows, else 4). Beside ``shard-N.rec`` stands ``shard-N.idx``: the offset of
every record as 8 bytes, so that a reader can fetch records in any order without scanning the file: ``read_shuffled``
deals the index entries out by a seeded hash and fetches each record by its offset.

Shards hold ascending ranges of document ids. Their bounds come from the ids alone, in one cheap pass; texts are
read once, encoded where they are, and only packed ids shuffle. An id that fills several ranges by itself is
dealt out over them by a hash of its tokens. Files are written under a temporary name and moved into place:
a task that runs again writes the same bytes, so lost executors do no harm.

Defined results: a null or empty text becomes a record of the end id alone; null ids come first; rows of equal
id are ordered by a hash of their tokens; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordtok
from .storage import fresh_dir, small_batches, until_exit

END_ID = 2
#: Strings and words in a generation of the encoder's cache: this operator holds little else.
CACHE_WORDS = 640_000
#: Fixed by the checksum's definition: the reflected Castagnoli polynomial and the mask's constant.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
_LANE = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_TABLE = _byte_table()


def _step(crc: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)


def _shift_tables() -> list[np.ndarray]:
    """For k = 0, 1, ..: four tables of 256 that move a checksum past 2**k zero bytes."""
    one = _step(np.uint32(1) << np.arange(32, dtype=np.uint32), np.uint32(0))  # images of the 32 bits
    out = []
    for _ in range(40):
        tables = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            at = np.arange(256, dtype=np.uint32)
            tables[bit // 8] ^= np.where(at >> (bit % 8) & 1, one[bit], 0).astype(np.uint32)
        out.append(tables)
        one = _moved(one, tables)
    return out


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


_SHIFT = _shift_tables()


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each blob, all at once: lanes of 256 bytes run in parallel and are then combined."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    lanes = -(-sizes // _LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    grid = np.zeros(int(first[-1]) * _LANE, np.uint8)
    for b, n, f, stop in zip(blobs, sizes.tolist(), first[:-1].tolist(), first[1:].tolist()):
        grid[stop * _LANE - n : stop * _LANE] = np.frombuffer(b, np.uint8)  # zeros in front leave the state at zero
    crc = np.zeros(int(first[-1]), np.uint32)
    # columns that are empty in all lanes, as with short blobs, leave the state at zero
    for row in np.ascontiguousarray(grid.reshape(-1, _LANE).T[max(0, _LANE - int(sizes.max(initial=0))) :]):
        crc = _step(crc, row)
    # fold the lanes of each blob pairwise from its end; distances double each time
    owner, left = np.repeat(np.arange(len(blobs)), lanes), lanes.copy()
    place = np.repeat(first[1:], lanes) - 1 - np.arange(len(crc))  # 0: the blob's last lane
    power = 8  # 2**8 bytes to a lane
    while len(crc) and left.max() > 1:
        odd = np.flatnonzero(place & 1)
        crc[odd + 1] ^= _moved(crc[odd], _SHIFT[power])
        keep = np.flatnonzero(place & 1 == 0)
        crc, owner, place, left, power = crc[keep], owner[keep], place[keep] >> 1, (left + 1) >> 1, power + 1
    out = np.zeros(len(blobs), np.uint32)
    out[owner] = crc
    start, k, rest = np.full(len(blobs), 0xFFFFFFFF, np.uint32), 0, sizes.copy()
    while rest.any():
        some = np.flatnonzero(rest & 1)
        start[some] = _moved(start[some], _SHIFT[k])
        rest, k = rest >> 1, k + 1
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as stored: rotated and offset, so that checksums of checksums stay apart."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    for_head, for_data = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + a.tobytes() + p + b.tobytes() for h, a, p, b in zip(heads, for_head.astype("<u4"), payloads, for_data.astype("<u4"))]


def unframe(buffer: bytes, at: int = 0) -> tuple[list[bytes], int]:
    """The payloads of the whole records from a place on, and where the next one starts. Raises on a wrong checksum."""
    heads, payloads, sums = [], [], []
    while at + 12 <= len(buffer):
        (n,) = struct.unpack_from("<Q", buffer, at)
        if at + 16 + n > len(buffer):
            break
        heads.append(buffer[at : at + 8])
        payloads.append(buffer[at + 12 : at + 12 + n])
        sums.append((struct.unpack_from("<I", buffer, at + 8)[0], struct.unpack_from("<I", buffer, at + 12 + n)[0]))
        at += 16 + n
    if payloads:
        want = np.array(sums, np.uint32)
        if (masked(crc32c(heads)) != want[:, 0]).any() or (masked(crc32c(payloads)) != want[:, 1]).any():
            raise ValueError("a record's checksum is wrong")
    return payloads, at


def _payload(doc: int | None, ids: bytes) -> bytes:
    return struct.pack("<Bq", doc is not None, doc or 0) + ids


def _bounds(df: DataFrame, id_col: str, shards: int) -> np.ndarray:
    """Inner bounds of the shards' ranges of ids, equal ones where an id fills several."""
    if shards < 2:
        return np.zeros(0, np.int64)
    at = [k / shards for k in range(1, shards)]
    found = df.select(F.percentile_approx(F.col(id_col).cast("long"), at, max(10_000, 20 * shards)).alias("at")).first()["at"]
    return np.array(found or [], np.int64)


def write_records(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Writes the table's sequences and returns the manifest: one entry per shard, in order, with its first token's number.

    ``shards`` defaults to the number of the table's scan tasks, so a shard holds about what one task reads.
    """
    spark = df.sparkSession
    small_batches(spark)
    shards = max(1, shards or df.select(id_col, text_col).rdd.getNumPartitions())
    bounds = _bounds(df, id_col, shards)

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = wordtok.load(tokenizer, CACHE_WORDS)
        narrow = "<u2" if max(tok.ids, end_id + 1) <= 1 << 16 else "<u4"
        for batch in rows:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in wordtok.batches(batch.column(1).to_pylist()):
                docs = ids[at : at + len(texts)]
                at += len(texts)
                packed = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(narrow).tobytes() for x in tok.encode(texts)]
                tie = [zlib.crc32(x) for x in packed]
                keys = np.array([np.iinfo(np.int64).min if d is None else d for d in docs], np.int64)
                low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
                shard = low + np.array(tie) % np.maximum(high - low, 1)  # an id that is several bounds spreads over their shards
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(docs, pa.int64()), pa.array(tie, pa.int64()), pa.array(packed, pa.binary())], ["shard", "doc_id", "tie", "ids"])

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        wide = wordtok.load(tokenizer)
        width = 2 if max(wide.ids, end_id + 1) <= 1 << 16 else 4
        now, out, index, done, tokens, temp = None, None, [], 0, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{root}/shard-{now:08d}"
            with store.open_output_stream(f"{temp}.idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            for kind in ("rec", "idx"):
                if store.get_file_info(f"{name}.{kind}").type != fs.FileType.NotFound and not isinstance(store, fs.LocalFileSystem):
                    store.delete_file(f"{name}.{kind}")  # other stores' move does not replace
                store.move(f"{temp}.{kind}", f"{name}.{kind}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "records": pa.array([len(index)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "bytes": pa.array([done], pa.int64())})

        for batch in rows:
            shard, docs, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard[a] != now:
                    if now is not None:
                        yield close()
                    now, index, done, tokens, temp = int(shard[a]), [], 0, 0, f"{root}/.shard-{int(shard[a]):08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{temp}.rec")
                for run in range(a, b, 500):
                    for record, x in zip(frame([_payload(d, x) for d, x in zip(docs[run : min(b, run + 500)], ids[run : min(b, run + 500)])]), ids[run : min(b, run + 500)]):
                        index.append(done)
                        out.write(record)
                        done += len(record)
                        tokens += len(x) // width
        if now is not None:
            yield close()

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    coded = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    manifest, first = [], 0
    for r in sorted(dealt.mapInArrow(write, "shard int, records long, tokens long, bytes long").collect(), key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"file": f"shard-{r['shard']:08d}.rec", "first_token": first})
        first += r["tokens"]
    tok = wordtok.load(tokenizer)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": 2 if max(tok.ids, end_id + 1) <= 1 << 16 else 4, "shards": manifest}).encode())
    return manifest


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: doc_id, start (number of its first token), n_tokens, ids (little-endian uint32)."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        held = json.loads(f.read())
    width = held["width"]

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in rows:
            for name, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    rest = b""
                    while more := f.read(4 << 20):
                        payloads, at = unframe(rest := rest + more)
                        rest = rest[at:]
                        docs = [struct.unpack_from("<Bq", p) for p in payloads]
                        ids = [np.frombuffer(p, f"<u{width}", offset=9).astype("<u4") for p in payloads]
                        sizes = np.array([len(x) for x in ids], np.int64)
                        starts = first + np.cumsum(sizes) - sizes
                        first += int(sizes.sum())
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d if has else None for has, d in docs], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
                    if rest:
                        raise ValueError(f"{name} ends within a record")

    shards = held["shards"]
    files = spark.createDataFrame([(s["shard"], s["file"], s["first_token"]) for s in shards], "shard int, file string, first long")
    return files.repartitionById(max(1, len(shards)), F.pmod(F.col("shard"), F.lit(max(1, len(shards))))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """The documents (doc_id, n_tokens, ids) in an order that the seed fixes, over all shards alike.

    Only index entries shuffle. A partition is a range of their hashes, in order; its records are fetched by offset,
    those of a batch file by file in ascending order.
    """
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        held = json.loads(f.read())
    width, shards = held["width"], held["shards"]
    count = max(1, partitions or len(shards))

    def entries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in rows:
            for shard, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/shard-{shard:08d}.idx") as f:
                    first = np.frombuffer(f.read(), "<u8").astype(np.int64)
                ends = np.append(first[1:], size)
                for a in range(0, len(first), 100_000):
                    part = first[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part), pa.array(ends[a : a + 100_000] - part)], ["shard", "offset", "size"])

    def fetch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in rows:
            for a in range(0, batch.num_rows, 256):
                shard, offset, size = (batch.column(k)[a : a + 256].to_numpy() for k in range(3))
                found: list[bytes] = [b""] * len(shard)
                for one in np.unique(shard).tolist():
                    with store.open_input_file(f"{root}/shard-{one:08d}.rec") as f:
                        for k in sorted(np.flatnonzero(shard == one).tolist(), key=lambda k: offset[k]):
                            found[k] = f.read_at(int(size[k]), int(offset[k]))
                payloads, end = unframe(whole := b"".join(found))
                if len(payloads) != len(found) or end != len(whole):
                    raise ValueError("an index entry does not fit its file")
                docs = [struct.unpack_from("<Bq", p) for p in payloads]
                ids = [np.frombuffer(p, f"<u{width}", offset=9).astype("<u4") for p in payloads]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d if has else None for has, d in docs], pa.int64()), "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    files = spark.createDataFrame([(s["shard"], s["bytes"]) for s in shards], "shard int, bytes long").repartitionById(max(1, len(shards)), F.pmod(F.col("shard"), F.lit(max(1, len(shards)))))
    key = F.xxhash64("shard", "offset", F.lit(seed))
    dealt = files.mapInArrow(entries, "shard int, offset long, size long").withColumn("key", key)
    at = F.floor(F.shiftrightunsigned("key", 33) * count / F.lit(2.0**31)).cast("int")
    # the upper bits give the partition, and the order within it follows all of them
    dealt = dealt.repartitionById(count, F.least(at, F.lit(count - 1))).sortWithinPartitions(F.shiftrightunsigned("key", 33), "key", "shard", "offset")
    return dealt.select("shard", "offset", "size").mapInArrow(fetch, "doc_id long, n_tokens long, ids binary")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's record, as read back from the files."""
    import public_tokenizers

    path = fresh_dir(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    until_exit(spark, path)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
