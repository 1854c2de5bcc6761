"""Encoding, record files and packing against the library itself."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from marlstone.llm import packing, records, wordtok
from marlstone.llm.storage import fresh_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_cached_encoding_equals_library(library):
    random.seed(5)
    odd = "aàÉé's 't'LL dçĿŉßſİΣ₂½٣一あ́ ­\x1c\x85 \t\n\r_-&%1 29!'''<|endoftext|>"
    plain = "".join(map(chr, range(32, 0x250))) + "'" * 50 + " " * 100
    texts = ["".join(random.choice(a) for _ in range(random.randint(0, 30))) for a in (odd, plain) for _ in range(4000)]
    tok = wordtok.WordTokenizer(PATH, cache_words=500)
    got = [x for part in wordtok.batches(texts, 2000) for x in tok.encode(part)]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_cache_holds_a_string_once(library):
    words = ["".join(random.choice("abcdefgh") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join(words[k : k + 10]) for k in range(0, 3000, 10)]
    tok = wordtok.WordTokenizer(PATH, cache_words=2000)
    for _ in range(2):
        got = [x for part in wordtok.batches(texts, 2000) for x in tok.encode(part)]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    held = [tok._cache, *(v for v in vars(tok._cache).values() if isinstance(v, dict))]
    assert sum(map(len, held)) <= 2 * 2000 + 400  # two generations, and the strings of one run


def test_checksums():
    assert records.crc32c([b"123456789", b""]).tolist() == [0xE3069283, 0]
    blobs = [bytes(random.randrange(256) for _ in range(n)) for n in (0, 1, 255, 256, 257, 1000, 5000)]
    for b, got in zip(blobs, records.crc32c(blobs).tolist()):
        crc = 0xFFFFFFFF
        for byte in b:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        assert got == crc ^ 0xFFFFFFFF
    framed = b"".join(records.frame(blobs))
    assert records.unframe(framed) == (blobs, len(framed))
    with pytest.raises(ValueError):
        records.unframe(framed[:-1] + bytes([framed[-1] ^ 1]))


def test_records_round_trip(spark, docs, library):
    path = fresh_dir(spark, "records")
    manifest = records.write_records(docs.repartition(3), path, PATH, shards=4)
    found = records.read_records(spark, path).orderBy("start").collect()
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert keys == sorted(keys) and sum(m["records"] for m in manifest) == docs.count()
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((r["doc_id"] or -1, ids(library, r["text"], 2).tobytes()) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in found) == want


def test_index_points_at_records(spark, docs):
    from pyarrow import fs

    path = fresh_dir(spark, "records")
    manifest = records.write_records(docs, path, PATH, shards=2)
    store, root = fs.FileSystem.from_uri(path)
    for m in manifest:
        index = np.frombuffer(store.open_input_file(f"{root}/{m['file'][:-4]}.idx").read(), "<u8")
        data = store.open_input_file(f"{root}/{m['file']}").read()
        assert len(index) == m["records"]
        for at in reversed(index.tolist()):
            assert records.unframe(data[at : at + 16 + int.from_bytes(data[at : at + 8], "little")])[0]


def test_shuffled_reads_follow_the_index(spark, docs, empty):
    path = fresh_dir(spark, "records")
    records.write_records(docs.unionByName(docs).repartition(3), path, PATH, shards=4)
    row = lambda r: (r["doc_id"], r["n_tokens"], bytes(r["ids"]))
    plain = [row(r) for r in records.read_records(spark, path).orderBy("start").collect()]
    orders = [[row(r) for r in records.read_shuffled(spark, path, seed, 3).collect()] for seed in (1, 1, 2)]
    assert all(sorted(o, key=str) == sorted(plain, key=str) for o in orders)
    assert orders[0] == orders[1] and orders[0] != orders[2] and plain not in orders
    records.write_records(empty, path + "-none", PATH)
    assert records.read_shuffled(spark, path + "-none").count() == 0


def test_one_id_with_many_rows_is_spread(spark):
    rows = spark.createDataFrame([(7, f"hot {k}") for k in range(300)] + [(8, "x")], "doc_id long, text string")
    manifest = records.write_records(rows, fresh_dir(spark, "hot"), PATH, shards=6)
    assert max(m["records"] for m in manifest) < 150


def test_empty_records(spark, empty):
    path = fresh_dir(spark, "none")
    assert records.write_records(empty, path, PATH) == [] and records.read_records(spark, path).count() == 0


def test_differencing():
    random.seed(2)
    sizes = [random.randint(1, 256) for _ in range(600)]
    found = packing.difference(sizes, 32)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(600)) and max(sums) - min(sums) <= 0.05 * max(sums)
    assert packing.pack([5, 5, 5], 9) and all(sum([5, 5, 5][i] for i in w) <= 9 for w in packing.pack([5, 5, 5], 9))
    with pytest.raises(ValueError):
        packing.pack([10], 9)


def test_packing(spark, docs, library):
    pieces = packing.digest(packing.pack_documents(docs, PATH, capacity=64, max_piece=16, group_windows=4)).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted((r["doc_id"] or -1, len(x), zlib.crc32(x[s : s + 1].tobytes())) for r in docs.collect() for x in [ids(library, r["text"], 1)] for s in range(len(x)))
    held = packing.pack_documents(docs, PATH, capacity=64, max_piece=16, group_windows=4).collect()
    got = sorted((p["doc_id"] or -1, p["doc_tokens"], zlib.crc32(bytes(p["ids"][4 * k : 4 * k + 4]))) for p in held for k in range(p["length"]))
    assert got == want


def test_empty_packing(empty):
    assert packing.pack_documents(empty, PATH).count() == 0
