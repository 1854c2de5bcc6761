"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import exact_dedup, near_dedup, substrings, textkit
from marlstone.llm.graph import components

from ..oracle import compare, connect


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_filter_knows_every_repeated_hash(spark):
    """No copy is missed, and of many unique rows nearly all pass straight through."""
    rows = spark.range(20_000).selectExpr("sha2(CAST(IF(id < 2000, id % 900, id) AS string), 256) AS sha", "id < 2000 AND id % 900 + 900 < 2000 AS copied")
    found = exact_dedup.probe(rows, "sha", exact_dedup.repeated_filter(rows, "sha")).groupBy("copied", "maybe_copy").count().collect()
    count = {(r["copied"], r["maybe_copy"]): r["count"] for r in found}
    assert (True, False) not in count and count.get((False, True), 0) < 0.06 * 20_000 and sum(count.values()) == 20_000


def test_first_pass_sends_no_rows(docs):
    plan = exact_dedup.copy_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 1 << 10])
def test_copy_groups(docs, max_bits):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
    found = exact_dedup.copy_groups(docs, max_bits=max_bits).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)


def test_saturated_filter_stays_exact(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 1000 AS string) AS text")
    found = exact_dedup.copy_groups(rows, slots_per_row=1, max_bits=1 << 15, max_slots=1 << 9)
    assert found.filter("kept").count() == 1000 and found.filter("group_size <> 3 OR keep_id <> doc_id % 1000").count() == 0


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [norm(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in docs.collect()})


def test_empty_tables(empty):
    assert exact_dedup.copy_groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == near_dedup.drop_near(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    """For each row the smallest id that can be reached over links between rows, None for rows without an id."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [None if i is None else least[root(k)] for k, (i, _) in enumerate(rows)]


def check_near(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((i, len(shingles(t)), c, i == c) for (i, t), c in zip(rows, brute_near(rows))), key=str)
    assert sorted((tuple(r) for r in near_dedup.near_groups(df).collect()), key=str) == want


def test_near_groups(docs):
    check_near(docs)


def test_chains_of_near_copies(spark):
    """Each copy changes a few words of one before it, so most links are not to the group's first document."""
    random.seed(4)
    rows, texts = [], [[f"t{random.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    for k in range(160):
        w = list(random.choice(texts))
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"n{random.randrange(10**6)}"
        texts.append(w)
        rows.append((k, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_runs_go_on_over_batches():
    keys = [(b, i, 0) for b in range(4) for i in range(3) for _ in range((1, 50, 7)[i])]
    table = pa.Table.from_arrays([*(pa.array(c) for c in zip(*keys)), pa.array(range(len(keys)))], ["bucket", "i", "j", "rep"])
    for size in (1, 3, 10, 1000):
        blocks = [b.to_pydict() for b in near_dedup._blocks(iter(table.to_batches(size)))]
        assert [len(b["rep"]) for b in blocks] == [1, 50, 7] * 4 and sum((b["rep"] for b in blocks), []) == list(range(len(keys)))


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SHARE", 4)
    random.seed(9)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(random.randint(0, 7)):
            w[random.randrange(100)] = f"n{random.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def check_drop(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = near_dedup.drop_near(df)
    assert kept.columns == df.columns
    want = [i for i, t in rows if i is None or not shingles(t)] + list({c for (i, t), c in zip(rows, brute_near(rows)) if i is not None and shingles(t)})
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_drop_near(docs):
    check_drop(docs)


def test_ids_that_repeat(spark):
    """Rows of one id with equal, near and different texts; the least id of a component several times."""
    base, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, base), (1, base), (2, base), (1, base + " more"), (1, other), (3, other), (3, other.upper()), (0, None), (0, ""), (4, "a b"), (4, "A  B"), (None, base), (None, base)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, __gone int, key int, row int")
    check_near(df)
    check_drop(df)


def test_long_texts_in_segments(monkeypatch):
    random.seed(12)
    texts = [" ".join("x" * random.choice([1, 2, 5, 90]) + random.choice(["a", "B", "é"]) for _ in range(random.randint(0, 60))).encode() for _ in range(30)] + [b"", b" ", b"Long" * 50, b"\t\n  a"]
    for lower in (False, True):
        whole = textkit.Words(texts, lower)
        want = whole.hashes(), whole.starts, whole.ends, whole.first, textkit.windows(whole.hashes(), 3)
        for segment in (1, 7, 64):
            monkeypatch.setattr(textkit, "SEGMENT", segment)
            cut = textkit.Words(texts, lower)
            assert all((a == b).all() for a, b in zip(want, (cut.hashes(), cut.starts, cut.ends, cut.first, textkit.windows(cut.hashes(), 3))))
            assert (cut.hashes()[cut.first[5] : cut.first[6]] == textkit.Words([texts[5]], lower).hashes()).all()
            monkeypatch.undo()
    found = re.findall(rb"[^\x20\x09-\x0D]+", texts[3])
    assert [whole.data[a:b].tobytes() for a, b in zip(whole.starts[whole.first[3] : whole.first[4]], whole.ends[whole.first[3] :])] == found


def test_likelihood_is_near_the_truth():
    random.seed(6)
    for share in (0.3, 0.75, 0.95):
        n = 600
        both = int(2 * n * share / (1 + share))
        a = [f"s{k}" for k in range(n)]
        b = a[:both] + [f"r{k}" for k in range(n - both)]
        rng = np.random.default_rng(1)
        h = {w: rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for w in {*a, *b}}
        x, y = (near_dedup.registers(np.array([h[w] for w in s], np.uint64), np.array([0, len(s)])) for s in (a, b))
        assert abs(near_dedup.likeliest(x, y, np.array([n]), np.array([n]))[0] - share) < 0.15


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got.get(n, n) == root(n) for n in up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width):
    starts = {}
    for k, t in enumerate(rows):
        w = words(t)
        for i in range(len(w) - width + 1):
            starts.setdefault(tuple(w[i : i + width]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + width))
    return [" ".join(x for j, x in enumerate(words(t)) if j not in gone[k]) for k, t in enumerate(rows)]


@pytest.mark.parametrize("width, mer, flush, hot", [(35, 4, 48 << 20, 1 << 16), (35, 4, 48 << 20, 10), (6, 2, 300, 2), (3, 3, 1, 1 << 16), (1, 1, 48 << 20, 5)])
def test_repeats(spark, docs, monkeypatch, width, mer, flush, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "TOLD", 2)
    monkeypatch.setattr(substrings, "FLUSH_BYTES", flush)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    random.seed(width)
    passage = " ".join(f"p{k}" for k in range(40))
    extra = [(100 + k, " ".join(f"e{random.randrange(50)}" for _ in range(60)) + (f" {passage} " if k % 3 == 0 else " ") + " ".join(f"e{random.randrange(3)}" for _ in range(30)), "s", "x", 1, "x") for k in range(40)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3)
    rows = df.collect()
    want = sorted(brute_repeats([r["text"] for r in rows], width))
    found = substrings.remove_repeats(df, window=width, mer=mer).collect()
    assert sorted(r["kept_text"] for r in found) == want
    assert all(r["n_words"] - r["n_removed"] == len(words(r["kept_text"])) for r in found)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With hashes that nearly all collide, the bytes decide."""
    random.seed(5)
    monkeypatch.setattr(substrings, "windows", lambda h, width, seed=3: textkit.windows(h, width, seed) % np.uint64(3))
    for _ in range(30):
        strings = [" ".join(random.choice("ab") for _ in range(random.randint(0, 9))).encode() for _ in range(12)]
        again, sizes = substrings._repeated(strings, 4)
        every = [tuple(w[i : i + 4]) for w in (s.split() for s in strings) for i in range(len(w) - 3)]
        assert again.tolist() == [every.count(w) > 1 for w in every] and sizes.tolist() == [max(0, len(s.split()) - 3) for s in strings]


def test_common_minimisers_are_found(spark, monkeypatch):
    """One that occurs once in each run of texts, among many others, with room for few counts."""
    monkeypatch.setattr(substrings, "HELD", 60)
    monkeypatch.setattr(substrings, "HOT", 100)
    monkeypatch.setattr(substrings, "runs", lambda texts: ([t] for t in texts))
    random.seed(7)
    shared = "one passage that is the same in all of them"
    rows = [(k, " ".join(f"u{random.random()}" for _ in range(12)) + f" {shared} " + " ".join(f"u{random.random()}" for _ in range(12))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, said string").selectExpr("CAST(said AS BINARY) AS text").repartition(2)
    assert 0 < len(substrings._survey(df, 6, 2)[1]) < 12


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op8_near_dedup", "op10_exact_dedup"])
def test_equals_oracle(spark, name):
    from marlstone.llm import registry

    from ..oracle import FOLDER

    compare(registry.queries()[name](spark, FOLDER), connect(), registry.oracle_sql()[name])
