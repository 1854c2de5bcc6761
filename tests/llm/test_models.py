"""The quality classifier by held-out accuracy, neighbours by recall against brute force, and the pipeline."""

import numpy as np
import pytest
import zlib

from marlstone.llm import neighbours, quality

from ..oracle import FOLDER


def brute(rows, q, k):
    vectors = {i: np.array(v, float) for i, v in rows}
    found = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
    return found[:k]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    return rows + [(2000 + i, rows[7][1]) for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_and_order(spark, vectors):
    found = neighbours.nearest(frame(spark, vectors), 50).collect()
    hits = total = 0
    for q in {r["query_id"] for r in found}:
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[2] for g in got] == sorted(g[2] for g in got)
        want = brute(vectors, q, 10)
        truth = dict((i, d) for d, i in brute(vectors, q, len(vectors)))
        assert all(abs(truth[i] - d) < 1e-12 for _, i, d in got)
        hits += len({i for _, i in want} & {g[1] for g in got})
        total += 10
    assert total == 10 * sum(i % 50 == 0 for i, _ in vectors) and hits / total >= 0.9


@pytest.mark.parametrize("folder", ["0.001", "0.01"])
def test_recall_on_the_given_vectors(spark, folder):
    path = FOLDER.replace("0.001", folder)
    found = neighbours.op7_nearest(spark, path).collect()
    rows = [(r[0], np.array(r[1], float)) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = 0
    queries = [q for q in ids.tolist() if q % 100 == 0]
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = {i for _, i in sorted(zip(d.tolist(), ids.tolist()))[:10]}
        hits += len(want & {r["vec_id"] for r in found if r["query_id"] == q})
    assert len(found) == 10 * len(queries) and hits >= 0.9 * len(found)


def test_ties_go_to_small_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 5.0]) for i in range(50)]
    found = neighbours.nearest(frame(spark, rows), 100).filter("query_id < 300").collect()
    assert all(sorted(r["vec_id"] for r in found if r["query_id"] == q) == [i for i in range(12) if i != q][:10] for q in (0, 100, 200))


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    spread = [(i, [c + 1e-4 * t for c in v]) for t in range(13) for i, v in rows]  # 13 vectors of each id, no two of them equal
    once = neighbours.nearest(frame(spark, rows), 20, target=1.0).collect()
    for many in (frame(spark, rows * 12).repartition(12), frame(spark, spread)):
        found = neighbours.nearest(many, 20, target=1.0).collect()
        by_query = {}
        for r in found:
            by_query.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(by_query) == 20 and all(len(set(v)) == 10 for v in by_query.values())
    want = {}
    for r in once:
        want.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(want[q] & set(v)) for q, v in by_query.items())
    assert hits >= 0.9 * 200


def test_unusable_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [0.0, 3.0]), (100, [0.0, 0.0])]
    found = sorted(tuple(r) for r in neighbours.nearest(frame(spark, rows), 100).collect())
    assert [f[:3] for f in found] == [(0, 1, 7), (0, 2, 8)]
    assert neighbours.nearest(frame(spark, []), 100).count() == neighbours.nearest(frame(spark, [(0, None)]), 100).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    index = neighbours.MultiIndex(rng.normal(size=(500, 8)), 6)
    q = rng.normal(size=8)
    counts = np.ones(index.size, np.int64)
    order = index.walk(q, counts, index.size)
    sums = index._sums(q)[order]
    assert sorted(order) == list(range(index.size)) and (np.diff(sums) >= -1e-12).all()


def test_chunks_do_not_depend_on_segments(monkeypatch):
    net = quality.Network.fresh()
    net.trained = True
    raw = bytes(np.random.default_rng(2).integers(0, 256, 5000, dtype=np.uint8))
    whole = net.score(raw)
    monkeypatch.setattr(quality, "SEGMENT", 640)
    assert abs(net.score(raw) - whole) < 1e-5


def naive_probability(net, raw):
    """The network byte by byte, as its docstring says."""
    relu = lambda v: max(0.0, v)
    first = [[relu(float(net.bias[f]) + sum(float(net.taps[k][raw[p - k]][f]) for k in range(quality.TAPS) if p >= k)) for f in range(quality.FILTERS)] for p in range(len(raw))]
    same = [[p >= lag and raw[p] == raw[p - lag] for lag in range(1, quality.LAGS + 1)] for p in range(len(raw))]
    blocks = max(1, -(-len(raw) // quality.BLOCK))
    best = [0.0] * quality.HIDDEN
    for c in range(max(1, blocks - 1)):
        at = range(c * quality.BLOCK, min(len(raw), (c + 2) * quality.BLOCK))
        means = [sum(first[p][f] for p in at) / max(1, len(at)) for f in range(quality.FILTERS)]
        lags = sorted((sum(same[p][k] for p in at) / max(1, len(at)) for k in range(quality.LAGS)), reverse=True)[:2]
        for j in range(quality.HIDDEN):
            best[j] = max(best[j], float(net.hidden_bias[j]) + sum(x * float(net.hidden[i][j]) for i, x in enumerate(means + lags)))
    return 1 / (1 + np.exp(-(float(net.out_bias[0]) + sum(b * float(w) for b, w in zip(best, net.out)))))


def odd_texts():
    rng = np.random.default_rng(4)
    return [b"", b"a", b"abc" * 50, bytes(rng.integers(0, 256, 64, dtype=np.uint8)), b"x" * 128, bytes(rng.integers(60, 90, 700, dtype=np.uint8)), "dé日本 ".encode() * 40]


def test_score_equals_naive_forward_pass():
    rng, net = np.random.default_rng(6), quality.Network.fresh()
    net.trained, net.bias, net.hidden_bias = True, rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.HIDDEN).astype(np.float32)
    net.out_bias[0] = 0.3
    texts = odd_texts()
    want = [naive_probability(net, t) for t in texts]
    assert np.allclose([net.score(t) for t in texts], want, atol=1e-4)
    good = np.array([0, 1] * 4, np.float32)[: len(texts)]
    loss, _ = net.gradients([quality.Sample(t) for t in texts], good)
    assert abs(loss + np.mean([np.log(p if y else 1 - p) for p, y in zip(want, good)])) < 1e-4


def test_gradients_are_slopes_of_the_loss():
    net = quality.Network.fresh()
    net.hidden_bias = np.random.default_rng(9).normal(0, 0.2, quality.HIDDEN)  # no text stands at a kink
    for name in ("taps", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    batch, good = [quality.Sample(t) for t in odd_texts()], np.array([0, 1, 1, 0, 1, 0, 1], np.float32)
    slopes = net.gradients(batch, good)[1]
    rng = np.random.default_rng(2)
    for name, slope in slopes.items():
        value = getattr(net, name)
        for at in sorted(zip(*(a.tolist() for a in np.unravel_index(rng.choice(value.size, min(6, value.size), replace=False), value.shape)))) + [tuple(np.unravel_index(np.abs(slope).argmax(), value.shape))]:
            old, losses = value[at], []
            for d in (1e-4, -1e-4):
                value[at] = old + d
                losses.append(net.gradients(batch, good)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - slope[at]) < 2e-3, (name, at)


def test_learns_from_the_end_of_long_texts(spark):
    rng = np.random.default_rng(8)
    plain = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(2500))
    rows = [(i, plain() + (" ####" * 300 if i % 2 else "")) for i in range(120)]  # bad only beyond 15,000 bytes
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    net = quality.fit(docs, labels, steps=100)
    assert np.mean([(net.score(t.encode()) >= 0.5) == (i % 2 == 0) for i, t in rows]) > 0.95


def test_sample_of_bounded_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * (100 if i else 100_000)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality.fit(docs, labels, sample_bytes=5000, steps=1).trained and not quality.fit(docs, labels, sample_bytes=10, steps=1).trained


def test_whole_text_counts():
    net = quality.Network.fresh()
    net.trained = True
    plain = b"a" * 40_000
    assert net.score(plain + b"!! ## $$ " * 40) != net.score(plain)


def test_held_out_accuracy(spark):
    found = quality.op6_quality(spark, FOLDER.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/labels.parquet").toPandas()
    both = found[found.held_out].merge(labels, on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    assert (both.predicted == both.quality).mean() >= 0.93 and both.predicted[both.quality == 1].mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_scores_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1)], "doc_id long, quality int")
    net = quality.fit(docs, labels, steps=3)
    rows = quality.score(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), net).count() == 0
    assert quality.fit(docs, labels.limit(0)).score(b"x") == 0.5
