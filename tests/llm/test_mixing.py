"""Pfair mixing against a slot-by-slot simulation."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import mixing


def ideal_services(weights, blocks):
    """What the ideal mix has served of each source after every slot, as exact fractions."""
    done, out = [Fraction(0)] * len(blocks), [[Fraction(0)] * len(blocks)]
    for _ in range(sum(blocks)):
        left = Fraction(1)  # of this slot
        while left:
            live = [i for i in range(len(blocks)) if done[i] < blocks[i]]
            live = [i for i in live if weights[i]] or live
            share = {i: Fraction(weights[i] or 1, sum(weights[j] or 1 for j in live)) for i in live}
            step = min([left, *((blocks[i] - done[i]) / share[i] for i in live)])
            for i in live:
                done[i] += step * share[i]
            left -= step
        out.append(list(done))
    return out


def windows_of(ideal, i, blocks):
    """(release, deadline) of each block of source i, slot by slot."""
    out = []
    for j in range(blocks[i]):
        release = max(t for t, served in enumerate(ideal) if served[i] <= j)
        out.append((release, min(t for t, served in enumerate(ideal) if served[i] >= j + 1)))
    return out


def simulate(weights, blocks):
    """Earliest deadline first, slot by slot; checks releases, deadlines and the deviation as it goes."""
    ideal, tiers = ideal_services(weights, blocks), ([i for i, w in enumerate(weights) if w], [i for i, w in enumerate(weights) if not w])
    due = [windows_of(ideal, i, blocks) for i in range(len(blocks))]
    done, out = [0] * len(blocks), []
    for t in range(sum(blocks)):
        tier = [i for i in tiers[0] if done[i] < blocks[i]] or [i for i in tiers[1] if done[i] < blocks[i]]
        _, i = min((due[i][done[i]][1], i) for i in tier if due[i][done[i]][0] <= t)
        out.append((i, done[i]))
        done[i] += 1
        assert due[i][done[i] - 1][0] <= t < due[i][done[i] - 1][1]
        assert all(abs(ideal[t + 1][k] - done[k]) < 1 for k in range(len(blocks)))
    return out


def test_schedule_equals_simulation():
    random.seed(3)
    for _ in range(80):
        n = random.randint(1, 5)
        weights, blocks = [random.randint(0, 9) for _ in range(n)], [random.randint(0, 30) for _ in range(n)]
        plan = mixing.Schedule(weights, blocks)
        placed = sorted((int(s), (i, k)) for i in range(n) for k, s in enumerate(plan.slot(i, np.arange(blocks[i]))))
        assert [p for _, p in placed] == simulate(weights, blocks)
        assert [s for s, _ in placed] == list(range(sum(blocks)))


def test_deviation_from_the_given_weights():
    """Many sources, and irrational weights: every source stays within a block of its exact share until one runs out."""
    for hot, few, n in ((3_000_000, 9000, 700), (3_000_000, 300_000, 19), (40_000, 3, 5000)):
        given = {str(k).zfill(5): (few + k if k else hot) ** 0.5 for k in range(n + 1)}
        whole, slots = mixing.whole_weights(given), 20_000
        plan = mixing.Schedule([whole[s] for s in sorted(given)], [slots // (1 if n < 100 else 50)] + [slots if n < 100 else 30] * n)
        end, total = min(plan.last), sum(map(Fraction, given.values()))
        for i, s in enumerate(sorted(given)):
            share = Fraction(given[s]) / total
            at = plan.slot(i, np.arange(30))
            assert all(abs((s + 1) * share - (j + 1)) < 1 and abs(s * share - j) < 1 for j, s in enumerate(at.tolist()) if s <= end)


def test_weights_are_exact():
    whole = mixing.whole_weights({"a": 3, "b": 1, "c": 0, "d": 0.1})
    assert whole["a"] == 3 * whole["b"] and whole["c"] == 0 and Fraction(whole["d"], whole["b"]) == Fraction(0.1)
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": -1})


def test_table_equals_simulation(spark):
    """The positions of a whole table against slots that are walked through one by one."""
    sizes = {"a": 130, "b": 77, "c": 40, "": 9, "zero": 20}
    rows = spark.createDataFrame([(i, s or None) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    for weights in (None, {"a": 5, "b": 0.7, "c": 1 / 3, "\0": 1}):
        names = sorted(s or "\0" for s in sizes)
        count = {s or "\0": n for s, n in sizes.items()}
        whole = mixing.whole_weights({s: weights.get(s, 0) if weights else count[s] ** 0.5 for s in names})
        want, taken = [], dict.fromkeys(names, 0)
        for i, _ in simulate([whole[s] for s in names], [-(-count[s] // 4) for s in names]):
            n = min(4, count[names[i]] - taken[names[i]])
            taken[names[i]] += n
            want += [names[i]] * n
        found = mixing.mixed_in_order(rows, weights=weights, block_rows=4).collect()
        assert [r["source"] or "\0" for r in found] == want and [r["mix_position"] for r in found] == list(range(len(want)))


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('s', IF(id % 3 = 0, 0, id % 50)) AS source")
    found = mixing.mixed_in_order(rows, block_rows=2).collect()
    assert [r["mix_position"] for r in found] == list(range(400)) and len({r["doc_id"] for r in found}) == 400


def test_blocks_grow_beyond_the_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 10)
    rows = spark.range(1000).selectExpr("id AS doc_id", "CAST(id % 2 AS string) AS source")
    found = mixing.mixed_in_order(rows).collect()
    assert {r["mix_block"] for r in found} == set(range(5)) and [r["mix_position"] for r in found] == list(range(1000))


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, 2, 3, 4, "y", 5)], "doc_id long, source string, __source string, __k int, k int, bucket int, hash int, __c0 string, Mix_Slot int")
    found = mixing.mix(rows).collect()[0].asDict()
    assert found == {"doc_id": 1, "source": "a", "__source": "x", "__k": 1, "k": 2, "bucket": 3, "hash": 4, "__c0": "y", "mix_block": 0, "mix_slot": 0, "mix_position": 0}


def test_every_row_once_without_gaps(spark, docs):
    rows = mixing.mixed_in_order(docs, block_rows=2).collect()
    assert [r["mix_position"] for r in rows] == list(range(docs.count()))
    assert sorted(str(r[:-3]) for r in rows) == sorted(str(tuple(r)) for r in docs.collect())


def test_prefixes_follow_weights(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'x' WHEN id % 3 = 1 THEN 'y' ELSE 'z' END AS source")
    mixed = mixing.mixed_in_order(rows, weights={"x": 5, "y": 3, "z": 2}, block_rows=8).collect()
    for n in (400, 1600, 3200):
        for source, share in (("x", 0.5), ("y", 0.3), ("z", 0.2)):
            assert abs(sum(r["source"] == source for r in mixed[:n]) - share * n) <= 2 * 8


def test_empty(empty):
    assert mixing.mixed_in_order(empty).count() == 0


def test_order_reaches_the_sequences(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), IF(id % 7 = 0, 420, 20)) AS text", "CASE WHEN id % 7 = 0 THEN 'long' ELSE concat('s', id % 3) END AS source")
    # files of very different lengths, the largest one last
    mixing.in_order(docs.withColumn("mix_position", 4000 - 1 - F.col("doc_id")), 4000, 4).drop("mix_position").write.parquet(str(tmp_path / "mixed"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        pieces = corpus_pipeline.packed_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    tasks = {}
    for r in pieces:
        tasks.setdefault(r["sequence_id"] >> 32, set()).add(3999 - r["doc_id"])
    ranges = [(min(v), max(v)) for _, v in sorted(tasks.items())]
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sorted(set().union(*tasks.values())) == list(range(4000))


def test_file_order(spark, tmp_path):
    for name, ids in (("part-00002-a", range(5)), ("part-100000-a", range(5, 3000)), ("part-99999-a", range(3000, 3010))):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    read = spark.read.parquet(*(str(tmp_path / f"{n}.parquet") for n in ("part-100000-a", "part-99999-a", "part-00002-a")))
    assert [r["doc_id"] for r in corpus_pipeline.in_file_order(read).collect()] == [*range(5), *range(3000, 3010), *range(5, 3000)]
    assert corpus_pipeline.in_file_order(spark.range(3).withColumnRenamed("id", "doc_id")).count() == 3
