"""Intermediate tables go when nothing reads them any more, and results outlive them."""

import os

import pyarrow as pa
import public_tokenizers

from marlstone.llm import exact_dedup, mixing, near_dedup, quality, storage, wordtok


def tables(spark):
    return {n for n in os.listdir(storage.shared_dir(spark).removeprefix("file:")) if n.startswith("table-")}


def test_scopes(spark):
    before = tables(spark)
    with storage.scope(spark):
        outer = storage.checkpointed(spark.range(3))
        with storage.scope(spark):
            inner, kept = storage.checkpointed(spark.range(4)), storage.checkpointed(spark.range(5), lasting=True)
            assert inner.count() == 4 and len(tables(spark) - before) == 3
        assert kept.count() == 5 and outer.count() == 3 and len(tables(spark) - before) == 2
        last = storage.checkpointed(spark.range(6), lasting=True)
    assert last.count() == 6 and len(tables(spark) - before) == 1


def test_operators_leave_what_their_results_read(spark, docs):
    before = tables(spark)
    groups = near_dedup.near_groups(docs)
    assert len(tables(spark) - before) == 2 and groups.count() == docs.count()
    before = tables(spark)
    assert near_dedup.drop_near(docs).count() and len(tables(spark) - before) == 1
    before = tables(spark)
    assert exact_dedup.drop_copies(docs).count() and len(tables(spark) - before) == 1


def test_batches_of_texts_are_bounded(spark, docs):
    quality.score(docs, quality.Network.fresh())  # sets the session's limits

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    found = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('x', 6000) AS text").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 1500 and max(r["bytes"] for r in found) < 2_400_000


def test_a_carried_text_is_sent_once(docs):
    sent = lambda df: df._jdf.queryExecution().analyzed().toString().count("__text")
    network = quality.Network.fresh()
    assert not sent(quality.score(docs, network)) and sent(quality.score(docs, network, keep=["doc_id"]))
    network.trained = True
    scores = [sorted(map(tuple, quality.score(docs, network, keep=keep).select("doc_id", "score").collect()), key=str) for keep in (None, ["doc_id"])]
    assert scores[0] == scores[1] and len({s for _, s in scores[0]}) > 3


def test_other_stages_let_go_of_tokenizers(docs, monkeypatch):
    found, path = [], public_tokenizers.path("word_bpe_49k.json")
    with monkeypatch.context() as patched:
        patched.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or self)
        quality.score(docs, quality.Network.fresh())
        near_dedup.sketch(docs, "doc_id", "text")
    for run in found:
        wordtok.load(path)
        assert not list(run(iter([]))) and not wordtok._loaded
    assert len(found) == 2


def test_small_tables_need_no_python_workers(spark, docs):
    plans = [storage.small_table(spark, rows, "a long, b string, c double") for rows in ([], [(1, "x", 0.5), (None, None, None)])]
    assert [list(map(tuple, p.collect())) for p in plans] == [[], [(1, "x", 0.5), (None, None, None)]]
    assert all(p._jdf.queryExecution().analyzed().toString().startswith("LocalRelation") for p in plans)
    assert "ExternalRDD" not in (plan := mixing.mix(docs.repartition(2))._jdf.queryExecution().analyzed().toString()) and plan.count("LocalRelation") >= 2
    when = spark.sql("SELECT TIMESTAMP '2020-01-02 03:04:05' AS t")
    assert storage.small_table(spark, when.collect(), when.schema).collect() == when.collect()
