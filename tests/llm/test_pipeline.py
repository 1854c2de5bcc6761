"""The pipeline, stage by stage, against brute force: which rows survive, their order, and their sequences."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import mixing, quality

from ..oracle import FOLDER
from .test_dedup import brute_near, norm
from .test_mixing import simulate


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written as the pipeline writes it."""
    out = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(out / str(k)))
        after = spark.read.parquet(str(out / str(k)))
        found.append((docs, after))
        docs = after
    return found


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_rejected_documents_go(spark, stages):
    before, after = stages[0]
    net = quality.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert rows(after) == sorted(tuple(r) for r in before.collect() if net.score((r["text"] or "").encode()) >= quality.THRESHOLD)


def test_equal_texts_stay_once(stages):
    before, after = stages[1]
    least = {}
    for r in before.collect():
        least[norm(r["text"])] = min(least.get(norm(r["text"]), r["doc_id"]), r["doc_id"])
    assert rows(after) == sorted(tuple(r) for r in before.collect() if least[norm(r["text"])] == r["doc_id"])


def test_near_copies_stay_once(stages):
    before, after = stages[2]
    held = before.collect()
    assert rows(after) == sorted(tuple(r) for r, c in zip(held, brute_near([(r["doc_id"], r["text"]) for r in held])) if r["doc_id"] == c)


def test_sources_follow_the_mix(stages):
    before, after = stages[3]
    assert rows(after) == rows(before)
    counts = {}
    for r in before.collect():
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    names = sorted(counts)
    whole = mixing.whole_weights({s: counts[s] ** mixing.ALPHA for s in names})
    want, taken = [], dict.fromkeys(names, 0)
    for i, _ in simulate([whole[s] for s in names], [-(-counts[s] // mixing.BLOCK_ROWS) for s in names]):
        n = min(mixing.BLOCK_ROWS, counts[names[i]] - taken[names[i]])
        taken[names[i]] += n
        want += [names[i]] * n
    assert [r["source"] for r in corpus_pipeline.in_file_order(after).collect()] == want


def test_sequences_hold_every_document(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces, windows = {}, {}
    for r in after.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in before.collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(pieces.pop(r["doc_id"]))) == ids
    assert not pieces
    for held in windows.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    # each task's sequences hold a range of the mix, and ascend with it
    place = {r["doc_id"]: k for k, r in enumerate(corpus_pipeline.in_file_order(before).collect())}
    tasks = {}
    for r in after.collect():
        tasks.setdefault(r["sequence_id"] >> 32, []).append(place[r["doc_id"]])
    ranges = [(min(v), max(v)) for _, v in sorted(tasks.items())]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "length").distinct().count() == stages[4][1].count()
