"""Conversations as training sequences with a loss mask that is aligned by offsets.

A conversation is rendered as one text, ``<|turn|>role<|says|>text<|over|>`` for every turn. Inside roles and texts
each ``<`` that backslashes may separate from a following ``|`` gets one backslash more, so no text can hold a
control string of the template or of the tokenizer, and the escape can be undone. The whole text is encoded once,
with the offset at which each token starts; the control strings are tokens of their own, so no token crosses into a text.
The spans of the turns to be learned and the tokens' offsets are both sorted, and a binary search gives each span its run
of tokens.

The ids are the library's. Texts of plain Latin characters are cut into words here by the tokenizer's own pattern, and each
distinct word is encoded by the library's model once; any other text goes to the library whole. A byte-level token stands
for fixed bytes, so the sums of their lengths are the offsets.

Defined results: turns are ordered by number, then role and text, null numbers first; null roles and texts count as
empty; a row without a conversation id is a conversation of its own; rows that a table holds under the query's own
conversation -7 become turns of it; an empty text has no tokens to learn; an empty table gives an empty result; other
columns are ignored. A conversation is one sequence and one row, so memory grows with the longest one: some 40 bytes for
each of its characters.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordtok import BYTE_CHARACTERS, OTHER

TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: frozenset[str] = frozenset(("assistant",))) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the spans of the texts to be learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, OVER)
        at += len(head) + len(body) + len(OVER)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(SAYS)
        turns.append((unescape(role), unescape(rest.removesuffix(OVER))))
    return turns


#: The pre-tokenizer's pattern, for plain Latin characters. Fixed by the byte-level tokenizer.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Words in one generation of the cache.
CACHE_WORDS = 250_000


class Codec:
    """A byte-level tokenizer with the template's control strings as tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.add_special_tokens([TURN, SAYS, OVER])
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        split = steps.get("pre_tokenizer") or {}
        self._by_word = steps.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        special = {word: i for i, word in self._added().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self._ids = {word: array("i", [i]).tobytes() for word, i in special.items()}
        byte_of = {c: b for b, c in BYTE_CHARACTERS.items()}
        raw = [b""] * (max(self.library.get_vocab(with_added_tokens=True).values()) + 1)
        for word, i in self.library.get_vocab(with_added_tokens=True).items():
            raw[i] = word.encode() if word in special else bytes(byte_of[c] if c in byte_of else ord(c) for c in word)
        self._bytes, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self._first = np.cumsum(self.sizes) - self.sizes
        #: Characters that begin in each token, and whether it begins inside one.
        self._leads = np.array([sum(b & 0xC0 != 0x80 for b in r) for r in raw], np.int64)
        self._inside = np.array([r[:1] >= b"\x80" and r[0] & 0xC0 == 0x80 if r else False for r in raw], np.int64)
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _added(self) -> dict[int, str]:
        return {i: token.content for i, token in self.library.get_added_tokens_decoder().items()}

    def _word(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = array("i", [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARACTERS))]).tobytes()
        self._words[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, special tokens not added."""
        if not self._by_word or OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        if len(self._words) > CACHE_WORDS:
            self._older, self._words = self._words, {}
        words, out = self._words, []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(self._ids[part])
            elif part:
                out += [words.get(w) or self._word(w) for w in _WORDS.findall(part)]
        return np.frombuffer(b"".join(out), np.int32)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The character at which each token starts, or inside which it does."""
        leads = self._leads[ids]
        return np.cumsum(leads) - leads - self._inside[ids]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that were encoded."""
        sizes = self.sizes[ids]
        return self._bytes[np.repeat(self._first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def decode(self, ids) -> str:
        """The very text that was encoded."""
        return self.raw(np.asarray(ids, np.int64)).tobytes().decode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.groupBy(F.col("conv_id").cast("long").alias("conv_id"), own.alias("own")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", "turns")


def format_chat(df: DataFrame, tokenizer: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: the rendered text, its token ids, where each token starts, and whether it is learned."""
    roles = frozenset(learned)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(tokenizer)
        for batch in rows:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                rendered = [render([(t["role"], t["text"]) for t in turns], roles) for turns in part.column(1).to_pylist()]
                ids, starts, loss = [], [], []
                for text, spans in rendered:
                    ids.append(tok.encode(text))
                    starts.append(tok.starts(ids[-1]))
                    edges = np.zeros(len(ids[-1]) + 1, np.int8)
                    at = np.searchsorted(starts[-1], np.array(spans, np.int64).reshape(-1, 2))
                    np.add.at(edges, at[:, 0], 1)
                    np.add.at(edges, at[:, 1], -1)
                    loss.append(np.cumsum(edges[:-1]) > 0)
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((ids, pa.int32()), (starts, pa.int32()), (loss, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in rendered], pa.string()), *lists], ["conv_id", "formatted", "ids", "starts", "loss"])

    return conversations(df).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what the token ids and the mask say: turns and learned text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(tokenizer)
        for batch in rows:
            out = []
            for k, conv in enumerate(batch.column(0).to_pylist()):
                ids, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                raw = tok.raw(ids).tobytes()
                ends = np.append(0, np.cumsum(tok.sizes[ids]))
                text = raw.decode()
                turns = parse(text)
                edges = ends[np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))].tolist()
                learned = "".join(unescape(raw[a:b].decode()) for a, b in zip(edges[::2], edges[1::2]))
                every = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one more that speaks in another template's control strings."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_chat(rows.unionByName(extra), path), path)
