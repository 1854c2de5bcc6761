"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A text is its UTF-8 bytes. The first layer's learned filters span three bytes; beside them stand fixed filters
that tell whether a byte equals the byte one to ``LAGS`` places before, of which the strongest two lags count (they see
words that repeat). Their responses are averaged over chunks of 128 bytes that overlap by half and cover the
whole text; a second layer of learned filters reads each chunk; each filter's largest response over all chunks
goes into one probability. Texts are taken in segments, so memory does not grow with a text's length.

Labels are learned from a bounded sample of labelled rows (at most ``SAMPLE`` in the order of a hash, of ``SAMPLE_BYTES``
bytes together), each with its whole text; every text is scored whole.

Defined results: a null text is scored as an empty one, which is one chunk of zeros; a null id is never held
out; labels that are null are not learned from, several labels of an id count as their mean; without labels the
score is 0.5 everywhere; equal texts get equal scores; an empty table gives an empty result; other columns are
carried along by ``score`` and those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordtok
from .storage import BATCH_BYTES, carried, numbered, small_batches, small_table

BLOCK, TAPS, FILTERS, LAGS, HIDDEN = 64, 3, 12, 32, 16
SEGMENT = 1 << 18
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, THRESHOLD = 3000, 32 << 20, 900, 32, 0.3
#: What stands for no byte, before and after a text.
NONE = 256


def _lag_sums(data: np.ndarray, ahead: int) -> np.ndarray:
    """For each block of data[ahead:], how many of its bytes equal the byte some lag before; a column for each lag."""
    n = len(data) - ahead
    blocks = -(-n // BLOCK)
    same, out = np.zeros(blocks * BLOCK, bool), np.empty((blocks, LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        skip = min(max(0, lag - ahead), n)
        same[:skip] = False
        if skip < n:
            same[skip:n] = data[ahead + skip :] == data[ahead + skip - lag : len(data) - lag]
        out[:, lag - 1] = np.count_nonzero(same.reshape(blocks, BLOCK), axis=1)
    return out


def _paired(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means over chunks of two neighbouring blocks, from sums over blocks; a lone block is a chunk."""
    if len(sums) == 1:
        return sums / np.maximum(sizes, 1)[:, None]
    return (sums[:-1] + sums[1:]) / np.maximum(sizes[:-1] + sizes[1:], 1)[:, None]


def _block_sums(z: np.ndarray) -> np.ndarray:
    return (np.ones((1, BLOCK), np.float32) @ z)[:, 0]


def _top_two(lags: np.ndarray) -> np.ndarray:
    return -np.partition(-lags, 1, axis=1)[:, :2]


@dataclass
class Network:
    """The weights; ``taps`` holds a row of filter responses for each place in the filter and each byte."""

    taps: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    trained: bool = False
    _moments: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def fresh(seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 0.7, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            r.normal(0, 0.4, (FILTERS + 2, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.3, HIDDEN).astype(np.float32),
        )

    def responses(self, data: np.ndarray, ahead: int) -> np.ndarray:
        """First-layer responses at every byte of data[ahead:]; bytes before the text count as none."""
        n = len(data) - ahead
        z = np.take(self.taps[0] + self.bias, data[ahead:], axis=0)
        for k in range(1, TAPS):
            skip = max(0, k - ahead)
            if skip < n:
                z[skip:] += np.take(self.taps[k], data[ahead + skip - k : len(data) - k], axis=0)
        return np.maximum(z, 0, out=z)

    def chunks(self, raw: bytes) -> Iterator[np.ndarray]:
        """The second layer's input for all chunks, segment by segment."""
        data = np.frombuffer(raw, np.uint8)
        last = None
        for at in range(0, max(len(data), 1), SEGMENT):
            ahead = min(at, LAGS)
            part = data[at - ahead : at + SEGMENT]
            n = len(part) - ahead
            if not n:
                yield np.zeros((1, FILTERS + 2), np.float32)
                return
            blocks = -(-n // BLOCK)
            z = np.zeros((blocks * BLOCK, FILTERS), np.float32)
            z[:n] = self.responses(part, ahead)
            sums = np.concatenate([_block_sums(z.reshape(blocks, BLOCK, FILTERS)), _lag_sums(part, ahead)], axis=1)
            sizes = np.full(blocks, BLOCK, np.float32)
            sizes[-1] = n - BLOCK * (blocks - 1)
            if last is not None:  # the chunk across two segments
                sums, sizes = np.concatenate([last[0], sums]), np.concatenate([last[1], sizes])
            means = _paired(sums, sizes)
            yield np.concatenate([means[:, :FILTERS], _top_two(means[:, FILTERS:])], axis=1)
            last = sums[-1:], sizes[-1:]

    def pooled(self, raw: bytes) -> np.ndarray:
        most = np.full(HIDDEN, -np.inf, np.float32)
        for x in self.chunks(raw):
            most = np.maximum(most, (x @ self.hidden + self.hidden_bias).max(0))
        return np.maximum(most, 0)

    def score(self, raw: bytes) -> float:
        """The probability of a good text."""
        return float(1 / (1 + np.exp(-float(self.pooled(raw) @ self.out + self.out_bias[0])))) if self.trained else 0.5

    def _descend(self, name: str, value: np.ndarray, gradient: np.ndarray, rate: float, step: int) -> None:
        m, v = self._moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient * gradient - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def train(self, texts: list[bytes], good: np.ndarray, steps: int = STEPS, seed: int = 7, batch: int = BATCH, rate: float = 0.02) -> "Network":
        """Adam on the log loss, for about so many steps of a batch. Only the chunks that won a maximum pass a gradient on to the first layer."""
        rng, step = np.random.default_rng(seed), 0
        held, good = [Sample(t) for t in texts], np.asarray(good, np.float32)
        epochs = max(1, min(60, -(-steps * batch // len(texts))))
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
                step += 1
                for name, gradient in self.gradients([held[i] for i in rows.tolist()], good[rows])[1].items():
                    value = getattr(self, name)
                    self._descend(name, value, gradient if name == "out_bias" else gradient + 1e-5 * value, now, step)
        self.trained, self._moments = True, {}
        return self

    def gradients(self, batch: list["Sample"], good: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log loss of a batch of whole texts, and its gradient for each weight."""
        symbols = np.concatenate([s.symbols for s in batch])
        begin = np.cumsum([0, *(len(s.symbols) for s in batch)])[:-1]  # where each text starts
        seen = [symbols]
        for k in range(1, TAPS):
            before = np.full_like(symbols, NONE)
            before[k:] = symbols[:-k]
            for j in range(k):
                before[np.minimum(begin + j, len(symbols) - 1)] = NONE  # nothing stands before a text
            seen.append(before)
        tables = np.concatenate([self.taps, np.zeros((TAPS, 1, FILTERS), np.float32)], axis=1)
        z = np.take(tables[0] + self.bias, symbols, axis=0)
        for k in range(1, TAPS):
            z += np.take(tables[k], seen[k], axis=0)
        np.maximum(z, 0, out=z)
        z[symbols == NONE] = 0
        z = z.reshape(-1, BLOCK, FILTERS)
        sums = _block_sums(z)
        chunks = np.cumsum([0, *(len(s.sizes) for s in batch)])
        first = np.concatenate([b // BLOCK + np.arange(len(s.sizes)) for b, s in zip(begin.tolist(), batch)])
        lone = np.repeat([len(s.symbols) == BLOCK for s in batch], np.diff(chunks))
        second = np.where(lone, first, first + 1)
        sizes = np.concatenate([s.sizes for s in batch])[:, None]
        x = np.concatenate([(sums[first] + np.where(lone[:, None], 0, sums[second])) / sizes, np.concatenate([s.lags for s in batch])], axis=1)
        h = x @ self.hidden + self.hidden_bias
        won = np.array([a + h[a:b].argmax(0) for a, b in zip(chunks[:-1].tolist(), chunks[1:].tolist())])
        top = np.maximum(h[won, np.arange(HIDDEN)], 0)
        raw = top @ self.out + self.out_bias[0]
        error = ((1 / (1 + np.exp(-raw)) - good) / len(batch)).astype(np.float32)
        back = np.where(top > 0, error[:, None] * self.out, 0).astype(np.float32)
        g = {"out": error @ top, "out_bias": error.sum(keepdims=True), "hidden_bias": back.sum(0), "hidden": np.einsum("bjf,bj->fj", x[won], back)}
        # what the first layer gets: by winning chunk, then by block, then by byte
        down = np.zeros((len(x), FILTERS), np.float32)
        np.add.at(down, won.ravel(), (self.hidden[:FILTERS].T * back[:, :, None]).reshape(-1, FILTERS))
        down /= sizes
        by_block = np.zeros((len(sums), FILTERS), np.float32)
        np.add.at(by_block, first, down)
        np.add.at(by_block, second[~lone], down[~lone])
        used = np.flatnonzero(by_block.any(1))
        dz = ((z[used] > 0) * by_block[used][:, None]).reshape(-1, FILTERS)
        g["bias"] = dz.sum(0)
        g["taps"] = np.empty_like(self.taps)
        for k in range(TAPS):
            at = seen[k].reshape(-1, BLOCK)[used].ravel().astype(np.int64)[:, None] * FILTERS + np.arange(FILTERS)
            g["taps"][k] = np.bincount(at.ravel(), dz.ravel(), (NONE + 1) * FILTERS).reshape(-1, FILTERS)[:NONE]
        loss = np.logaddexp(0, np.where(good > 0.5, -raw, raw)).mean()
        return float(loss), g


class Sample:
    """A whole text as the training sees it: bytes filled up to blocks, its chunks' sizes and their strongest lags, which do not change."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        blocks = max(1, -(-len(data) // BLOCK))
        self.symbols = np.full(blocks * BLOCK, NONE, np.uint16)
        self.symbols[: len(data)] = data
        sizes = np.full(blocks, BLOCK, np.float32)
        sizes[-1] = len(data) - BLOCK * (blocks - 1)
        self.sizes = np.maximum(sizes, 1) if blocks == 1 else sizes[:-1] + sizes[1:]
        sums = _lag_sums(data, 0) if len(data) else np.zeros((1, LAGS), np.float32)
        self.lags = _top_two(_paired(sums, sizes)).astype(np.float32)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> Network:
    """A network for the label, learned from whole texts: of the first ``sample`` labelled rows in the order of a hash
    those that fit into ``sample_bytes`` bytes together (a text that is too long for what is left is passed over)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__good"))
    chosen = small_table(docs.sparkSession, known.orderBy(F.xxhash64("__id"), "__id").limit(sample).collect(), known.schema)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("__id"), raw.alias("__raw"))
    sizes = texts.join(F.broadcast(chosen), "__id").select("__id", F.xxhash64("__raw").alias("__hash"), F.octet_length("__raw").alias("__size"))
    taken, left = set(), sample_bytes
    for r in sizes.distinct().orderBy(F.xxhash64("__id"), "__id", "__hash").limit(sample).collect():
        if r["__size"] <= left:
            taken.add((r["__id"], r["__hash"]))
            left -= r["__size"]
    if not taken:
        return Network.fresh()
    wanted = small_table(docs.sparkSession, sorted(taken), sizes.select("__id", "__hash").schema)
    found = texts.join(F.broadcast(chosen.join(wanted, "__id")), (texts["__id"] == wanted["__id"]) & (F.xxhash64("__raw") == F.col("__hash")))
    rows = {(r[0], r[1]): (bytes(r[2]), r[3]) for r in found.select(texts["__id"], "__hash", "__raw", "__good").dropDuplicates(["__id", "__hash"]).collect()}
    ordered = [rows[k] for k in sorted(rows)]
    return Network.fresh().train([t for t, _ in ordered], np.array([g >= 0.5 for _, g in ordered], np.float32), steps)


def score(docs: DataFrame, network: Network, text_col: str = "text", to: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns in ``keep``, with a column for the probability of a good text."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    kept = carried(docs, [to], keep)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(to, T.DoubleType())])
    width, names = len(kept), schema.names[: len(kept)]
    at = names.index(text_col) if text_col in names and "." not in text_col else width  # a text that is carried along is sent once

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordtok.release()
        for batch in rows:
            scores = [network.score((t or "").encode()) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64())], schema.names)

    return docs.select(*numbered(kept), *[F.col(text_col).alias("__text")] * (at == width)).mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, network, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
