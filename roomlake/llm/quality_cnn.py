"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_batches

#: Chunks of WIDTH bytes start at every STRIDE-th byte, so they overlap and cover the whole text. A chunk spans about ten
#: words, so that a filter can see a word that comes again and again.
WIDTH, STRIDE, DEPTH, FILTERS = 64, 4, 8, 48
#: Labelled rows that a fit may use at most, and the bytes of the longest text among them.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 6000, 1 << 16
#: Bytes of a text, a multiple of STRIDE, whose chunks are scored at once.
_SEGMENT = 1 << 18
#: Chunks that are multiplied at once.
_CHUNKS = 4096


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


@dataclass
class ByteCnn:
    """probability = sigmoid(tanh(max over chunks of (embedded bytes @ filters) + bias) @ out + out_bias)"""

    embedding: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def _layout(self, texts: list[np.ndarray], chunks: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts end to end, each followed by WIDTH zero bytes or more; first chunk of each; whether a chunk starts in a text.

        ``chunks`` says how many chunks count, if not all that start in the text.
        """
        n = np.array(chunks if chunks is not None else [max(1, -(-len(x) // STRIDE)) for x in texts])
        room = np.array([max(1, -(-len(x) // STRIDE)) for x in texts]) + WIDTH // STRIDE
        begin = np.cumsum(room) - room
        flat = np.zeros(int(room.sum()) * STRIDE, np.uint8)
        valid = np.zeros(int(room.sum()), bool)
        for x, s, k in zip(texts, begin, n):
            flat[s * STRIDE : s * STRIDE + len(x)] = x
            valid[s : s + k] = True
        return flat, begin, valid

    def _responses(self, flat: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Every filter at every chunk; -inf at chunks that don't count."""
        n, size = len(flat) // STRIDE, self.embedding.itemsize
        rows = np.concatenate([self.embedding[flat].ravel(), np.zeros(WIDTH * DEPTH, self.embedding.dtype)])
        windows = np.lib.stride_tricks.as_strided(rows, (n, WIDTH * DEPTH), (STRIDE * DEPTH * size, size), writeable=False)
        out = np.empty((n, self.filters.shape[1]), rows.dtype)
        for a in range(0, n, _CHUNKS):
            out[a : a + _CHUNKS] = np.ascontiguousarray(windows[a : a + _CHUNKS]) @ self.filters
        out[~valid] = -np.inf
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        pooled = np.full((len(texts), self.filters.shape[1]), -np.inf, self.filters.dtype)
        held: list[np.ndarray] = []
        owner: list[int] = []
        counted: list[int] = []

        def flush() -> None:
            if held:
                flat, begin, valid = self._layout(held, counted)
                np.maximum.at(pooled, np.array(owner), np.maximum.reduceat(self._responses(flat, valid), begin, axis=0))
                for x in (held, owner, counted):
                    x.clear()

        size = 0
        for k, text in enumerate(texts):
            s = text_bytes(text)
            for a in range(0, max(len(s), 1), _SEGMENT):
                # a segment brings the bytes that its last chunks reach into; chunks that start there are the next one's
                held.append(s[a : a + _SEGMENT + WIDTH])
                owner.append(k)
                counted.append(max(1, -(-min(len(s) - a, _SEGMENT) // STRIDE)))
                size += len(held[-1])
                if size > _SEGMENT:
                    flush()
                    size = 0
        flush()
        return 1 / (1 + np.exp(-(np.tanh(pooled + self.bias) @ self.out + self.out_bias[0])))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted logistic loss and its gradient by parameter; a maximum passes its gradient to the chunk that won."""
        kind, n_filters = self.filters.dtype, self.filters.shape[1]
        flat, begin, valid = self._layout(texts)
        got = self._responses(flat, valid)
        ends = np.append(begin[1:], len(got))
        won = np.stack([s + got[s:e].argmax(axis=0) for s, e in zip(begin, ends)])
        h = np.tanh(got[won, np.arange(n_filters)] + self.bias)
        z = h @ self.out + self.out_bias[0]
        loss = float((weights * (np.logaddexp(0, z) - labels * z)).sum())
        dz = ((1 / (1 + np.exp(-z)) - labels) * weights).astype(kind)
        dconv = dz[:, None] * self.out * (1 - h * h)
        seen = flat[won[..., None] * STRIDE + np.arange(WIDTH)]
        part = self.embedding[seen]
        back = dconv[..., None, None] * self.filters.T.reshape(1, n_filters, WIDTH, DEPTH)
        de = np.stack([np.bincount(seen.ravel(), back[..., d].ravel(), 256) for d in range(DEPTH)], axis=1)
        return loss, [de, np.einsum("bf,bfk->kf", dconv, part.reshape(len(texts), n_filters, -1)), dconv.sum(0), dz @ h, dz.sum(keepdims=True)]


def initial(seed: int = 7) -> ByteCnn:
    rng = np.random.default_rng(seed)
    return ByteCnn(
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rng.normal(0, 0.48 / WIDTH**0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )


def fit(texts: list[str | None], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the logistic loss, both labels of equal weight in sum. Same rows, same model."""
    net, rng = initial(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the score is the smoothed share of label 1
        net.out[:] = 0
        net.out_bias[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return net
    docs = [text_bytes(t) for t in texts]
    weight = np.where(y == 1, len(y) / y.sum(), len(y) / (len(y) - y.sum()))
    weight /= weight.mean()
    params = net.parameters()
    first, second, step = [p * 0 for p in params], [p * 0 for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            _, grads = net.gradients([docs[k] for k in pick], y[pick], weight[pick] / len(pick))
            step += 1
            for x, g, m, v in zip(params, grads, first, second):
                g = g + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                x -= (rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str | None, int]]:
    """(text, label) of at most ``limit`` labelled rows outside the held-out fold, the first in hash order.

    Of rows with one key the text that is first by digest counts, and the larger label. Texts over MAX_TRAINING_BYTES are left out, so the
    driver gets at most MAX_TRAINING_ROWS times as much.
    """
    open_ = labels.filter(crc_fold(key) != 1).filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"))
    ids = [r[0] for r in open_.select(key).orderBy(F.xxhash64(key), key).limit(limit).collect()]
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select(key).schema)  # bounded by limit
    short = docs.select(key, F.col(text).alias("_text")).filter(F.coalesce(F.octet_length("_text"), F.lit(0)) <= MAX_TRAINING_BYTES)
    picked = short.join(F.broadcast(few), key).join(F.broadcast(open_.join(F.broadcast(few), key, "left_semi")), key)
    row = F.struct(F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("digest"), "_text", "_label")
    rows = picked.groupBy(key).agg(F.min(row).alias("row")).collect()
    return [(r["row"]["_text"], int(r["row"]["_label"])) for r in sorted(rows, key=lambda r: r[key])]


def score_quality(docs: DataFrame, net: ByteCnn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, score, predicted.

    The score is the network's probability that label 1 holds, from the text alone: overlapping chunks over all its
    bytes, learned filters, maxima, one logistic unit. Null and empty texts are one chunk of padding;
    texts of any length are read whole, segment by segment; null keys, ties and repeated rows
    score alike; an empty table gives no rows; other columns are not read.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = net.scores(batch.column(1).to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[key, "score"])

    small_batches(docs.sparkSession)
    scored = docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double")
    return scored.select(key, (crc_fold(key) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, net: ByteCnn, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(net.scores(t.where(t.notna(), None).tolist()).astype("float64"))

    small_batches(docs.sparkSession)
    return docs.filter(score(F.col(text)) >= threshold)
