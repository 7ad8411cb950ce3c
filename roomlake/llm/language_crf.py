"""Language ID: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_batches

#: Hashed affix and n-gram features; weights are one row each, the last row stays zero.
BUCKETS = 1 << 16
LEXICON_WORDS = 4000
#: A chain is a line. Messages go along SEGMENT_WORDS words of all chains at once; from segment to segment they are carried.
SEGMENT_WORDS = 128
#: Words of each of two lines that a fit splices.
SPLICE_WORDS = 64
#: Labelled documents that a fit may use at most, and the bytes of the longest text among them.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 1200, 1 << 17
CACHE_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(x: np.ndarray, tag: int) -> np.ndarray:
    x = (x + np.uint64(tag)) * _MIX
    return ((x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(48)).astype(np.int64) % BUCKETS


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word of each): byte 3- and 4-grams of "^word$", prefixes and suffixes of 1 to 3 bytes."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size) - size
    b = np.frombuffer(b"".join(raw) + b"\0" * 4, np.uint8).astype(np.uint64)
    n = int(size.sum())
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(n)  # bytes from here to the word's end
    three = b[:n] | b[1 : n + 1] << np.uint64(8) | b[2 : n + 2] << np.uint64(16)
    four = three | b[3 : n + 3] << np.uint64(24)
    found = [(_bucket(three[m], 1 << 40), owner[m]) for m in [left >= 3]] + [(_bucket(four[m], 2 << 40), owner[m]) for m in [left >= 4]]
    ids = np.arange(len(words))
    for k in (1, 2, 3):
        m = size >= k + 2
        s, e = start[m] + 1, start[m] + size[m] - 1
        pre, suf = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
        for j in range(k):
            pre |= b[s + j] << np.uint64(8 * j)
            suf |= b[e - k + j] << np.uint64(8 * j)
        found += [(_bucket(pre, (2 + k) << 40), ids[m]), (_bucket(suf, (5 + k) << 40), ids[m])]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def chains_of(text: str) -> list[list[str]]:
    return [words for line in text.lower().split("\n") if (words := line.split())]


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the segments of all chains in order; whether a segment continues the one before."""
    parts = -(-lengths // SEGMENT_WORDS)
    size = np.full(int(parts.sum()), SEGMENT_WORDS)
    last = np.cumsum(parts) - 1
    some = parts > 0
    size[last[some]] = lengths[some] - (parts[some] - 1) * SEGMENT_WORDS
    joined = np.ones(len(size), bool)
    joined[(last - parts + 1)[some]] = False
    return size, joined


def _carried(scores: np.ndarray, step: np.ndarray, begin: np.ndarray, size: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages over the cuts: alpha of the word before each segment (rows of segments that continue one), beta at each segment's last word.

    A segment's transfer matrix takes the alpha before it to the alpha at its end; the matrices of all segments of
    long chains are made at once, then alpha goes along a chain's segments and beta back.
    """
    n = step.shape[0]
    into, out_of = np.ones((len(size), n)), np.ones((len(size), n))
    followed = np.append(joined[1:], False)
    long = np.flatnonzero(joined | followed)
    if not len(long):
        return into, out_of
    first = long[~joined[long]]
    matrix = np.zeros((len(long), n, n))
    matrix[joined[long]] = np.eye(n)
    # a chain's first segment has no alpha before it: all its rows start as the first word's scores
    matrix[~joined[long]] = scores[begin[first]][:, None, :]
    order = np.argsort(-size[long], kind="stable")
    for t in range(int(size[long].max())):
        live = order[: int(np.searchsorted(-size[long][order], -t, side="left"))]
        if t == 0:
            live = live[joined[long][live]]
        m = (matrix[live] @ step) * scores[begin[long[live]] + t][:, None, :]
        matrix[live] = m / m.sum(axis=(1, 2), keepdims=True)
    place = np.cumsum(joined | followed) - 1
    alpha = None
    for s in long:
        if not joined[s]:
            alpha = matrix[place[s], 0]
        else:
            into[s] = alpha
            alpha = alpha @ matrix[place[s]]
        alpha = alpha / alpha.sum()
    for s in long[::-1]:
        if followed[s]:
            beta = matrix[place[s + 1]] @ out_of[s + 1]
            out_of[s] = beta / beta.sum()
    return into, out_of


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, want_moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of each word's label for chains of any length laid end to end; expected transitions if asked for."""
    n_labels = emit.shape[1]
    scores = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(moves)
    size, joined = _segments(np.asarray(lengths, np.int64))
    begin = np.cumsum(size) - size
    into, out_of = _carried(scores, step, begin, size, joined)
    order = np.argsort(-size, kind="stable")
    begin, size, joined, into = begin[order], size[order], joined[order], into[order]
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # segments longer than t
    alpha = np.empty_like(scores)
    for t in range(longest):
        at = begin[: live[t]] + t
        if t:
            a = (alpha[at - 1] @ step) * scores[at]
        else:
            a = np.where(joined[:, None], into @ step, 1.0) * scores[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    post = np.empty_like(scores)
    beta = out_of[order]
    expected = np.zeros_like(step) if want_moves else None
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        g = alpha[at] * beta[:k]
        post[at] = g / g.sum(axis=1, keepdims=True)
        b = scores[at] * beta[:k]
        if want_moves:
            before = alpha[at - 1] if t else into
            joint = before[:, :, None] * step * b[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += (joint if t else joint[joined]).sum(axis=0)
        if t:
            b = b @ step.T
            beta[:k] = b / b.sum(axis=1, keepdims=True)
    return post, expected


@dataclass
class LanguageCrf:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    moves: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        bucket, owner = word_features(words)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        w = self.weights[bucket]
        out = np.stack([np.bincount(owner, w[:, k], len(words)) for k in range(len(self.labels))], axis=1) / np.sqrt(n)[:, None]
        lex = np.fromiter((self.lexicon.get(x, -1) for x in words), np.int64, len(words))
        return out + self.lexicon_weights[lex]  # the last row is zero

    def _codes(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if self.table is None or len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.table, new = {}, np.empty((0, len(self.labels)), np.float32), set(words)
        if new:
            fresh = list(new)
            self.table = np.concatenate([self.table, self.emissions(fresh).astype(np.float32)])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, share of the words' posterior) of each whole text; "und" without a letter."""
        words: list[str] = []
        lengths: list[int] = []
        owner: list[int] = []
        lettered = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            lettered[k] = True
            for chain in chains_of(text):
                words += chain
                lengths.append(len(chain))
                owner.append(k)
        totals = np.zeros((len(texts), len(self.labels)))
        if words and self.labels:
            sizes = np.array(lengths)
            post, _ = forward_backward(self.table_rows(words), sizes, self.moves)
            rows = np.repeat(np.array(owner), sizes)
            for k in range(len(self.labels)):
                totals[:, k] = np.bincount(rows, post[:, k], len(texts))
        share = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)
        best = share.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        return [(self.labels[b], float(min(share[k, b], 1.0))) if lettered[k] and self.labels else ("und", 0.0) for k, b in enumerate(best)]

    def table_rows(self, words: list[str]) -> np.ndarray:
        codes = self._codes(words)
        return self.table[codes].astype(np.float64)


def fit(texts: list[str], langs: list[str], steps: int = 60, rate: float = 0.15, seed: int = 5) -> LanguageCrf:
    """Maximum likelihood by Adam over all chains at once.

    A document's label stands for all its words. Every second line is spliced with a line of another language's
    document (SPLICE_WORDS of each), so the transitions are learned from code-switched chains too.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pools = {k: [c for t, g in zip(texts, langs) if g == lab for c in chains_of(t)] for k, lab in enumerate(labels)}
    chains, gold = [], []
    for k, pool in pools.items():
        others = [j for j in pools if j != k and pools[j]]
        for i, chain in enumerate(pool):
            if i % 2 and others:
                j = others[int(rng.integers(len(others)))]
                other = pools[j][int(rng.integers(len(pools[j])))]
                chain, tail = chain[:SPLICE_WORDS], other[:SPLICE_WORDS]
                chains.append(chain + tail)
                gold.append([k] * len(chain) + [j] * len(tail))
            else:
                chains.append(chain)
                gold.append([k] * len(chain))
    n = len(labels)
    words = [w for c in chains for w in c]
    y = np.array([g for c in gold for g in c], np.int64)
    distinct, inverse, counts = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True) if words else (np.array([], object), np.array([], int), np.array([], int))
    top = np.argsort(-counts, kind="stable")[:LEXICON_WORDS]
    lexicon = {distinct[i]: k for k, i in enumerate(top) if counts[i] > 1}
    net = LanguageCrf(labels, np.zeros((BUCKETS, n)), lexicon, np.zeros((len(lexicon) + 1, n)), np.zeros((n, n)))
    if n < 2 or not words:
        return net
    bucket, owner = word_features(list(distinct))
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(distinct)), 1))
    lex = np.array([lexicon.get(w, len(lexicon)) for w in distinct])
    lengths = np.array([len(c) for c in chains])
    onehot = np.eye(n)[y]
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen_moves = np.bincount(y[at - 1] * n + y[at], minlength=n * n).reshape(n, n)
    params = [net.weights, net.lexicon_weights, net.moves]
    first, second = [p * 0 for p in params], [p * 0 for p in params]
    for step in range(1, steps + 1):
        emit = np.stack([np.bincount(owner, net.weights[bucket, k], len(distinct)) for k in range(n)], axis=1) * scale[:, None] + net.lexicon_weights[lex]
        post, expected = forward_backward(emit[inverse], lengths, net.moves, True)
        gap = (onehot - post) / len(y)
        per_word = np.stack([np.bincount(inverse, gap[:, k], len(distinct)) for k in range(n)], axis=1)
        scaled = per_word * scale[:, None]
        grads = [
            np.stack([np.bincount(bucket, scaled[owner, k], BUCKETS) for k in range(n)], axis=1),
            np.stack([np.bincount(lex, per_word[:, k], len(lexicon) + 1) for k in range(n)], axis=1),
            (seen_moves - expected) / len(y),
        ]
        grads[1][-1] = 0
        for x, g, m, v in zip(params, grads, first, second):
            g = g - 1e-6 * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        net.lexicon_weights[-1] = 0
    net.weights = net.weights.astype(np.float32)
    return net


def training_rows(docs: DataFrame, limit: int = MAX_TRAINING_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(text, lang) of at most ``limit`` documents outside the held-out fold, the first in hash order.

    Of rows with one key the one that is first by digest and lang counts. Texts over MAX_TRAINING_BYTES are left out, so the driver gets at
    most MAX_TRAINING_ROWS times as much.
    """
    open_ = docs.filter(crc_fold(key) != 1).filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    open_ = open_.filter(F.octet_length(text) <= MAX_TRAINING_BYTES).select(key, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    ids = [r[0] for r in open_.select(key).distinct().orderBy(F.xxhash64(key), key).limit(limit).collect()]
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select(key).schema)  # bounded by limit
    row = F.struct(F.sha2(F.col("_text").cast("binary"), 256).alias("digest"), "_lang", "_text")
    rows = open_.join(F.broadcast(few), key).groupBy(key).agg(F.min(row).alias("row")).collect()
    return [(r["row"]["_text"], r["row"]["_lang"]) for r in sorted(rows, key=lambda r: r[key])]


def predict_language(docs: DataFrame, net: LanguageCrf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score.

    Every word of the whole text gets label probabilities by forward-backward along its whole line; the label with the largest
    share of a text's words is predicted, and the share is the score. A null text, or one without a letter, is "und" with
    score 0. Null keys, ties and repeated rows are predicted alike; an empty table gives no rows; a tie goes
    to the first label in order; other columns are not read, whatever their names. Very long texts are read whole; a worker
    holds one batch of texts and the words of about 2 million characters (or one text).
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS rows and LEXICON_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 2_000_000):
                    chars += len(texts[to] or "")
                    to += 1
                found = model.predict(texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[key, "lang_pred", "score"]
                )
                at = to

    said = docs.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")
    return said.select(key, (crc_fold(key) == 1).alias("held_out"), "lang_pred", "score")
