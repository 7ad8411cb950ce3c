"""LM scoring: cross-entropy difference between matched target and background bigram models."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: The shared vocabulary of fit(): the corpus's most frequent words; the rest is one unknown word.
VOCABULARY = 50_000
#: Bigrams that fit() keeps at most (the most frequent; the rest backs off to single words). 16 MB.
MAX_BIGRAMS = 1 << 20
#: Dirichlet weight of the backed-off distribution.
SMOOTHING = 8.0
_CHUNK_CHARS = 4_000_000
#: Distinct words that a task counts before it hands them on.
_HELD_WORDS = 300_000
#: Tokens of a chunk of documents (at least one document), and about as many of a part of the table of counts.
CHUNK_TOKENS = PART_TOKENS = 1 << 21
#: Bytes of a text that make a token, about; only the number of parts follows from it.
TOKEN_BYTES = 6
#: The context of a text's first word, and the weights of a bigram's two word hashes in its code. Words have odd codes, all else even ones.
_START, _BEFORE, _NEXT = np.uint64(0x5851F42D4C957F2C), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(1)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with a bounded number of characters."""
    size = np.array([len(x) if x is not None else 0 for x in batch.column(1).to_pylist()], np.int64)
    at = 0
    while at < len(size):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), _CHUNK_CHARS)))
        yield at, to
        at = to


@dataclass
class MatchedModels:
    """Both models over one vocabulary; background counts are scaled to the target's number of tokens."""

    words: dict[str, int]  # from 1; 0 is the unknown word, len + 1 a text's start
    single: np.ndarray  # (2, V) counts of words, with the start as context
    codes: np.ndarray  # sorted bigram codes: previous * V + next
    pair: np.ndarray  # (2, codes) counts

    def __post_init__(self) -> None:
        tokens = np.maximum(self.single[:, :-1].sum(axis=1), 1.0)
        self.scale = np.array([1.0, tokens[0] / tokens[1]])
        lone = self.single * self.scale[:, None]
        base = lone.copy()
        base[:, -1] = 0
        self.alone = (base + 1) / (base.sum(axis=1, keepdims=True) + base.shape[1])
        self.context = lone + SMOOTHING

    def losses(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text; summed -log P of (target, background)."""
        v = self.single.shape[1]
        flat, sizes = tokens_of(texts, self.words)
        out = np.zeros((2, len(texts)))
        if len(flat):
            before = np.concatenate([[v - 1], flat[:-1]])
            begin = np.cumsum(sizes) - sizes
            before[begin[sizes > 0]] = v - 1
            code = before * v + flat
            at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            hit = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
            owner = np.repeat(np.arange(len(texts)), sizes)
            for m in range(2):
                seen = np.where(hit, self.pair[m][at] * self.scale[m], 0.0) if len(self.codes) else 0.0
                p = (seen + SMOOTHING * self.alone[m][flat]) / self.context[m][before]
                out[m] = np.bincount(owner, -np.log(p), len(texts))
        return sizes, out


def tokens_of(texts: list[str | None], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    flat: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = (text or "").split()
        flat += own
        sizes[k] = len(own)
    get = words.get
    return np.fromiter((get(w, 0) for w in flat), np.int64, len(flat)), sizes


def fit(docs: DataFrame, is_target: str = "is_target", text: str = "text", vocabulary: int = VOCABULARY, max_bigrams: int = MAX_BIGRAMS) -> MatchedModels:
    """Counts over every whole text: target rows make the target model, all other rows the background.

    Bounded models, small enough to broadcast, for tables outside ``docs``; corpus_cross_entropy_difference scores ``docs`` by all counts.

    Words and bigrams are counted in the tasks first and then summed by key. The driver gets the vocabulary and the
    kept bigrams only; the least count that is kept comes from a histogram of counts by magnitude.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(is_target).cast("boolean"), F.lit(False)).alias("t"), F.col(text).alias("x"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])
        for batch in batches:
            for x in batch.column(0):
                found.update((x.as_py() or "").split())
            if len(found) > _HELD_WORDS:
                yield out()
                found.clear()
        yield out()

    totals = rows.select("x").mapInArrow(count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "w").limit(vocabulary).toArrow().to_pydict()
    words = {w: k + 1 for k, (_, w) in enumerate(sorted(zip((-n for n in top["n"]), top["w"])))}
    v = len(words) + 2
    shared = spark.sparkContext.broadcast(words)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in _chunks(batch):
                flat, sizes = tokens_of(batch.column(1).slice(a, b - a).to_pylist(), known)
                if not len(flat):
                    continue
                before = np.concatenate([[v - 1], flat[:-1]])
                begin = (np.cumsum(sizes) - sizes)[sizes > 0]
                before[begin] = v - 1
                mine = np.repeat(target[a:b], sizes)
                code, at = np.unique(before * v + flat, return_inverse=True)
                counts = [np.bincount(at, m, len(code)).astype(np.int64) for m in (mine, ~mine)]
                yield pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, counts)], names=["c", "n0", "n1"])

    pairs = checkpointed(
        rows.mapInArrow(count_pairs, "c long, n0 long, n1 long").groupBy("c").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .withColumn("size", F.floor(8 * F.log2(F.col("n0") + F.col("n1"))).cast("int"))
    )
    single = np.zeros((2, v))
    for column, k in ((F.col("c") % v, "next"), (F.floor(F.col("c") / v), "start")):
        some = pairs if k == "next" else pairs.filter(F.col("c") >= (v - 1) * v)
        sums = some.groupBy(column.cast("long").alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most v rows
        for m, n in enumerate(("n0", "n1")):
            single[m, sums["w"].to_numpy()] = sums[n].to_numpy()
    kept, least = 0, 1 << 30
    for r in sorted(pairs.groupBy("size").count().collect(), key=lambda r: -r["size"]):  # a few hundred rows
        if kept + r["count"] > max_bigrams:
            break
        kept, least = kept + r["count"], r["size"]
    table = pairs.filter(F.col("size") >= least).select("c", "n0", "n1").toArrow()  # max_bigrams rows at most
    order = np.argsort(table["c"].to_numpy())
    codes = table["c"].to_numpy()[order]
    pair = np.stack([table[n].to_numpy()[order].astype(np.float32) for n in ("n0", "n1")])
    return MatchedModels(words, single, codes, pair)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, so that high zero bytes cost next to nothing."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Odd 64-bit hash of each word; ``known`` is the task's cache."""
    if len(known) > _HELD_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") | 1
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _codes(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct codes (words, bigrams and the start), sorted; each token's word, bigram and context as places among them."""
    n, first = len(h), (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.concatenate([[_START], h])[:n]
    before[first] = _START
    codes, at = np.unique(np.concatenate([h, (before * _BEFORE + h * _NEXT) & ~_ODD, [_START]]), return_inverse=True)
    context = np.concatenate([at[-1:], at[:n]])[:n]
    context[first] = at[-1]
    return codes, at[:n], at[n : 2 * n], context


def _occurrences(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often each token's code occurs in the token's own document."""
    _, at, n = np.unique(owner * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
    return n[at]


def corpus_cross_entropy_difference(docs: DataFrame, key: str = "doc_id", text: str = "text", is_target: str = "is_target", leave_one_out: bool = True) -> DataFrame:
    """The columns of cross_entropy_difference, by models of all words and all bigrams of ``docs`` themselves.

    With ``leave_one_out`` a document's own words and bigrams are taken out of its own model first, so no document is near the
    target for being part of it; one that occurs twice is still known from its copy.

    Documents go in chunks of about CHUNK_TOKENS tokens. A chunk sends its distinct words and bigrams with its counts to the
    parts of the table of counts, by the leading bits of their 64-bit codes; a part sums them over all chunks and sends
    each chunk the sums of what it asked for, so nothing is cut or broadcast and no task holds more than a chunk or a
    part. Every part hears of every chunk, so it also sums the corpus's tokens and, over all parts, its distinct words, and the texts are
    read once. The number of parts follows the corpus's bytes, and a frequent bigram is one entry a chunk. Two of n bigrams share a code with
    probability n * n / 2 ** 64 or so: 1 at the 4e9 of 30 GB.

    Null, empty and blank texts have no tokens and zeros; whole texts of any length are read (a longer one than CHUNK_TOKENS is a chunk of its
    own); null keys, ties and repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.coalesce(F.col(is_target).cast("boolean"), F.lit(False)).alias("t"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, target flags, sizes and word hashes of a few documents at a time."""
        known: dict[str, int] = {}
        for batch in batches:
            for a, b in _chunks(batch):
                words, sizes = [], np.zeros(b - a, np.int64)
                for i, x in enumerate(batch.column(1).slice(a, b - a)):
                    own = (x.as_py() or "").split()
                    words += own
                    sizes[i] = len(own)
                yield batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), sizes, _word_hashes(words, known)

    size = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(size / TOKEN_BYTES, 1) / PART_TOKENS)))
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        task, done = TaskContext.get().partitionId(), 0

        def asked() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([x[0] for x in held])
            target, sizes, h = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            codes, word, pair, _ = _codes(h, sizes)
            mine, start = np.repeat(target, sizes), int(np.searchsorted(codes, _START))
            counts = []
            for m, owned in ((mine, target), (~mine, ~target)):
                n = np.bincount(word[m], minlength=len(codes)) + np.bincount(pair[m], minlength=len(codes))
                n[start] += np.count_nonzero(owned & (sizes > 0))
                counts.append(n.astype(np.uint32))
            # by task and content, so that a chunk that a re-run task makes otherwise is seen
            name = hashlib.blake2b(f"{task}:{done}:".encode() + codes.tobytes() + sizes.tobytes(), digest_size=8).digest()
            chunk = int.from_bytes(name, "little") >> 1
            sorted_h, rank, often = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            own = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            tokens = int(sizes[target].sum()), int(sizes[~target].sum())
            yield row(chunk, -1 - chunk, own, tokens, _pack(sorted_h[order]), _pack(place[rank]), _pack(2 * sizes + target))
            bounds = [0, *np.searchsorted(codes, edges).tolist(), len(codes)]
            none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), keys[:0])
            for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
                yield row(chunk, part, none, tokens, _pack(np.diff(codes[a:b], prepend=np.uint64(0))), *(_pack(n[a:b]) for n in counts))

        def row(chunk: int, part: int, keys: pa.Array, tokens: tuple[int, int], *data: bytes) -> pa.RecordBatch:
            told = (chunk, part, *tokens, 0)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in told), keys, *(pa.array([x], pa.binary()) for x in data)], names=["chunk", "part", "n0", "n1", "words", "keys", "x", "y", "z"])

        for some in texts(batches):
            held.append(some)
            if sum(len(x[3]) for x in held) >= CHUNK_TOKENS:
                yield from asked()
                held.clear()
                done += 1
        if held:
            yield from asked()

    def add(group: pa.Table) -> pa.Table:
        if group["part"][0].as_py() < 0:
            return group
        codes = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in group["x"]]
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        for name, total in (("n0", pc.sum(group["n0"])), ("n1", pc.sum(group["n1"])), ("words", pa.scalar(int(np.count_nonzero(distinct & _ODD))))):
            group = group.set_column(group.schema.get_field_index(name), name, pa.array([total.as_py()] * len(codes), pa.int64()))
        ends = np.cumsum([len(x) for x in codes])[:-1]
        for name in ("y", "z"):
            sums = np.bincount(at, np.concatenate([_unpack(x.as_py(), np.uint32) for x in group[name]]), len(distinct)).astype(np.uint64)
            group = group.set_column(group.schema.get_field_index(name), name, pa.array([_pack(x) for x in np.split(sums[at], ends)], pa.binary()))
        return group.set_column(group.schema.get_field_index("x"), "x", pa.array([b""] * len(codes), pa.binary()))

    def score(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        own = {c: group[c][0] for c in ("keys", "x", "y", "z")}
        if group["part"].to_pylist()[1:] != list(range(1 << bits)):
            raise RuntimeError("a chunk of documents and its counts do not match: a task that was run again read other rows")
        tokens, n_words = [group[n][1].as_py() for n in ("n0", "n1")], pc.sum(group["words"]).as_py()
        marked = _unpack(own["z"].as_py(), np.int64)
        sizes, target = marked >> 1, (marked & 1).astype(bool)
        codes, word, pair, context = _codes(_unpack(own["x"].as_py(), np.uint64)[_unpack(own["y"].as_py(), np.uint32)], sizes)
        owner, per = np.repeat(np.arange(len(sizes)), sizes), []
        if leave_one_out:
            own_word, own_pair = _occurrences(owner, word), _occurrences(owner, pair)
            own_context = np.concatenate([own_word[:1], own_word])[: len(word)]
            own_context[(np.cumsum(sizes) - sizes)[sizes > 0]] = 1  # the start
        left = [np.where(target == (m == 0), tokens[m] - leave_one_out * sizes, tokens[m]) for m in range(2)]
        for m, name in enumerate(("y", "z")):
            n = np.concatenate([_unpack(x.as_py(), np.uint64) for x in group[name][1:]]).astype(np.float64)
            if len(n) != len(codes):
                raise RuntimeError("a chunk of documents and its counts do not match: a task that was run again read other rows")
            n_word, n_pair, n_context = n[word], n[pair], n[context]
            if leave_one_out:
                mine = (target == (m == 0))[owner]
                n_word, n_pair, n_context = n_word - mine * own_word, n_pair - mine * own_pair, n_context - mine * own_context
            match = np.maximum(left[0], 1) / np.maximum(left[m], 1)
            scale = match[owner]
            alone = (n_word * scale + 1) / ((left[m] * match)[owner] + n_words + 2)
            p = (n_pair * scale + SMOOTHING * alone) / (n_context * scale + SMOOTHING)
            per.append(np.bincount(owner, -np.log(p), len(sizes)) / np.maximum(sizes, 1))
        return pa.Table.from_arrays([own["keys"].values, pa.array(sizes), pa.array(per[0]), pa.array(per[1]), pa.array(per[0] - per[1])], names=[key, "n_tokens", "target_loss", "background_loss", "score"])

    layout = f"chunk long, part long, n0 long, n1 long, words long, keys array<{kind}>, x binary, y binary, z binary"
    summed = rows.mapInArrow(ask, layout).groupBy("part").applyInArrow(add, layout)
    return summed.groupBy("chunk").applyInArrow(score, f"{key} {kind}, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, models: MatchedModels, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, target_loss, background_loss, score.

    Losses are nats a token; score is target loss minus background loss, so lower is closer to the
    target. Null, empty and blank texts have no tokens and zeros; whole texts of any length are read; null keys, ties and
    repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by VOCABULARY and MAX_BIGRAMS
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value
        for batch in batches:
            for a, b in _chunks(batch):
                sizes, losses = both.losses(batch.column(1).slice(a, b - a).to_pylist())
                per = losses / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(per[0]), pa.array(per[1]), pa.array(per[0] - per[1])],
                    names=[key, "n_tokens", "target_loss", "background_loss", "score"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, target_loss double, background_loss double, score double")


#: At most this many target keys (16 MB) are broadcast to the documents.
MAX_BROADCAST_KEYS = 2_000_000


def mark_targets(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with is_target: whether the key is among ``keys``; few keys by broadcast, many by sort-merge.

    A column named is_target is replaced; a null key is no target; all rows are kept.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "is_target"])
    listed = checkpointed(keys.select(key).filter(F.col(key).isNotNull()).distinct())
    few = listed.count() <= MAX_BROADCAST_KEYS
    marked = listed.withColumn("is_target", F.lit(True))
    return docs.join(F.broadcast(marked) if few else marked, key, "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
