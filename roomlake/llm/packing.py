"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, numbered, small_batches
from .word_bpe import word_bpe

#: Characters that are encoded in one go, so that a worker's memory doesn't follow the batch.
CHUNK_CHARS = 2_000_000


def cut_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, and ids if asked for.

    A document is its text's ids and then ``end_id``; it is cut at every multiple of
    ``capacity``. Null text counts as empty (one piece, the end id).
    """
    kind = docs.select(key).schema[0].dataType
    schema = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < CHUNK_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                ids, sizes = bpe.encode([t or "" for t in texts[at:to]])
                ends = np.cumsum(sizes)
                rows, start, length, crc, total, own = [], [], [], [], [], []
                for k, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    doc = np.append(ids[e - n : e], np.uint32(end_id)).astype("<u4")
                    for s in range(0, n + 1, capacity):
                        piece = doc[s : s + capacity]
                        rows.append(k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(n + 1)
                        if with_ids:
                            own.append(piece.astype(np.int64))
                columns = [batch.column(0).slice(at, to - at).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to
        bpe.clear()  # the worker lives on

    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, schema)


def fill_window(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths with the largest sum up to ``room``: bitset subset sums, backtracked.

    Bit s of a set says that sum s can be reached. A length's copies enter in parts of 1, 2, 4, ...
    so each part costs one shift; the sets before each part tell on the way back which were taken.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_windows(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, multiset) patterns that use every piece once.

    Minimum bin slack: a window starts with the longest piece left and the subset sums fill the
    rest as full as can be; the pattern repeats while its lengths last. The size of the plan
    follows the number of lengths (``capacity``), not of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        lead = max(left)
        left[lead] -= 1
        chosen = fill_window(left, capacity - lead)
        left[lead] += 1
        chosen[lead] = chosen.get(lead, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        plan.append((times, chosen))
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return plan


def place_pieces(pieces: DataFrame, capacity: int = 2048, tie: tuple[str, ...] = ("ids_crc32", "doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` from 1 to capacity.

    Only the histogram of lengths (capacity rows at most) comes to the driver. Pieces of a length
    are numbered across tasks, and a number's pattern, window and slot follow by arithmetic.
    ``pieces`` must be cheap to read twice. All its columns are kept but those named sequence_id or offset, which are replaced.
    An empty table gives no rows.
    """
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    (rank,) = fresh(pieces, "_rank")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece must have 1 to capacity tokens")
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, chosen in plan_windows(counts, capacity):
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], c, sequence, offset))
            used[n] += times * c
            offset += n * c
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)  # at most a few patterns a length
    starts = table[:, 0] * (1 << 48) + table[:, 1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, place = f["length"].to_numpy(np.int64), f.pop(rank).to_numpy(np.int64)
            k = np.searchsorted(starts, length * (1 << 48) + place, side="right") - 1
            nth = place - table[k, 1]
            f["sequence_id"] = table[k, 3] + nth // table[k, 2]
            f["offset"] = table[k, 4] + nth % table[k, 2] * length
            yield f

    ranked = numbered(pieces, ["length"], list(tie), rank)
    kept = ranked.drop(rank)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*kept.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset; see cut_documents and place_pieces.

    Every document's ids lie in exactly one piece each; null and empty texts give the end id alone. Texts of any length
    are cut; ties are placed by content; repeated rows are packed as often as they occur; null keys are carried along;
    columns other than key and text are not read. An empty table gives no rows.
    """
    pieces = checkpointed(cut_documents(docs, tokenizer, capacity, end_id, key, text))
    return place_pieces(pieces, capacity, ("ids_crc32", key, "start"))


def build_sequences(placed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, tokens, input_ids) from placed pieces with ids, padded to capacity unless tokens is a power of two."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # one window's tokens
    joined = placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("_ids"))
    tokens = F.size("_ids")
    pad = F.when(F.bit_count(tokens) == 1, 0).otherwise(F.lit(capacity) - tokens)
    return joined.select("sequence_id", tokens.cast("long").alias("tokens"), F.concat("_ids", F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("input_ids"))
