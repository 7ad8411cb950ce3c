"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import checkpointed, fresh, small_batches

#: Characters of the text that stand in a splitter; digest and key tell apart texts that share them.
SPLITTER_CHARS = 64
#: Whether a run touches its partition's start or end (both are possible).
INNER, FIRST, LAST = 0, 1, 2


def _run_starts(text: pa.Array, open_text: str | None) -> np.ndarray:
    """Where a batch's neighbouring texts differ, compared as a whole; the first with the run that is open."""
    same = np.zeros(len(text), bool)
    same[0] = open_text is not None and text[0].as_py() == open_text
    same[1:] = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(~same)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of one sorted partition (text, key, ...): every row but its text, with keep, size, head, edge and edge_text.

    The open run keeps ids and carried columns, never texts; the text of a run at a partition's edge stands on its first row.
    """
    held: list[pa.RecordBatch] = []
    held_n, open_text, first = 0, None, True

    def emit(parts: list[pa.RecordBatch], sizes: np.ndarray, edge: int = INNER, text: str | None = None) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        starts = np.cumsum(sizes) - sizes
        head = np.zeros(table.num_rows, bool)
        head[starts] = True
        spread = np.repeat(sizes, sizes)
        texts = pa.array([text] + [None] * (table.num_rows - 1), pa.string())
        columns = [*table.columns, table.column(0).take(pa.array(np.repeat(starts, sizes))), pa.array(spread, pa.int64()), pa.array(head), pa.array(np.full(len(spread), edge, np.int32)), texts]
        made = pa.Table.from_arrays(columns, names=[*table.column_names, "_keep", "_size", "_head", "_edge", "_edge_text"])
        return made.combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        text, slim = batch.column(0), batch.select(range(1, batch.num_columns))
        starts = _run_starts(text, open_text)
        upto = int(starts[0]) if len(starts) else batch.num_rows
        if upto:
            held.append(slim.slice(0, upto))
            held_n += upto
        if not len(starts):
            continue
        if held_n:
            yield emit(held, np.array([held_n]), FIRST if first else INNER, open_text if first else None)
            first = False
        if first and len(starts) > 1:
            yield emit([slim.slice(starts[0], starts[1] - starts[0])], np.diff(starts[:2]), FIRST, text[int(starts[0])].as_py())
            first, starts = False, starts[1:]
        if len(starts) > 1:
            yield emit([slim.slice(starts[0], starts[-1] - starts[0])], np.diff(starts))
        held, held_n, open_text = [slim.slice(starts[-1])], batch.num_rows - int(starts[-1]), text[int(starts[-1])].as_py()
    if held_n:
        yield emit(held, np.array([held_n]), LAST | (FIRST if first else INNER), open_text)


def _heads(text_at: int, edge: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scan of one sorted partition: the whole first row of every run, with its edge."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_text, first = None, None, True

        def emit(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([at] * rows.num_rows, pa.int32())], names=[*rows.schema.names, edge])

        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.fill_null(batch.column(text_at), "")
            starts = _run_starts(text, open_text)
            if not len(starts):
                continue
            rows = batch.take(pa.array(starts))
            if held is not None:
                yield emit(held, FIRST if first else INNER)
                first = False
            if first and rows.num_rows > 1:
                yield emit(rows.slice(0, 1), FIRST)
                first, rows = False, rows.slice(1)
            if rows.num_rows > 1:
                yield emit(rows.slice(0, rows.num_rows - 1), INNER)
            held, open_text = rows.slice(rows.num_rows - 1), text[int(starts[-1])].as_py()
        if held is not None:
            yield emit(held, LAST | (FIRST if first else INNER))

    return scan


def _one_text(texts: Column) -> Column:
    """True; an error if the texts of a digest are not all the same."""
    return F.when(F.min(texts) == F.max(texts), F.lit(True)).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("boolean"))


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min",
    normalise: Callable[[Column], Column] | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: key, carried columns, keep_id, group_size, kept, text_sha256.

    Sampled splitters (first characters, digest, key) range-partition the normalised texts; each task sorts its
    range externally by first characters, digest, whole text and key, which puts equal texts side by side, and compares
    whole neighbouring texts. The splitters are bounded however long the texts are and end in the key, so thousands of copies,
    or texts with one long beginning, spread over many tasks. A group that crosses partitions is the last run of one and
    the first of the next: the (at most two) runs at each partition's edges are summed by digest, and their whole
    texts compared. ``keep`` says whether the smallest ("min") or largest ("max") key of a group stays.

    Null text counts as empty, so null and empty texts are one group. Of repeated rows (equal key and
    text) exactly one is kept. A null key stays only if the whole group has none. An empty table gives no rows. Texts of any
    length are compared whole; a worker holds one batch of them. Columns other than key, text and carry are not read,
    whatever their names; carried columns must not be called like the output's.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    body = normalise(body) if normalise else body
    rows = docs.select(body.alias("_body"), F.col(key), *carry, F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    by_key = F.col(key).desc_nulls_last() if keep == "max" else F.col(key).asc_nulls_last()
    start = [F.substring("_body", 1, SPLITTER_CHARS), F.col("text_sha256")]
    placed = rows.repartitionByRange(*start, by_key).sortWithinPartitions(*start, "_body", by_key)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    layout = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry, "text_sha256"))
    layout += f", _keep {kinds[key]}, _size long, _head boolean, _edge int, _edge_text string"
    found = checkpointed(placed.mapInArrow(_runs, layout).withColumn("_part", F.spark_partition_id()))
    best = F.min if keep == "min" else F.max
    ends = found.filter("_head and _edge > 0")  # at most two rows a partition
    whole = ends.groupBy("text_sha256").agg(best("_keep").alias("_k"), F.sum("_size").alias("_s"), F.min("_part").alias("_p"), _one_text(F.col("_edge_text")).alias("_one"))
    # by digest and partition, so that a large group's rows don't meet in one task
    spans = ends.select("_part", "text_sha256").join(whole.filter("_one"), "text_sha256")
    at_edge = found.filter("_edge > 0").join(spans, ["_part", "text_sha256"])
    names = [key, *carry]
    inner = found.filter("_edge = 0").select(*names, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_head").alias("kept"), "text_sha256")
    return inner.unionAll(at_edge.select(
        *names, F.col("_k").alias("keep_id"), F.col("_s").cast("long").alias("group_size"), (F.col("_head") & (F.col("_p") == F.col("_part"))).alias("kept"), "text_sha256"
    ))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts.

    The sort of exact_groups over whole rows, so texts are shuffled once; the first row of every run is written to a checkpoint and,
    at partition edges, compared with the runs before. ``docs`` is read once (splitters are sampled apart), so
    its row order need not be the same on every reading. Null text counts as empty; of repeated rows one stays; a null key
    stays only if its group has no other; very long texts and empty tables as in exact_groups; no column name clashes.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    small_batches(docs.sparkSession)
    digest, edge, part, least = fresh(docs, "_digest", "_edge", "_part", "_least")
    body = F.coalesce(F.col(text), F.lit(""))
    by_key = F.col(key).desc_nulls_last() if keep == "max" else F.col(key).asc_nulls_last()
    start = [F.substring(body, 1, SPLITTER_CHARS), F.col(digest)]
    rows = docs.withColumn(digest, F.sha2(body.cast("binary"), 256))
    placed = rows.repartitionByRange(*start, by_key).sortWithinPartitions(*start, body, by_key)
    layout = StructType([*placed.schema.fields, StructField(edge, IntegerType())])
    heads = checkpointed(placed.mapInArrow(_heads(docs.columns.index(text), edge), layout).withColumn(part, F.spark_partition_id()))
    ends = heads.filter(F.col(edge) > 0)  # at most two rows a partition
    whole = ends.groupBy(digest).agg(F.min(part).alias(least), _one_text(body).alias(edge)).filter(F.col(edge))
    once = ends.select(part, digest).join(whole.select(digest, least), digest).filter(F.col(part) == F.col(least)).select(part, digest)
    return heads.filter(F.col(edge) == 0).select(docs.columns).unionAll(ends.join(once, [part, digest], "left_semi").select(docs.columns))
