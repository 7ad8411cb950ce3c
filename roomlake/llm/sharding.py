"""Sharding by rendezvous (highest random weight) hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, uniform_hash


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (cost, shard) of the shard that wins the key.

    Every shard draws an exponential time -ln(u) / weight from a hash of (key, shard); the
    earliest wins, so a shard gets its weight's share, and a new shard takes keys only to itself.
    """
    draws = [
        F.struct((-F.log(uniform_hash(key, F.lit(s))) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws))


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_weight: float | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16. slot numbers a shard's rows gaplessly from 0 in key
    order. grown_shard is the shard after one more shard of ``grown_weight`` joins (default: the
    mean weight). Only key and shard count decide, so rows of one key (a hot key, repeated rows,
    a null key, which counts as the text "null") share a shard by law; they still get slots of
    their own and are numbered by many tasks. Null text counts as empty; an empty table gives no
    rows; other columns are ignored, whatever their names. Texts of any length are hashed whole; none is shuffled.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one at least positive")
    extra = sum(weights) / len(weights) if grown_weight is None else grown_weight
    body = F.coalesce(F.col(text), F.lit(""))
    now = rendezvous(F.col(key), weights)
    late = -F.log(uniform_hash(F.col(key), F.lit(len(weights)))) / F.lit(float(extra))
    slim = docs.select(
        F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), now.alias("_won"), late.alias("_late"),
    ).select(
        key, "size", "text_crc32", F.col("_won.shard").cast("int").alias("shard"),
        F.when(F.col("_late") < F.col("_won.cost"), len(weights)).otherwise(F.col("_won.shard")).cast("int").alias("grown_shard"),
    )
    return numbered(checkpointed(slim), ["shard"], [key, "text_crc32", "size"], "slot")
