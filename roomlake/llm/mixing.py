"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import checkpointed, fresh, uniform_hash

#: A table of rates with at most this many sources is broadcast; a longer one is joined by sort-merge.
MAX_BROADCAST_SOURCES = 10_000
NULL_SOURCE = "\x00null"


@F.pandas_udf(ArrayType(DoubleType()))
def poisson_cdf(rates: pd.Series) -> pd.Series:
    """Array of P(count <= k) for k = 0, 1, ... until the rest is below 1e-15 or so; [1.0] at rate 0. One a source."""

    def one(rate: float) -> np.ndarray:
        if not rate > 0:
            return np.ones(1)
        k = np.arange(math.ceil(rate + 10 * math.sqrt(rate) + 20) + 1, dtype=np.float64)
        return np.cumsum(np.exp(k * math.log(rate) - rate - np.cumsum(np.log(np.maximum(k, 1)))))

    return pd.Series([one(r) for r in rates], dtype=object)


def mixing_rates(docs: DataFrame, weights: Mapping[str, float] | None, total: float | None, temperature: float, source: str, text: str) -> DataFrame:
    """(source, rate): mean repetitions so that each source's characters reach its weight's share of the total."""
    named = F.coalesce(F.col(source), F.lit(NULL_SOURCE))
    sizes = docs.groupBy(named.alias("_source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("double").alias("_size"))
    if weights is None:
        goal = F.pow("_size", F.lit(1 / temperature))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        goal = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    whole = "sum({}) over ()"  # one row a source, never one a document
    goals = sizes.withColumn("_goal", goal)
    budget = F.expr(whole.format("_size")) if total is None else F.lit(float(total))
    rate = budget * F.col("_goal") / F.expr(whole.format("_goal")) / F.col("_size")
    rated = goals.withColumn("rate", F.when(F.expr(whole.format("_goal")) > 0, rate).otherwise(F.lit(0.0)))
    return rated.select("_source", "rate", poisson_cdf(F.col("rate")).alias("_cdf"))


def poisson_mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, temperature: float = 2.0,
    seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text", shuffle: bool = True,
) -> DataFrame:
    """Each row as often as its Poisson draw says, with ``copy`` (from 0), ``rate`` and ``shuffle_key``, in a global shuffle.

    The mean of a row's draw is its source's rate: target characters over present characters.
    ``weights`` are the sources' target shares (a source that is not named gets none); None takes
    present size to the power 1/temperature. ``total`` is the mixture's size in characters, by default the input's.
    The draw inverts the Poisson distribution at a hash of (seed, key), so it is the same on every run and on a re-tried
    task. The order is by a hash of (seed, key, copy): sampled ranges, sorted, so row order in the written files is the shuffle.
    A null source is a source of its own (named "\\x00null" in ``weights``); a null key draws as the text "null"; rows
    of one key draw alike; null text counts as empty; long texts move whole. An empty table gives no rows. All columns of the
    input are kept but those named copy, rate or shuffle_key, which are replaced. Documents are never
    grouped by source; only one sum a source is, and large tables of sources are joined by sort-merge. A row looks its draw up
    in its source's distribution, whose length is about the number of its copies.
    """
    made = ("copy", "rate", "shuffle_key")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    name, cdf, n = fresh(docs, "_source", "_cdf", "_n")
    rates = checkpointed(mixing_rates(docs, weights, total, temperature, source, text)).toDF(name, "rate", cdf)
    small = rates.count() <= MAX_BROADCAST_SOURCES
    named = docs.withColumn(name, F.coalesce(F.col(source), F.lit(NULL_SOURCE)))
    joined = named.join(F.broadcast(rates) if small else rates, name)
    u = uniform_hash(F.lit(seed), F.col(key))
    counts = joined.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u)))
    copies = counts.filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n, cdf, name)
    mixed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"), F.lit("order"))))
    return mixed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else mixed
