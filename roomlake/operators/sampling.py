"""Samplers and frame choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a large group's key range.
BLOCKS = 1024


def _ordered(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumns({"_i": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "_n": F.count(F.lit(1)).over(w)})


def _ordered_wide(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """As _ordered by one numeric key, for groups too large for one task.

    A group's key range is cut into BLOCKS equal parts; rows are numbered inside a part and moved by the number of rows before it. The cut
    follows from the group's least and largest key, so it is the same wherever it is worked out; uneven keys make uneven parts, never other numbers.
    """
    span = df.groupBy(*group).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    part = F.least(F.floor((F.col(key) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) * BLOCKS), F.lit(BLOCKS - 1))
    rows = df.join(span, group).withColumn("_part", part).drop("_lo", "_hi")
    sizes = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*group)  # over BLOCKS rows a group
    before = F.coalesce(F.sum("_k").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "_part", before.alias("_before"), F.sum("_k").over(w).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(key))
    return rows.join(starts, [*group, "_part"]).withColumn("_i", (place - 1 + F.col("_before")).cast("long")).drop("_part", "_before")


def linspace_sample(df: DataFrame, group: list[str], order: list[Column | str], k: int, wide: bool = False) -> DataFrame:
    """At most k rows a group, evenly spaced by position: position floor(i (n - 1) / (k - 1)) for i < k; all rows if n <= k.

    ``wide``: groups are as large as a scene's cloud; ``order`` is one numeric column then, without ties.
    """
    at = F.floor(F.col("_i").cast("double") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    near = lambda i: (i >= 0) & (i < k) & (F.floor(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))) == F.col("_i"))
    hit = near(at - 1) | near(at) | near(at + 1)
    rows = _ordered_wide(df, group, order[0]) if wide else _ordered(df, group, order)
    return rows.filter((F.col("_n") <= k) | hit).drop("_i", "_n")


def stride_sample(df: DataFrame, group: list[str], order: list[Column | str], cap: int, wide: bool = False) -> DataFrame:
    """Every (n div cap + 1)-th row of a group; ``wide`` as in linspace_sample."""
    step = F.floor(F.col("_n") / cap) + 1
    rows = _ordered_wide(df, group, order[0]) if wide else _ordered(df, group, order)
    return rows.filter(F.col("_i") % step == 0).drop("_i", "_n")


def sharpest_frames(frames: DataFrame, interval: int, look: int = 5) -> DataFrame:
    """(video, target, frame_idx): for every interval-th frame, the sharpest of the ``look`` frames from there; earliest of ties."""
    first = F.greatest(F.ceil((F.col("frame_idx") - look + 1) / F.lit(float(interval))), F.lit(0)).cast("long")
    last = F.floor(F.col("frame_idx") / F.lit(interval)).cast("long")
    targets = F.transform(F.sequence(first, last), lambda t: t * interval)
    spread = frames.filter(first <= last).withColumn("target", F.explode(targets))
    return spread.groupBy("video", "target").agg(F.max(F.struct("sharpness", (-F.col("frame_idx")).alias("late"))).alias("m")).select(
        "video", "target", (-F.col("m.late")).alias("frame_idx"), F.col("m.sharpness").alias("sharpness")
    )


def resample_frames(frames: DataFrame, most: int) -> DataFrame:
    """At most ``most`` frames a video, at positions round-half-even(i (n - 1) / (most - 1)); videos under two frames are refused."""
    n = F.col("_n")
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(most - 1))).cast("long")))
    numbered = _ordered(frames, ["video"], ["frame_idx"]).filter(n >= 2)
    return numbered.filter((n <= most) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n")


def quantile_frames(frames: DataFrame) -> DataFrame:
    """Frames at the five quarters of each video (positions rounded half to even, distinct)."""
    n = F.col("_n")
    spots = F.array(*[F.rint((n - 1) * f).cast("long") for f in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return _ordered(frames, ["video"], ["frame_idx"]).filter(F.array_contains(spots, F.col("_i"))).drop("_i", "_n")


def hash_sample(df: DataFrame, group: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """At most k rows a group, the first in the order of a seeded hash of the key: the same rows on every run.

    Spark limits each task's rows of a group to k before the shuffle, as the filter is on row_number.
    """
    w = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k).drop("_i")
