"""Exact quantiles of large groups: two passes over the rows, and no group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Equal parts of a group's value range in the first pass.
BINS = 4096


def sorted_quantiles(values: Column, shares: Sequence[float]) -> Column:
    """Array of linearly interpolated quantiles of a sorted array without nulls; null for an empty one.

    lo * (1 - d) + hi * d with a fused multiply-add, as DuckDB interpolates: a value that lies exactly on a threshold falls on the same side
    there and here, which the built-in percentile, with one rounding more, doesn't give.
    """

    def one(q: float) -> Column:
        at = (F.size(values) - 1) * F.lit(float(q))
        lo, hi, d = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int")), at - F.floor(at)
        fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, 1.0 - d, hi * d).cast("double")
        return F.when(d > 0, fused).otherwise(lo)

    return F.when(F.size(values) > 0, F.array(*map(one, shares)))


def quantiles(df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """(keys, names): an array of linearly interpolated quantiles for each name's expression; null where a group has no value.

    The first pass counts values by part of the group's range (partial aggregates, BINS rows a group at most), which tells the parts
    that hold the ranks asked for. The second keeps the rows of those parts only, counted by distinct value. So a
    task holds the distinct values of one part, where the built-in percentile holds those of a whole group. Equal to it for finite
    values; NaN counts as no value.
    """
    named = F.array(*[F.struct(F.lit(n).alias("name"), x.cast("double").alias("v")) for n, (x, _) in wanted.items()])
    values = df.select(*keys, F.explode(named).alias("s")).select(*keys, "s.*").filter("v is not null and not isnan(v)")
    by = [*keys, "name"]
    span = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    part = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BINS), F.lit(BINS - 1)).cast("int")
    parted = values.join(span, by).select(*by, part.alias("part"), "v")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parted.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*by))})
    shares = F.create_map(*[x for n, (_, q) in wanted.items() for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in q]))])
    ranks = F.transform(shares[F.col("name")], lambda q: (F.col("total") - 1) * q)
    sides = F.flatten(F.transform(ranks, lambda p, i: F.array(
        F.struct(i.alias("i"), F.lit(0).alias("side"), F.floor(p).alias("rank"), p.alias("at")), F.struct(i.alias("i"), F.lit(1).alias("side"), F.ceil(p).alias("rank"), p.alias("at"))
    )))
    targets = counted.withColumn("t", F.explode(sides)).filter((F.col("t.rank") >= F.col("first")) & (F.col("t.rank") < F.col("first") + F.col("n")))
    targets = targets.select(*by, "part", "t.*", (F.col("t.rank") - F.col("first")).alias("inside"))
    held = parted.join(targets.select(*by, "part").distinct(), [*by, "part"]).groupBy(*by, "part", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("below", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    found = targets.join(held, [*by, "part"]).filter((F.col("inside") >= F.col("below")) & (F.col("inside") < F.col("below") + F.col("k")))
    both = found.groupBy(*by, "i").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"), F.max("at").alias("at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    lists = both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("q"))
    return lists.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in wanted])
