"""Greedy selection as folds.

A sequential pass in a fixed order with a static pairwise test is a left fold over each group's
ranked items. Where the test is an expression on two items, it stands inside the fold, which then needs one shuffle and no
self-join; where it needs evidence of its own, Catalyst plans the pair join first.
Groups are a frame's or a scene's items, which are bounded by the scan, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_items(items: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Number the items of each group from 0 in the given (total) order."""
    return items.withColumn(out, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def _with_partners(ranked: DataFrame, pairs: DataFrame, group: list[str], item: str) -> DataFrame:
    """Per group, the ranked items with the earlier items they are paired with."""
    partners = pairs.groupBy(*group, F.col("later").alias(item)).agg(F.collect_list("earlier").alias("partners"))
    rows = ranked.join(partners, [*group, item], "left").withColumn("partners", F.coalesce("partners", F.array().cast("array<bigint>")))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("id"), "partners"))).alias("xs"))


def first_fit_fold(ranked: DataFrame, accepts: DataFrame, group: list[str], item: str, seed_only: bool) -> DataFrame:
    """(group, item, seed, cluster): each item joins the first cluster that accepts it, or starts one.

    ``accepts`` lists (earlier, later) pairs that may be together. A cluster accepts an item if its
    seed does (``seed_only``) or all its members do.
    """
    lists = _with_partners(ranked, accepts, group, item)

    def fits(members: Column, x: Column) -> Column:
        if seed_only:
            return F.array_contains(x["partners"], F.element_at(members, 1))
        return F.size(F.array_except(members, x["partners"])) == 0

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: fits(g, x)), F.lit(True))
        return F.when(at > 0, F.transform(acc, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(x["id"]))).otherwise(g))).otherwise(
            F.concat(acc, F.array(F.array(x["id"])))
        )

    groups = F.aggregate("xs", F.array().cast("array<array<bigint>>"), step)
    rows = lists.select(*group, F.posexplode(groups).alias("cluster", "members"))
    return rows.select(*group, F.explode("members").alias(item), F.element_at("members", 1).alias("seed"), F.col("cluster").cast("long").alias("cluster"))


def _sorted_lists(items: DataFrame, group: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """(group, xs): each group's items as structs (o0, o1, ..., fields), sorted by the order columns, all ascending."""
    item = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *[F.col(f).alias(f) for f in fields])
    return items.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("xs"))


def keep_by(items: DataFrame, group: list[str], order: list[Column], fields: list[str], conflict: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, fields) of the items kept by suppression: an item stays unless it conflicts with an earlier item that stayed.

    ``order`` must be total within a group; ``conflict(earlier, later)`` is an expression on two structs of ``fields``.
    """
    lists = _sorted_lists(items, group, order, fields)
    kind = lists.schema["xs"].dataType.simpleString()
    kept = F.aggregate(
        "xs", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: conflict(k, x)), acc).otherwise(F.concat(acc, F.array(x)))
    )
    return lists.select(*group, F.explode(kept).alias("x")).select(*group, *[F.col(f"x.{f}").alias(f) for f in fields])


def first_fit_by(items: DataFrame, group: list[str], order: list[Column], item: str, fields: list[str], accepts: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, item, seed, cluster, fields): each item joins the first cluster whose seed accepts it, or starts one.

    As first_fit_fold with ``seed_only``, the test ``accepts(seed, item)`` being an expression on two structs of item and fields.
    """
    fields = [item, *[f for f in fields if f != item]]
    lists = _sorted_lists(items, group, order, fields)
    kind = lists.schema["xs"].dataType.elementType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: F.coalesce(accepts(g["seed"], x), F.lit(False))), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.when(i + 1 == at, F.struct(g["seed"].alias("seed"), F.concat(g["xs"], F.array(x)).alias("xs"))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("seed"), F.array(x).alias("xs")))))

    groups = F.aggregate("xs", F.array().cast(f"array<struct<seed:{kind},xs:array<{kind}>>>"), step)
    rows = lists.select(*group, F.posexplode(groups).alias("cluster", "g"))
    rows = rows.select(*group, F.col(f"g.seed.{item}").alias("seed"), F.col("cluster").cast("long").alias("cluster"), F.explode("g.xs").alias("x"))
    return rows.select(*group, F.col(f"x.{item}").alias(item), "seed", "cluster", *[F.col(f"x.{f}").alias(f) for f in fields if f != item])
