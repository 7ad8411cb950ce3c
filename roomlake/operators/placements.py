"""Placed objects: their boxes, duplicates among them, and consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm, placed_half_extents
from .instances import AXES, containment, merge_complete_link, vote_labels


def placement_boxes(placed: DataFrame) -> DataFrame:
    """Placements (px, py, pz at bottom centre, yaw, w, h, d) with lo_, hi_ and c_ xyz of the axis-aligned box around each."""
    hx, hz = placed_half_extents(F.col("w"), F.col("d"), F.col("yaw"))
    low = {"x": F.col("px") - hx, "y": F.col("py"), "z": F.col("pz") - hz}
    high = {"x": F.col("px") + hx, "y": F.col("py") + F.col("h"), "z": F.col("pz") + hz}
    boxed = placed.withColumns({f"lo_{c}": low[c] for c in AXES} | {f"hi_{c}": high[c] for c in AXES})
    return boxed.withColumns({f"c_{c}": (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in AXES})


def placed_candidates(boxes: DataFrame, separated: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """(group, earlier, later, standard, containment): placements of one group that may show one object twice.

    boxes: placement_boxes with the group, inst_id and the evidence rank. Sorted footprints (a yaw may be a quarter turn off) and heights
    are comparable, boxes hold each other by half or more, centres are near, and no shared frame tells them apart (``separated``: a, b). ``standard``:
    sizes agree within a factor of two.
    """
    p, q = boxes.alias("p"), boxes.alias("q")
    on = (F.col(f"p.{group}") == F.col(f"q.{group}")) & (F.col(f"p.{rank}") < F.col(f"q.{rank}"))
    side = lambda t, pick: pick(F.col(f"{t}.w"), F.col(f"{t}.d"))
    ratio = [
        side("p", F.least) / F.greatest(side("q", F.least), F.lit(1e-6)), side("p", F.greatest) / F.greatest(side("q", F.greatest), F.lit(1e-6)),
        F.col("p.h") / F.greatest(F.col("q.h"), F.lit(1e-6)),
    ]
    within = lambda lo, hi: (ratio[0] >= lo) & (ratio[0] <= hi) & (ratio[1] >= lo) & (ratio[1] <= hi) & (ratio[2] >= lo) & (ratio[2] <= hi)
    extent = lambda t: norm(*[F.col(f"{t}.hi_{c}") - F.col(f"{t}.lo_{c}") for c in AXES])
    gap = norm(*[F.col(f"p.c_{c}") - F.col(f"q.c_{c}") for c in AXES])
    near = gap / F.greatest(extent("p"), extent("q"), F.lit(1e-6)) <= 0.25
    rows = p.join(q, on & within(0.38, 2.6) & near).select(
        F.col(f"p.{group}").alias(group), F.col("p.inst_id").alias("earlier"), F.col("q.inst_id").alias("later"), within(0.5, 2.0).alias("standard"), containment().alias("containment")
    ).filter("containment >= 0.52")
    apart = separated.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return rows.join(apart, (F.least("earlier", "later") == F.col("_a")) & (F.greatest("earlier", "later") == F.col("_b")), "left_anti")


def needs_support(candidates: DataFrame) -> DataFrame:
    """(earlier, later): candidates that only the overlap of their clouds can settle."""
    return candidates.filter(~F.col("standard") | (F.col("containment") < 0.72)).select("earlier", "later")


def placed_duplicates(candidates: DataFrame, support: DataFrame, group: str) -> DataFrame:
    """(group, earlier, later, containment) of the candidates that are duplicates; ``support`` as of cloud_support, for needs_support."""
    rows = candidates.join(support, ["earlier", "later"], "left").fillna(0.0, ["support_max", "support_mean"])
    sizes = F.col("standard") | ((F.col("support_max") >= 0.68) & (F.col("support_mean") >= 0.28))
    held = (F.col("containment") >= 0.72) | ((F.col("support_max") >= 0.48) & (F.col("support_mean") >= 0.20))
    return rows.filter(sizes & held).select(group, "earlier", "later", "containment")


def consolidate(instances: DataFrame, duplicates: DataFrame, group: str) -> DataFrame:
    """(group, inst_id, seed, cluster): complete-link groups of duplicates in order of evidence."""
    return merge_complete_link(instances, duplicates, group)


def revote(observations: DataFrame, groups: DataFrame) -> DataFrame:
    """Instances voted anew from all observations of each group; inst_id is the group's seed."""
    moved = observations.join(groups.select("inst_id", "seed"), "inst_id").withColumn("inst_id", F.col("seed")).drop("seed")
    return vote_labels(moved)
