"""2-D detections: overlap joins, suppression, cannot-link pairs, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box_iou, iou_of
from ..functions.labels import OPENINGS, REFLECTORS, has_word
from .greedy import keep_by, rank_items

NMS_IOU, DISTINCT_IOU, INSIDE_RATIO = 0.70, 0.15, 0.5


def score_ranked(dets: DataFrame) -> DataFrame:
    """Rank per (frame, label): score descending, detection order for ties."""
    return rank_items(dets, ["frame", "label"], [F.desc("score"), F.asc("det_id")])


def iou_pairs(dets: DataFrame, least: float) -> DataFrame:
    """Pairs of a frame's equal-label boxes with IoU of at least ``least``, the higher-ranked first."""
    ranked = score_ranked(dets)
    a, b = ranked.alias("a"), ranked.alias("b")
    on = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.rank") < F.col("b.rank"))
    pairs = a.join(b, on).withColumn("iou", box_iou("a", "b")).filter(F.col("iou") >= least)
    return pairs.select("a.frame", "a.label", F.col("a.det_id").alias("earlier"), F.col("b.det_id").alias("later"), "iou")


def _suppressed(dets: DataFrame, least: float) -> DataFrame:
    """The rows that suppression keeps, with all their columns: one shuffle by (frame, label), the fold inside its aggregate."""
    fields = [c for c in dets.columns if c not in ("frame", "label")]
    return keep_by(dets, ["frame", "label"], [-F.col("score"), F.col("det_id")], fields, lambda a, b: iou_of(a, b) >= least)


def suppress_overlapping(dets: DataFrame, least: float = NMS_IOU) -> DataFrame:
    """Non-maximum suppression: (frame, label, det_id) of the boxes that stay, best score first, then detection order."""
    return _suppressed(dets.select("frame", "label", "det_id", "score", "x1", "y1", "x2", "y2"), least).select("frame", "label", "det_id")


def cannot_link_pairs(dets: DataFrame) -> DataFrame:
    """Pairs in one frame that can't be one object: nearly disjoint boxes, or one reflector holding the other.

    Expects reflector_ratio, the share of the detection inside a reflector.
    """
    flagged = dets.withColumn("reflector", has_word(F.col("label"), REFLECTORS))
    a, b = flagged.alias("a"), flagged.alias("b")
    inside = F.when(F.col("a.reflector"), F.col("b.reflector_ratio")).otherwise(F.col("a.reflector_ratio"))
    mirrored = (F.col("a.reflector") != F.col("b.reflector")) & (inside >= INSIDE_RATIO)
    on = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.det_id") < F.col("b.det_id"))
    return a.join(b, on).withColumn("iou", box_iou("a", "b")).filter((F.col("iou") <= DISTINCT_IOU) | mirrored).select(
        "a.frame", F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b")
    )


def same_frame_duplicates(dets: DataFrame, iou: float = 0.5, distance: float = 0.35) -> DataFrame:
    """Pairs of one frame with enough overlap whose centres are near, against the larger diagonal."""
    a, b = dets.alias("a"), dets.alias("b")
    mid = lambda t, n: (F.col(f"{t}.{n}1") + F.col(f"{t}.{n}2")) / 2
    diag = lambda t: F.hypot(F.col(f"{t}.x2") - F.col(f"{t}.x1"), F.col(f"{t}.y2") - F.col(f"{t}.y1"))
    on = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.det_id") < F.col("b.det_id"))
    near = F.hypot(mid("a", "x") - mid("b", "x"), mid("a", "y") - mid("b", "y")) <= distance * F.greatest(diag("a"), diag("b"))
    return a.join(b, on).filter((box_iou("a", "b") >= iou) & near).select("a.frame", F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"))


def shared_frame_max_iou(members: DataFrame) -> DataFrame:
    """(inst_a, inst_b, max_iou, shared): largest IoU of two instances' boxes over the frames they share."""
    a, b = members.alias("a"), members.alias("b")
    on = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.inst_id") < F.col("b.inst_id"))
    return a.join(b, on).withColumn("iou", box_iou("a", "b")).groupBy(F.col("a.inst_id").alias("inst_a"), F.col("b.inst_id").alias("inst_b")).agg(
        F.max("iou").alias("max_iou"), F.count(F.lit(1)).alias("shared")
    )


def first_per_frame(dets: DataFrame, n: int = 20) -> DataFrame:
    """The first n detections of each frame in detection order."""
    w = Window.partitionBy("frame").orderBy("det_id")
    return dets.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def second_pass_frames(frames: DataFrame, passes: int = 12) -> DataFrame:
    """(video, frame) that get a second detector pass: every ceil(n / passes)-th frame of a video's n, and the last.

    frames: video, frame, numbered from 0 without gaps.
    """
    n = frames.groupBy("video").agg((F.max("frame") + 1).alias("n"))
    step = F.greatest(F.ceil(F.col("n") / F.lit(float(passes))), F.lit(1))
    return frames.join(n, "video").filter((F.col("frame") % step == 0) | (F.col("frame") == F.col("n") - 1)).select("video", "frame")


def second_pass_missing(found: DataFrame, frames: DataFrame, planar: list[str], threshold: float) -> DataFrame:
    """(frame, label, threshold): planar labels that the first pass missed in the frames of the second, and the lower bar for them."""
    wanted = frames.select("frame").withColumn("label", F.explode(F.array(*[F.lit(x) for x in planar])))
    return wanted.join(found.select("frame", "label").distinct(), ["frame", "label"], "left_anti").withColumn("threshold", F.lit(max(0.18, threshold - 0.08)))


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Concatenate two detector passes and suppress overlaps across them."""
    return _suppressed(first.unionByName(second), NMS_IOU)


def mask_gate(dets: DataFrame, least_pixels: int = 16, least_iou: float = 0.5, most: int = 20) -> DataFrame:
    """The first ``most`` detections of each frame with has_mask: enough pixels and a good enough estimate of the mask's own quality.

    dets: frame, det_id, mask_pixels, mask_iou (null where there is no mask).
    """
    good = F.coalesce((F.col("mask_iou") >= least_iou) & (F.col("mask_pixels") >= least_pixels), F.lit(False))
    return first_per_frame(dets, most).drop("rn").withColumn("has_mask", good)


def admitted(dets: DataFrame, mask_pixels: DataFrame, good_pixels: DataFrame, least: int = 30) -> DataFrame:
    """(frame, det_id, n_good): detections that become observations: with a mask, not an opening, enough good pixels under the mask.

    mask_pixels: frame, det_id, u, v; good_pixels: frame, u, v. The mask meets the good pixels by pixel, counts are partial aggregates.
    """
    solid = dets.filter(~has_word(F.col("label"), OPENINGS)).select("frame", "det_id")
    held = mask_pixels.join(good_pixels.select("frame", "u", "v"), ["frame", "u", "v"]).groupBy("frame", "det_id").agg(F.count(F.lit(1)).alias("n_good"))
    return held.filter(F.col("n_good") >= least).join(solid, ["frame", "det_id"])


def status_lines(dets3d: DataFrame, group: list[str]) -> DataFrame:
    """(group, place, line): a scene's detected objects, best score first, as lines of its status text."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("det_id"))).cast("long")
    rows = dets3d.withColumn("place", place)
    return rows.select(*group, "place", F.format_string("**%d. %s** (%d%%)", F.col("place"), F.upper("label"), F.rint(F.col("score") * 100).cast("long")).alias("line"))
