"""Observations to instances: bounds, voting, duplicate tests, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box_iou, norm, overlap
from .greedy import first_fit_by, first_fit_fold, rank_items

AXES = ("x", "y", "z")


def robust_bounds(points: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentile box of each group's points, its centre and diagonal, and the number of points."""
    q = points.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in AXES], F.count(F.lit(1)).alias("n_raw"))
    lo, hi = {c: F.col(c)[0] for c in AXES}, {c: F.col(c)[1] for c in AXES}
    return q.select(
        *keys, *[lo[c].alias(f"lo_{c}") for c in AXES], *[hi[c].alias(f"hi_{c}") for c in AXES],
        *[((lo[c] + hi[c]) / 2).alias(f"c_{c}") for c in AXES], norm(*[hi[c] - lo[c] for c in AXES]).alias("diag"), "n_raw",
    )


def vote_labels(obs: DataFrame) -> DataFrame:
    """(inst_id, label, score, frames_seen, best_obs, n_obs): the label with most distinct frames, then score sum, best
    score and points, first seen of ties; score and best view from the winning label's observations only.
    """
    by = obs.groupBy("inst_id", "label").agg(
        F.countDistinct("frame").alias("frames"), F.sum("score").alias("total"), F.max("score").alias("top"), F.sum("n_raw").alias("points"),
        F.min("ord").alias("first"), F.max(F.struct("n_raw", (-F.col("ord")).alias("neg"), "obs_id")).alias("best"),
    )
    evidence = F.struct("frames", F.round("total", 9).alias("total"), "top", "points", (-F.col("first")).alias("neg"))
    won = by.groupBy("inst_id").agg(F.max_by(F.struct("label", "top", "best"), evidence).alias("w"))
    pooled = obs.groupBy("inst_id").agg(F.countDistinct("frame").alias("frames_seen"), F.count(F.lit(1)).alias("n_obs"))
    return won.join(pooled, "inst_id").select("inst_id", "w.label", F.col("w.top").alias("score"), "frames_seen", F.col("w.best.obs_id").alias("best_obs"), "n_obs")


def drop_ghosts(instances: DataFrame) -> DataFrame:
    """Instances seen in two frames or with a score of at least 0.45."""
    return instances.filter((F.col("frames_seen") >= 2) | (F.col("score") >= 0.45))


def separated_pairs(obs: DataFrame) -> DataFrame:
    """(a, b): instances that share a frame in which their boxes are nearly disjoint."""
    x, y = obs.alias("x"), obs.alias("y")
    on = (F.col("x.frame") == F.col("y.frame")) & (F.col("x.inst_id") < F.col("y.inst_id"))
    return x.join(y, on).filter(box_iou("x", "y") <= 0.15).select(F.col("x.inst_id").alias("a"), F.col("y.inst_id").alias("b")).distinct()


def _axis(name: str, side: str, part: str) -> Column:
    return F.col(f"{side}.{part}_{name}")


def _extent(side: str, c: str) -> Column:
    return F.greatest(_axis(c, side, "hi") - _axis(c, side, "lo"), F.lit(1e-6))


def containment(a: str = "p", b: str = "q") -> Column:
    """Common volume over the smaller volume of two boxes lo_/hi_ xyz."""
    inter = F.lit(1.0)
    va, vb = F.lit(1.0), F.lit(1.0)
    for c in AXES:
        inter = inter * overlap(_axis(c, a, "lo"), _axis(c, a, "hi"), _axis(c, b, "lo"), _axis(c, b, "hi"))
        va, vb = va * _extent(a, c), vb * _extent(b, c)
    return inter / F.greatest(F.least(va, vb), F.lit(1e-9))


def shared_frame_duplicates(bounds: DataFrame, boxes_iou: DataFrame, iou: float = 0.60, held: float = 0.45) -> DataFrame:
    """(inst_a, inst_b): instances whose 2-D boxes agree in a shared frame and whose 3-D boxes hold each other."""
    p, q = bounds.alias("p"), bounds.alias("q")
    near = boxes_iou.filter(F.col("max_iou") >= iou)
    joined = near.join(p, F.col("inst_a") == F.col("p.inst_id")).join(q, F.col("inst_b") == F.col("q.inst_id"))
    return joined.filter(containment() >= held).select("inst_a", "inst_b")


def split_track_candidates(bounds: DataFrame, separated: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """(group, earlier, later, standard, containment): tracks of one group that may occupy one object, by their boxes alone.

    Size ratios are taken earlier over later; ``standard``: they agree within a factor of two.
    """
    p, q = bounds.alias("p"), bounds.alias("q")
    on = (F.col(f"p.{group}") == F.col(f"q.{group}")) & (F.col(f"p.{rank}") < F.col(f"q.{rank}"))
    ratio = [_extent("p", c) / _extent("q", c) for c in AXES]
    within = lambda lo, hi: ((ratio[0] >= lo) & (ratio[0] <= hi) & (ratio[1] >= lo) & (ratio[1] <= hi) & (ratio[2] >= lo) & (ratio[2] <= hi))
    gap = norm(*[_axis(c, "p", "c") - _axis(c, "q", "c") for c in AXES])
    scale = F.greatest(norm(*[_extent("p", c) for c in AXES]), norm(*[_extent("q", c) for c in AXES]), F.lit(1e-6))
    rows = p.join(q, on & within(0.38, 2.6) & (gap / scale <= 0.24)).select(
        F.col(f"p.{group}").alias(group), F.col("p.inst_id").alias("earlier"), F.col("q.inst_id").alias("later"), within(0.5, 2.0).alias("standard"), containment().alias("containment")
    ).filter(F.col("containment") >= 0.48)
    apart = separated.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return rows.join(apart, (F.least("earlier", "later") == F.col("_a")) & (F.greatest("earlier", "later") == F.col("_b")), "left_anti")


def split_tracks_needing_support(candidates: DataFrame) -> DataFrame:
    """(earlier, later): candidates that only the overlap of their clouds can settle."""
    return candidates.filter(~F.col("standard") | (F.col("containment") < 0.68)).select("earlier", "later")


def split_track_pairs(bounds: DataFrame, separated: DataFrame, support: DataFrame | None, group: str, rank: str = "rank") -> DataFrame:
    """(group, earlier, later, containment): tracks of one group that occupy one object.

    ``support`` (earlier, later, support_max, support_mean) is
    needed for pairs that pass the relaxed rules only; None lets none of those through.
    """
    return split_tracks_settled(split_track_candidates(bounds, separated, group, rank), support)


def split_tracks_settled(candidates: DataFrame, support: DataFrame | None) -> DataFrame:
    if support is None:
        return candidates.filter(F.col("standard") & (F.col("containment") >= 0.68)).drop("standard")
    rows = candidates.join(support, ["earlier", "later"], "left").fillna(0.0, ["support_max", "support_mean"])
    first = F.col("standard") | ((F.col("support_max") >= 0.68) & (F.col("support_mean") >= 0.28))
    second = (F.col("containment") >= 0.68) | ((F.col("support_max") >= 0.48) & (F.col("support_mean") >= 0.20))
    return rows.filter(first & second).drop("standard", "support_max", "support_mean")


def cloud_support(points: DataFrame, pairs: DataFrame, scales: DataFrame, ratio: float = 0.075, least: int = 10) -> DataFrame:
    """(earlier, later, support_max, support_mean): shares of two clouds with a neighbour in the other within tolerance.

    The tolerance is ``ratio`` of the smaller robust diagonal. Only the existence of a neighbour matters, so the search is
    an equi-join on grid cells of that size: one cloud stays in its cells, the other is
    copied to the 27 cells around each point; the points that meet tell both shares. Points of a pair only meet inside common cells. ``points`` (inst_id, pid, x, y, z)
    should be sampled already.
    """
    d = scales.select("inst_id", "diag", "n_raw")
    sized = (
        pairs.join(d.select(F.col("inst_id").alias("earlier"), F.col("diag").alias("da"), F.col("n_raw").alias("na")), "earlier")
        .join(d.select(F.col("inst_id").alias("later"), F.col("diag").alias("db"), F.col("n_raw").alias("nb")), "later")
        .filter((F.col("na") >= least) & (F.col("nb") >= least))
        .select("earlier", "later", F.greatest(F.lit(ratio) * F.least("da", "db"), F.lit(1e-6)).alias("tol"))
    )
    pts = points.select("inst_id", "pid", *AXES)
    cells = [F.floor(F.col(c) / F.col("tol")).alias(f"k{c}") for c in AXES]
    a = sized.join(pts.withColumnRenamed("inst_id", "earlier"), "earlier").select("earlier", "later", "tol", F.col("pid").alias("pa"), *AXES, *cells)
    b = sized.join(pts.withColumnRenamed("inst_id", "later"), "later").select("earlier", "later", F.col("pid").alias("pb"), *[F.col(c).alias(f"{c}b") for c in AXES], *cells)
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    wide = b.withColumn("s", F.explode(steps)).select("earlier", "later", "pb", *[f"{c}b" for c in AXES], *[(F.col(f"k{c}") + F.col(f"s.{c}")).alias(f"k{c}") for c in AXES])
    close = norm(*[F.col(c) - F.col(f"{c}b") for c in AXES]) <= F.col("tol")
    met = a.join(wide, ["earlier", "later", "kx", "ky", "kz"]).filter(close).groupBy("earlier", "later").agg(F.countDistinct("pa").alias("ka"), F.countDistinct("pb").alias("kb"))
    size = pts.groupBy("inst_id").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        sized.select("earlier", "later").join(size.select(F.col("inst_id").alias("earlier"), F.col("n").alias("na")), "earlier")
        .join(size.select(F.col("inst_id").alias("later"), F.col("n").alias("nb")), "later").join(met, ["earlier", "later"], "left")
    )
    share = lambda k, n: F.coalesce(F.col(k), F.lit(0)) / F.col(n)
    both = rows.select("earlier", "later", share("ka", "na").alias("sa"), share("kb", "nb").alias("sb"))
    return both.select("earlier", "later", F.greatest("sa", "sb").alias("support_max"), F.sqrt(F.col("sa") * F.col("sb")).alias("support_mean"))


def mesh_support(points: DataFrame, surface: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mesh_id, support): share of an instance's points with a surface sample within max(0.025, 0.06 of its diagonal).

    points: mesh_id, pid, x, y, z; surface: mesh_id, x, y, z, sampled from its mesh; sizes: mesh_id, diag. As in cloud_support only the
    existence of a neighbour matters: an equi-join on grid cells of the tolerance, the distinct surface cells' points copied to the 27 cells around.
    """
    tol = sizes.select("mesh_id", F.greatest(F.lit(0.025), 0.06 * F.col("diag")).alias("tol"))
    cells = [F.floor(F.col(c) / F.col("tol")).alias(f"k{c}") for c in AXES]
    a = points.join(tol, "mesh_id").select("mesh_id", "pid", "tol", *AXES, *cells)
    b = surface.join(tol, "mesh_id").select("mesh_id", *[F.col(c).alias(f"{c}b") for c in AXES], *cells)
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    wide = b.withColumn("s", F.explode(steps)).select("mesh_id", *[f"{c}b" for c in AXES], *[(F.col(f"k{c}") + F.col(f"s.{c}")).alias(f"k{c}") for c in AXES])
    close = norm(*[F.col(c) - F.col(f"{c}b") for c in AXES]) <= F.col("tol")
    hit = a.join(wide, ["mesh_id", "kx", "ky", "kz"]).filter(close).groupBy("mesh_id").agg(F.countDistinct("pid").alias("k"))
    total = points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(hit, "mesh_id", "left").select("mesh_id", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("support"))


def merge_complete_link(instances: DataFrame, accepts: DataFrame, group: str) -> DataFrame:
    """(group, inst_id, seed, cluster): first-fit grouping in evidence order; all members must accept."""
    ranked = evidence_rank(instances, group)
    return first_fit_fold(ranked, accepts, [group], "inst_id", seed_only=False)


def evidence_rank(instances: DataFrame, group: str) -> DataFrame:
    return rank_items(instances, [group], [F.desc("frames_seen"), F.desc("score"), F.desc("n_points"), F.asc("inst_id")])


def cluster_light(dets3d: DataFrame, group: list[str], distance: float = 0.5) -> DataFrame:
    """Merged detections: each joins the first seed of its label nearer than ``distance``; best score, mean centre, largest size."""
    fields = ["score", "cx3", "cy3", "cz3", "sx", "sy", "sz"]
    near = lambda a, b: norm(*[a[c] - b[c] for c in ("cx3", "cy3", "cz3")]) < distance
    found = first_fit_by(dets3d, group, [F.col("det_id")], "det_id", fields, near)
    return found.groupBy(*group, "seed").agg(
        F.max("score").alias("score"), *[F.avg(c).alias(c) for c in ("cx3", "cy3", "cz3")], *[F.max(c).alias(c) for c in ("sx", "sy", "sz")], F.count(F.lit(1)).alias("n")
    )


def cluster_observations(obs: DataFrame, group: list[str]) -> DataFrame:
    """(group, obs_id, cluster, frames_seen, kept): seed clustering of each label's observations.

    Seeds go by score; a seed takes the later observations nearest first if they are within 0.6 of the larger
    diagonal (strictly) and no member of the same frame is a distinct object (box IoU at most 0.15). The candidates' order
    depends on the seed, so this is no fold: one label of one scene is a group in numpy. Clusters
    under two frames with a score under 0.45 are marked and keep their members. Columns: obs_id, ord, frame, score, cx3, cy3, cz3,
    diag, x1, y1, x2, y2.
    """

    def iou(a: np.ndarray, b: np.ndarray) -> float:
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0.0) * max(h, 0.0)
        return inter / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter, 1e-9)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "ord"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at, diag, frame = f[["cx3", "cy3", "cz3"]].to_numpy(), f["diag"].to_numpy(), f["frame"].to_numpy()
        box, score = f[["x1", "y1", "x2", "y2"]].to_numpy(), f["score"].to_numpy()
        label = np.full(len(f), -1)
        frames, kept = np.zeros(len(f), np.int64), np.zeros(len(f), bool)
        for seed in range(len(f)):
            if label[seed] >= 0:
                continue
            label[seed] = seed
            members = [seed]
            later = seed + 1 + np.flatnonzero(label[seed + 1 :] < 0)
            far = np.linalg.norm(at[later] - at[seed], axis=1)
            near = far < 0.6 * np.maximum(np.maximum(diag[seed], diag[later]), 1e-6)
            later, far = later[near], far[near]
            for j in later[np.argsort(far, kind="stable")]:
                if all(frame[m] != frame[j] or iou(box[m], box[j]) > 0.15 for m in members):
                    label[j] = seed
                    members.append(j)
            n = len(set(frame[members]))
            frames[members], kept[members] = n, n >= 2 or score[members].max() >= 0.45
        out = f[[*group, "obs_id"]].copy()
        out["cluster"], out["frames_seen"], out["kept"] = f["obs_id"].to_numpy()[label], frames, kept
        return out

    types = dict(obs.dtypes)
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", obs_id long, cluster long, frames_seen long, kept boolean"
    return obs.groupBy(*group).applyInPandas(run, schema)


def support_image(members: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(inst_id, obs_id, image_score): the observation that shows each instance best.

    members: inst_id, obs_id, ord, label_match, support, centre, det_score, sharpness, mask, box x1 to y2. Observations with the
    instance's label go first if any; boxes need 4 pixels each way after clipping.
    """
    w, h = size
    clip = lambda c, hi: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(hi)))
    rows = members.withColumns({"qx1": clip("x1", w), "qx2": clip("x2", w), "qy1": clip("y1", h), "qy2": clip("y2", h)}).filter("qx2 - qx1 >= 4 and qy2 - qy1 >= 4")
    scoped = rows.withColumn("any_match", F.max("label_match").over(Window.partitionBy("inst_id"))).filter(F.col("label_match") | ~F.col("any_match"))
    clipped = ((F.col("qx1") <= 1) | (F.col("qy1") <= 1) | (F.col("qx2") >= w - 1) | (F.col("qy2") >= h - 1)).cast("double")
    score = (
        0.42 * F.col("support") + 0.23 * F.col("centre") + 0.12 * F.col("det_score") + 0.10 * F.least(F.log1p("sharpness") / 7, F.lit(1.0))
        + 0.08 * F.col("mask") + 0.05 * F.col("label_match").cast("double") - 0.08 * clipped
    )
    best = scoped.withColumn("image_score", F.round(score, 9)).groupBy("inst_id").agg(F.max(F.struct("image_score", (-F.col("ord")).alias("neg"), "obs_id")).alias("m"))
    return best.select("inst_id", "m.obs_id", "m.image_score")


def scan_mesh_quality(meshes: DataFrame) -> DataFrame:
    """mesh_id, score, good from support, bbox, component, n_points, frames_seen and faces."""
    density = F.least(F.col("n_points") / 1000.0, F.lit(1.0))
    views = F.least(F.col("frames_seen") / 2.0, F.lit(1.0))
    score = 0.45 * F.col("support") + 0.25 * F.col("bbox") + 0.10 * F.col("component") + 0.10 * density + 0.10 * views
    good = (F.col("faces") >= 100) & (F.col("n_points") >= 300) & (F.col("support") >= 0.25) & (F.col("bbox") >= 0.35) & (F.col("component") >= 0.65) & (F.round(score, 9) >= 0.48)
    return meshes.select("mesh_id", F.round(score, 9).alias("score"), good.alias("good"))
