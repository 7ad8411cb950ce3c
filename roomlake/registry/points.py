"""Queries on pixels, points, observations, instances and volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instances as inst
from ..operators import placements, room
from ..operators import projection as proj
from ..operators.detections import shared_frame_max_iou
from ..operators.detections import status_lines as status_text
from ..operators.sampling import hash_sample as hashed
from ..sources.carriers import carrier, duck
from .detections import IOU

GRID, IMAGE = (25, 20), (480, 360)
#: Volume of the fusion query: lower corner, upper corner, voxels, truncation, least confidence.
VOLUME = ((-2.0, -1.0, 0.0), (2.0, 1.0, 3.0), (17, 9, 13), 0.75, 2.0)


def _r(*names: str, places: int = 6) -> list:
    return [(F.round(n, places) + 0.0).alias(n) for n in names]


#: Added before rounding means of lattice values, which may end in a 5 just behind the last digit.
TIE = 1.23e-8


def _rt(*names: str) -> list:
    return [F.round(F.col(n) + TIE, 6).alias(n) for n in names]


def unproject_points(spark: SparkSession, sf: str) -> DataFrame:
    lifted = proj.unproject_pixels(carrier(spark, sf, "pixels"), carrier(spark, sf, "cameras"))
    return lifted.select("frame", "u", "v", *_r("wx", "wy", "wz"))


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    return proj.project_points(carrier(spark, sf, "points").select("pid", "frame", "x", "y", "z"), carrier(spark, sf, "cameras"))


def project_points(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).select("pid", "frame", *_r("pu", "pv", "pz"))


def visible_points(spark: SparkSession, sf: str) -> DataFrame:
    seen = proj.visible(proj.sample_depth(_projected(spark, sf), carrier(spark, sf, "pixels"), *GRID))
    return seen.select("pid", "frame", "u", "v", *_r("pz", "seen"))


def best_view_color(spark: SparkSession, sf: str) -> DataFrame:
    points = carrier(spark, sf, "points").select("pid", (F.col("obj_id") % 8).alias("scene"), "x", "y", "z")
    cams = carrier(spark, sf, "cameras").withColumn("scene", F.expr("frame div 4 % 8"))
    return proj.best_view_color(points, carrier(spark, sf, "pixels"), cams, *GRID)


def _gated(spark: SparkSession, sf: str, excluded: bool) -> DataFrame:
    px = carrier(spark, sf, "pixels").withColumns({
        "scene": F.expr("frame div 4"), "edge": (F.col("u") * 3 + F.col("v")) % 11 == 0, "excluded": ((F.col("u") + F.col("frame")) % 4 == 0) if excluded else F.lit(False),
    })
    return px


def conf_gate(spark: SparkSession, sf: str) -> DataFrame:
    return proj.confidence_gate(_gated(spark, sf, False), ["scene"], 20).select("frame", "u", "v", *_r("conf_used", "bar"))


def masked_gate(spark: SparkSession, sf: str) -> DataFrame:
    return proj.confidence_gate(_gated(spark, sf, True), ["scene"], 20).select("frame", "u", "v", *_r("conf_used", "bar"))


def open_gate(spark: SparkSession, sf: str) -> DataFrame:
    return proj.confidence_gate(_gated(spark, sf, True), ["scene"], 0, and_valid=False).select("frame", "u", "v", *_r("conf_used", "bar"))


def depth_edges(spark: SparkSession, sf: str) -> DataFrame:
    return proj.depth_edges(carrier(spark, sf, "pixels"), 0.8).select("frame", "u", "v", "edge")


def _lifted(spark: SparkSession, sf: str) -> DataFrame:
    return proj.lift_boxes(carrier(spark, sf, "detections"), carrier(spark, sf, "pixels"), carrier(spark, sf, "cameras"), GRID, IMAGE)


def detections_to_3d(spark: SparkSession, sf: str) -> DataFrame:
    return _lifted(spark, sf).select("det_id", "frame", "label", *_rt("score", "cx3", "cy3", "cz3", "sx", "sy", "sz"))


def cluster_3d_light(spark: SparkSession, sf: str) -> DataFrame:
    dets = _lifted(spark, sf).withColumn("scene", F.expr("frame div 4"))
    return inst.cluster_light(dets, ["scene", "label"]).select("scene", "label", "seed", *_rt("score", "cx3", "cy3", "cz3", "sx", "sy", "sz"), "n")


def observation_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = inst.robust_bounds(carrier(spark, sf, "points"), ["obj_id"])
    return b.select("obj_id", *_r("lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z", "c_x", "c_y", "c_z", "diag"), "n_raw")


def label_vote(spark: SparkSession, sf: str) -> DataFrame:
    return inst.vote_labels(carrier(spark, sf, "observations"))


def ghost_filter(spark: SparkSession, sf: str) -> DataFrame:
    return inst.drop_ghosts(label_vote(spark, sf)).select("inst_id", "frames_seen", "score")


def _tracks(spark: SparkSession, sf: str, by: str = "frame") -> DataFrame:
    return carrier(spark, sf, "points").withColumn("inst_id", F.col("obj_id") * 4 + F.expr(by) % 4)


def _track_boxes(spark: SparkSession, sf: str, by: str = "frame") -> DataFrame:
    rows = _tracks(spark, sf, by).groupBy("scene", "inst_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    x1, y1 = (F.col("inst_id") * 37 + F.col("frame") * 11) % 200, (F.col("inst_id") * 13) % 100
    return rows.select("scene", "inst_id", (F.col("scene") * 100 + F.col("frame")).alias("frame"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 80).cast("double").alias("x2"), (y1 + 60).cast("double").alias("y2"))


def separated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return inst.separated_pairs(_track_boxes(spark, sf))


def _ranked_bounds(spark: SparkSession, sf: str) -> DataFrame:
    points = _tracks(spark, sf)
    seen = points.groupBy("inst_id").agg(F.countDistinct("frame").alias("frames_seen"))
    rows = inst.robust_bounds(points, ["scene", "inst_id"]).join(seen, "inst_id").withColumns({"score": (F.col("inst_id") % 50) / F.lit(50.0), "n_points": F.col("n_raw")})
    return inst.evidence_rank(rows, "scene")


def aabb_containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    boxes = shared_frame_max_iou(_track_boxes(spark, sf, "pid div 12"))
    return inst.shared_frame_duplicates(inst.robust_bounds(_tracks(spark, sf, "pid div 12"), ["inst_id"]), boxes, iou=0.2)


def split_track_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = inst.split_track_pairs(_ranked_bounds(spark, sf), separated_pairs(spark, sf), None, "scene")
    return found.select("scene", "earlier", "later", *_r("containment"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    tracks = _ranked_bounds(spark, sf).select("inst_id", "rank", F.expr("inst_id div 4").alias("obj"))
    a, b = tracks.alias("a"), tracks.alias("b")
    return a.join(b, (F.col("a.obj") == F.col("b.obj")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.inst_id").alias("earlier"), F.col("b.inst_id").alias("later"))


def _support(spark: SparkSession, sf: str) -> DataFrame:
    return inst.cloud_support(_tracks(spark, sf), _candidates(spark, sf), _ranked_bounds(spark, sf), ratio=0.15)


def nn_overlap_support(spark: SparkSession, sf: str) -> DataFrame:
    return _support(spark, sf).select("earlier", "later", *_r("support_max", "support_mean"))


def complete_link_groups(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked_bounds(spark, sf)
    accepts = inst.split_track_pairs(ranked, separated_pairs(spark, sf), None, "scene")
    return inst.merge_complete_link(ranked.drop("rank"), accepts, "scene")


def relaxed_track_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = inst.split_track_pairs(_ranked_bounds(spark, sf), separated_pairs(spark, sf), _support(spark, sf), "scene")
    return found.select("scene", "earlier", "later", *_r("containment"))


def _track_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _tracks(spark, sf).select("scene", "inst_id").distinct().withColumn("label", F.expr("CASE inst_id % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END"))


def _track_placements(spark: SparkSession, sf: str) -> DataFrame:
    placed = room.place_instances(_tracks(spark, sf), _track_labels(spark, sf).drop("scene"), ["inst_id"], 0.01, 0.02)
    evidence = _ranked_bounds(spark, sf).select("scene", "inst_id", "frames_seen", "score", "n_points", "rank")
    return placements.placement_boxes(placed.join(evidence, "inst_id"))


def placement_aabb(spark: SparkSession, sf: str) -> DataFrame:
    turned = carrier(spark, sf, "placed").withColumn("yaw", (F.col("inst_id") % 24) / F.lit(7.0))
    return placements.placement_boxes(turned).select("inst_id", *_r("lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z"))


def _placed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = placements.placed_candidates(_track_placements(spark, sf), separated_pairs(spark, sf), "scene")
    support = inst.cloud_support(_tracks(spark, sf), placements.needs_support(found), _ranked_bounds(spark, sf), ratio=0.15)
    return placements.placed_duplicates(found, support, "scene")


def placed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Placed tracks that are one object: the support of unclear pairs comes from the tracks' own points."""
    return _placed_duplicates(spark, sf).select("scene", "earlier", "later", *_r("containment"))


def _consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return placements.consolidate(_ranked_bounds(spark, sf).drop("rank"), _placed_duplicates(spark, sf), "scene")


def consolidate_placements(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidated(spark, sf)


def consolidated_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Votes over the observations of every consolidated group; a track's points of one frame are one observation."""
    tracks = _tracks(spark, sf).withColumn("label", F.expr("CASE pid % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END"))
    obs = tracks.groupBy("inst_id", "frame").agg(F.min_by("label", "pid").alias("label"), F.count(F.lit(1)).alias("n_raw"), F.min("pid").alias("obs_id"))
    obs = obs.withColumns({"score": (F.col("obs_id") % 64) / F.lit(64.0), "ord": F.col("obs_id")})
    return placements.revote(obs, _consolidated(spark, sf))


def cluster_observations(spark: SparkSession, sf: str) -> DataFrame:
    obs = carrier(spark, sf, "observations").select(
        "obs_id", "ord", "label", (F.expr("inst_id div 20")).alias("scene"), "frame", "score", (F.col("inst_id") % 20).cast("double").alias("cx3"),
        (F.col("ord") / 20.0).alias("cy3"), F.lit(0.0).alias("cz3"), F.lit(1.0).alias("diag"),
        (F.col("obs_id") % 300).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("obs_id") % 300 + 60).cast("double").alias("x2"), F.lit(50.0).alias("y2"),
    )
    return inst.cluster_observations(obs, ["scene", "label"])


def reprojection_agreement(spark: SparkSession, sf: str) -> DataFrame:
    px, cams = carrier(spark, sf, "pixels"), carrier(spark, sf, "cameras")
    lifted = proj.unproject_pixels(px, cams).withColumns({"inst_id": F.expr("frame div 4 * 5 + u div 5"), "obs_id": F.expr("frame * 5 + u div 5")})
    points = lifted.select("inst_id", "obs_id", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    obs = lifted.select("inst_id", "obs_id", "frame").distinct()
    mask = px.select(F.expr("frame * 5 + u div 5").alias("obs_id"), "u", "v")
    return proj.reprojection_agreement(points, obs, mask, px, cams, *GRID, least=3).select("inst_id", *_r("agreement"))


def _volume(spark: SparkSession, sf: str) -> DataFrame:
    cams = carrier(spark, sf, "cameras").withColumn("scene", F.expr("frame div 4"))
    lower, upper, dims, trunc, bar = VOLUME
    return proj.integrate_volume(carrier(spark, sf, "pixels"), cams, lower, upper, dims, trunc, bar, *GRID)


def tsdf_integrate(spark: SparkSession, sf: str) -> DataFrame:
    return _volume(spark, sf).select("scene", "ix", "iy", "iz", *_r("w", "tsdf", "r", "g", "b"))


def tsdf_zero_cross(spark: SparkSession, sf: str) -> DataFrame:
    return proj.zero_crossings(_volume(spark, sf)).select("scene", "ix", "iy", "iz", "axis", *_r("t"))


def support_image(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("obs_id")
    rows = carrier(spark, sf, "observations").select(
        "inst_id", "obs_id", "ord", (F.col("label") == "monitor").alias("label_match"), ((k * 7 % 101) / 100.0).alias("support"), ((k * 13 % 101) / 100.0).alias("centre"), F.col("score").alias("det_score"),
        (k % 900).cast("double").alias("sharpness"), (k % 2).cast("double").alias("mask"), (k % 400 - 20).cast("double").alias("x1"), (k % 300 - 10).cast("double").alias("y1"),
        (k % 400 + 60).cast("double").alias("x2"), (k % 300 + 90).cast("double").alias("y2"),
    )
    return inst.support_image(rows, IMAGE)


def mesh_quality(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("inst_id")
    rows = carrier(spark, sf, "placed").select(k.alias("mesh_id"), ((k * 7 % 101) / 100.0).alias("support"), ((k * 13 % 101) / 100.0).alias("bbox"), ((50 + k % 51) / 100.0).alias("component"), "n_points", "frames_seen", (k * 3 % 500).alias("faces"))
    return inst.scan_mesh_quality(rows)


def smooth_depth(spark: SparkSession, sf: str) -> DataFrame:
    return proj.smooth_depth(carrier(spark, sf, "pixels"), color=0.3).select("frame", "u", "v", *_r("depth"))


def point_cloud_export(spark: SparkSession, sf: str) -> DataFrame:
    lifted = proj.unproject_pixels(carrier(spark, sf, "pixels"), carrier(spark, sf, "cameras"))
    shown = proj.point_cloud(lifted.withColumn("scene", F.expr("frame div 4")), ["scene"], 30, drop_black=True, drop_white=True)
    return shown.select("frame", "u", "v", *_r("wx", "wy", "wz"))


#: A camera turned by the 3-4-5 triangle about +Y, as the first of a scene.
FIRST_CAMERA = (np.array([[0.8, 0.0, 0.6], [0.0, 1.0, 0.0], [-0.6, 0.0, 0.8]]), np.array([0.5, 0.25, 2.0]))
TO_SCENE = proj.scene_transform(*FIRST_CAMERA)


def scene_points(spark: SparkSession, sf: str) -> DataFrame:
    return proj.apply_transform(carrier(spark, sf, "points").select("pid", "x", "y", "z"), TO_SCENE).select("pid", *_r("x", "y", "z"))


def mask_points_local(spark: SparkSession, sf: str) -> DataFrame:
    masks = carrier(spark, sf, "mask_cells").select(F.col("mask_id").alias("det_id"), (F.col("mask_id") % 4).alias("frame"), F.col("ix").alias("u"), F.col("iy").alias("v"))
    return proj.mask_points_local(masks, carrier(spark, sf, "pixels"), carrier(spark, sf, "cameras"), TO_SCENE, most=7).select("det_id", "u", "v", *_r("x", "y", "z"))


def mesh_support(spark: SparkSession, sf: str) -> DataFrame:
    """The points of even frames against those of odd frames as samples of the surface."""
    pts = carrier(spark, sf, "points").withColumn("mesh_id", F.col("obj_id"))
    sizes = inst.robust_bounds(pts, ["mesh_id"]).select("mesh_id", "diag")
    return inst.mesh_support(pts.filter("frame % 2 = 0").select("mesh_id", "pid", "x", "y", "z"), pts.filter("frame % 2 = 1").select("mesh_id", "x", "y", "z"), sizes).select("mesh_id", *_r("support"))


def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    return status_text(carrier(spark, sf, "detections"), ["frame"])


def padded_crops(spark: SparkSession, sf: str) -> DataFrame:
    return proj.padded_crops(carrier(spark, sf, "detections"), *IMAGE).select("det_id", "cx1", "cy1", "cx2", "cy2")


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return hashed(carrier(spark, sf, "points"), ["obj_id"], "pid", 40, seed=3).select("obj_id", "pid")


_TO_WORLD = "round(r00 * ({x} - t0) + r10 * ({y} - t1) + r20 * ({z} - t2), 6) AS wx, round(r01 * ({x} - t0) + r11 * ({y} - t1) + r21 * ({z} - t2), 6) AS wy, round(r02 * ({x} - t0) + r12 * ({y} - t1) + r22 * ({z} - t2), 6) AS wz"
_TO_WORLD_RAW = _TO_WORLD.replace("round(", "(").replace(", 6)", ")")
_LIFT = {"x": "(u - cx) / fx * depth", "y": "(v - cy) / fy * depth", "z": "depth"}
_CAM = "r00 * x + r01 * y + r02 * z + t0 AS a, r10 * x + r11 * y + r12 * z + t1 AS b, r20 * x + r21 * y + r22 * z + t2 AS c"
_PROJECTED = f"""cam AS (SELECT pid, p.frame, fx, fy, cx, cy, {_CAM} FROM points p JOIN cameras k ON p.frame = k.frame),
pr AS (SELECT pid, frame, fx * a / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cx AS pu, fy * b / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cy AS pv, c AS pz FROM cam)"""


def _gate(excluded: str, percent: float, keep: str) -> str:
    bar = f"quantile_cont(CASE WHEN k > 1e-5 THEN k END, {percent})" if percent else "0"
    return duck("pixels", f"""g AS (SELECT frame, u, v, frame // 4 AS scene, CASE WHEN (u * 3 + v) % 11 = 0 OR {excluded} THEN 0 ELSE conf END AS k FROM pixels),
b AS (SELECT scene, CAST(coalesce({bar}, 0) AS DOUBLE) AS bar FROM g GROUP BY scene)
SELECT frame, u, v, round(CAST(k AS DOUBLE), 6) AS conf_used, round(bar, 6) AS bar FROM g JOIN b USING (scene) WHERE {keep}""")


_BOXED = f"""bx AS (SELECT det_id, frame, label, score, CAST(floor(least(greatest(x1 * (25 / 480.0::DOUBLE), 0), 24)) AS BIGINT) AS a1, CAST(floor(least(greatest(y1 * (20 / 360.0::DOUBLE), 0), 19)) AS BIGINT) AS b1,
  CAST(floor(least(greatest(x2 * (25 / 480.0::DOUBLE), 1), 25)) AS BIGINT) AS a2, CAST(floor(least(greatest(y2 * (20 / 360.0::DOUBLE), 1), 20)) AS BIGINT) AS b2 FROM detections),
hit AS (SELECT bx.det_id, bx.frame, label, score, u, v, depth FROM bx JOIN pixels p ON bx.frame = p.frame WHERE u >= a1 AND u < a2 AND v >= b1 AND v < b2 AND depth > 1e-4),
q AS (SELECT det_id, count(*) AS n, quantile_cont(depth, 0.1) AS lo, quantile_cont(depth, 0.9) AS hi FROM hit GROUP BY det_id HAVING count(*) >= 4),
m AS (SELECT hit.*, n, depth >= lo AND depth <= hi AS core, count(*) FILTER (WHERE depth >= lo AND depth <= hi) OVER (PARTITION BY hit.det_id) AS n_core FROM hit JOIN q USING (det_id)),
w AS (SELECT det_id, m.frame, label, score, {_TO_WORLD_RAW.format(**_LIFT)} FROM m JOIN cameras c ON m.frame = c.frame WHERE n < 10 OR n_core < 4 OR core),
d3 AS (SELECT det_id, frame, label, score, avg(wx) AS cx3, avg(wy) AS cy3, avg(wz) AS cz3, greatest(max(wx) - min(wx), 0.05) AS sx, greatest(max(wy) - min(wy), 0.05) AS sy, greatest(max(wz) - min(wz), 0.05) AS sz FROM w GROUP BY det_id, frame, label, score)"""
_ROUND3 = ", ".join(f"round({c} + {TIE}::DOUBLE, 6) AS {c}" for c in ("score", "cx3", "cy3", "cz3", "sx", "sy", "sz"))


def fit_sql(ranked: str, accepts: str, group: str, item: str, seed_only: bool) -> str:
    """CTEs up to ``placed_`` (group columns, item, seed, cluster): the first-fit fold as recursion over rank."""
    g = [x.strip() for x in group.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in g)
    cols = ", ".join(f"r.{x}" for x in g)
    test = "list_contains(r.xs, g[1])" if seed_only else "list_has_all(r.xs, g)"
    return f"""ok AS (SELECT {group}, later AS {item}, list(earlier) AS xs FROM {accepts} GROUP BY ALL),
r AS (SELECT {', '.join(f'k.{x}' for x in g)}, k.{item}, k.rank, coalesce(ok.xs, []) AS xs FROM {ranked} k LEFT JOIN ok ON {same('k', 'ok')} AND k.{item} = ok.{item}),
fold AS (SELECT {group}, rank, [[{item}]] AS acc FROM r WHERE rank = 0 UNION ALL
  SELECT {cols}, r.rank, CASE WHEN coalesce(list_position(list_transform(fold.acc, lambda g: {test}), true), 0) > 0
    THEN list_transform(fold.acc, lambda g, i: CASE WHEN i = list_position(list_transform(fold.acc, lambda g: {test}), true) THEN list_append(g, r.{item}) ELSE g END)
    ELSE list_append(fold.acc, [r.{item}]) END FROM fold JOIN r ON {same('fold', 'r')} AND r.rank = fold.rank + 1),
top AS (SELECT {group}, arg_max(acc, rank) AS acc FROM fold GROUP BY {group}),
lists AS (SELECT {group}, unnest(acc) AS xs, generate_subscripts(acc, 1) - 1 AS cluster FROM top),
placed_ AS (SELECT {group}, unnest(xs) AS {item}, xs[1] AS seed, CAST(cluster AS BIGINT) AS cluster FROM lists)"""


_TRACKS = """tr AS (SELECT *, obj_id * 4 + frame % 4 AS inst_id FROM points),
tb AS (SELECT scene, inst_id, scene * 100 + frame AS frame, CAST((inst_id * 37 + frame * 11) % 200 AS DOUBLE) AS x1, CAST((inst_id * 13) % 100 AS DOUBLE) AS y1,
  CAST((inst_id * 37 + frame * 11) % 200 + 80 AS DOUBLE) AS x2, CAST((inst_id * 13) % 100 + 60 AS DOUBLE) AS y2 FROM (SELECT DISTINCT scene, inst_id, frame FROM tr)),
sep AS (SELECT DISTINCT a.inst_id AS a, b.inst_id AS b FROM tb a JOIN tb b ON a.frame = b.frame AND a.inst_id < b.inst_id WHERE """ + IOU + """ <= 0.15),
bd AS (SELECT scene, inst_id, quantile_cont(x, 0.05) AS lx, quantile_cont(x, 0.95) AS hx, quantile_cont(y, 0.05) AS ly, quantile_cont(y, 0.95) AS hy, quantile_cont(z, 0.05) AS lz, quantile_cont(z, 0.95) AS hz, count(*) AS n, count(DISTINCT frame) AS fr FROM tr GROUP BY ALL),
rk AS (SELECT *, sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2) AS diag, greatest(hx - lx, 1e-6) AS ex, greatest(hy - ly, 1e-6) AS ey, greatest(hz - lz, 1e-6) AS ez,
  row_number() OVER (PARTITION BY scene ORDER BY fr DESC, (inst_id % 50) / 50.0 DESC, n DESC, inst_id) - 1 AS rank FROM bd)"""
_INTER = "greatest(least(p.hx, q.hx) - greatest(p.lx, q.lx), 0) * greatest(least(p.hy, q.hy) - greatest(p.ly, q.ly), 0) * greatest(least(p.hz, q.hz) - greatest(p.lz, q.lz), 0)"
_CONT = f"{_INTER} / greatest(least(p.ex * p.ey * p.ez, q.ex * q.ey * q.ez), 1e-9)"
_ALL_IN = lambda lo, hi: " AND ".join(f"p.e{c} / q.e{c} BETWEEN {lo} AND {hi}" for c in "xyz")
_PAIR = f"""pr AS (SELECT p.scene, p.inst_id AS earlier, q.inst_id AS later, {_CONT} AS containment, ({_ALL_IN(0.5, 2.0)}) AS std
  FROM rk p JOIN rk q ON p.scene = q.scene AND p.rank < q.rank
  WHERE {_ALL_IN(0.38, 2.6)} AND sqrt(((p.lx + p.hx) / 2 - (q.lx + q.hx) / 2) ** 2 + ((p.ly + p.hy) / 2 - (q.ly + q.hy) / 2) ** 2 + ((p.lz + p.hz) / 2 - (q.lz + q.hz) / 2) ** 2)
    / greatest(sqrt(p.ex ** 2 + p.ey ** 2 + p.ez ** 2), sqrt(q.ex ** 2 + q.ey ** 2 + q.ez ** 2), 1e-6) <= 0.24),
st AS (SELECT pr.* FROM pr WHERE containment >= 0.48 AND NOT EXISTS (SELECT 1 FROM sep WHERE sep.a = least(earlier, later) AND sep.b = greatest(earlier, later)))"""
_SUPPORT = """cd AS (SELECT p.inst_id AS earlier, q.inst_id AS later, greatest(0.15 * least(p.diag, q.diag), 1e-6) AS tol FROM rk p JOIN rk q ON p.scene = q.scene AND p.inst_id // 4 = q.inst_id // 4 AND p.rank < q.rank WHERE p.n >= 10 AND q.n >= 10),
ds AS (SELECT earlier, later, a.pid AS pa, b.pid AS pb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= tol AS near FROM cd JOIN tr a ON a.inst_id = earlier JOIN tr b ON b.inst_id = later),
s1 AS (SELECT earlier, later, avg(CAST(k AS DOUBLE)) AS sa FROM (SELECT earlier, later, pa, CAST(bool_or(near) AS INT) AS k FROM ds GROUP BY ALL) GROUP BY earlier, later),
s2 AS (SELECT earlier, later, avg(CAST(k AS DOUBLE)) AS sb FROM (SELECT earlier, later, pb, CAST(bool_or(near) AS INT) AS k FROM ds GROUP BY ALL) GROUP BY earlier, later),
su AS (SELECT earlier, later, greatest(sa, sb) AS support_max, sqrt(sa * sb) AS support_mean FROM s1 JOIN s2 USING (earlier, later))"""
#: Placements of the tracks as boxes, in evidence order, and the pairs of them that may be one object.
_PLACED_TRACKS = """cv AS (SELECT inst_id, var_samp(x) AS a, covar_samp(x, z) AS b, var_samp(z) AS c FROM tr GROUP BY inst_id),
yw AS (SELECT inst_id, CASE WHEN th >= pi() / 2 THEN th - pi() ELSE th END AS yaw, sqrt((m + r) / greatest(m - r, 1e-9)) AS ratio FROM (SELECT inst_id, atan2(2 * b, a - c) / 2 AS th, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM cv)),
sn AS (SELECT inst_id, CASE WHEN abs(q - round_even(q / (pi() / 2), 0) * (pi() / 2)) <= radians(15) THEN round_even(q / (pi() / 2), 0) * (pi() / 2) ELSE q END AS yaw FROM (SELECT inst_id, CASE WHEN ratio >= 1.2 THEN yaw ELSE 0 END AS q FROM yw)),
tu AS (SELECT tr.inst_id, yaw, cos(-yaw) AS c, sin(-yaw) AS s, cos(-yaw) * x - sin(-yaw) * z AS xr, sin(-yaw) * x + cos(-yaw) * z AS zr, y FROM tr JOIN sn ON tr.inst_id = sn.inst_id),
qq AS (SELECT inst_id, yaw, any_value(c) AS c, any_value(s) AS s, quantile_cont(xr, 0.02) AS xl, quantile_cont(xr, 0.98) AS xh, quantile_cont(zr, 0.02) AS zl, quantile_cont(zr, 0.98) AS zh, quantile_cont(y, 0.02) AS yl, quantile_cont(y, 0.98) AS yh FROM tu GROUP BY inst_id, yaw),
ba AS (SELECT *, CASE WHEN yl - 0.01 < 0.02 * CASE WHEN inst_id % 3 = 0 THEN 3.5 ELSE 1 END THEN 0.01 ELSE yl END AS base FROM qq),
sz AS (SELECT inst_id, c * (xl + xh) / 2 + s * (zl + zh) / 2 AS px, base AS py, -s * (xl + xh) / 2 + c * (zl + zh) / 2 AS pz, yaw, greatest(xh - xl, 0.02) AS w, greatest(yh - base, 0.02) AS h, greatest(zh - zl, 0.02) AS d FROM ba),
pb AS (SELECT rk.scene, rk.rank, sz.*, px - (w / 2 * abs(cos(yaw)) + d / 2 * abs(sin(yaw))) AS lx, px + (w / 2 * abs(cos(yaw)) + d / 2 * abs(sin(yaw))) AS hx, py AS ly, py + h AS hy,
  pz - (w / 2 * abs(sin(yaw)) + d / 2 * abs(cos(yaw))) AS lz, pz + (w / 2 * abs(sin(yaw)) + d / 2 * abs(cos(yaw))) AS hz FROM sz JOIN rk ON rk.inst_id = sz.inst_id),
px AS (SELECT *, hx - lx AS ex, hy - ly AS ey, hz - lz AS ez FROM pb),
pq AS (SELECT p.scene, p.inst_id AS earlier, q.inst_id AS later, """ + _CONT + """ AS containment, least(p.w, p.d) / least(q.w, q.d) AS r1, greatest(p.w, p.d) / greatest(q.w, q.d) AS r2, p.h / q.h AS r3,
  sqrt(((p.lx + p.hx) / 2 - (q.lx + q.hx) / 2) ** 2 + ((p.ly + p.hy) / 2 - (q.ly + q.hy) / 2) ** 2 + ((p.lz + p.hz) / 2 - (q.lz + q.hz) / 2) ** 2) / greatest(sqrt(p.ex ** 2 + p.ey ** 2 + p.ez ** 2), sqrt(q.ex ** 2 + q.ey ** 2 + q.ez ** 2), 1e-6) AS far
  FROM px p JOIN px q ON p.scene = q.scene AND p.rank < q.rank),
pc AS (SELECT scene, earlier, later, containment, r1 BETWEEN 0.5 AND 2 AND r2 BETWEEN 0.5 AND 2 AND r3 BETWEEN 0.5 AND 2 AS std FROM pq
  WHERE r1 BETWEEN 0.38 AND 2.6 AND r2 BETWEEN 0.38 AND 2.6 AND r3 BETWEEN 0.38 AND 2.6 AND containment >= 0.52 AND far <= 0.25 AND NOT EXISTS (SELECT 1 FROM sep WHERE sep.a = least(earlier, later) AND sep.b = greatest(earlier, later))),
cd AS (SELECT earlier, later, greatest(0.15 * least(p.diag, q.diag), 1e-6) AS tol FROM pc JOIN rk p ON p.inst_id = earlier JOIN rk q ON q.inst_id = later WHERE p.n >= 10 AND q.n >= 10 AND (NOT std OR containment < 0.72)),
""" + _SUPPORT[_SUPPORT.index("ds AS") :] + """,
pd AS (SELECT scene, pc.earlier, pc.later, containment FROM pc LEFT JOIN su ON su.earlier = pc.earlier AND su.later = pc.later
  WHERE (std OR (coalesce(support_max, 0) >= 0.68 AND coalesce(support_mean, 0) >= 0.28)) AND (containment >= 0.72 OR (coalesce(support_max, 0) >= 0.48 AND coalesce(support_mean, 0) >= 0.20)))"""
_TSDF = """vx AS (SELECT scene, ix, iy, iz, -2.0::DOUBLE + ix * (4.0::DOUBLE / 16) AS x, -1.0::DOUBLE + iy * (2.0::DOUBLE / 8) AS y, iz * (3.0::DOUBLE / 12) AS z
  FROM (SELECT DISTINCT frame // 4 AS scene FROM cameras), range(0, 17) a(ix), range(0, 9) b(iy), range(0, 13) c(iz)),
cv AS (SELECT vx.*, frame, fx, fy, cx, cy, """ + _CAM + """ FROM vx JOIN cameras k ON vx.scene = k.frame // 4),
uv AS (SELECT *, round_even(fx * a / CASE WHEN c > 0 THEN c ELSE 1 END + cx, 0) AS u, round_even(fy * b / CASE WHEN c > 0 THEN c ELSE 1 END + cy, 0) AS v FROM cv),
ok AS (SELECT uv.*, p.depth - c AS sdf, conf, p.r AS pr, p.g AS pg, p.b AS pb FROM uv JOIN pixels p ON p.frame = uv.frame AND p.u = uv.u AND p.v = uv.v WHERE c > 0 AND p.depth > 0 AND p.depth - c > -0.75 AND conf >= 2.0),
su AS (SELECT scene, ix, iy, iz, sum(conf) AS w, sum(conf * least(greatest(sdf, -0.75), 0.75)) AS ws, sum(conf * pr) AS wr, sum(conf * pg) AS wg, sum(conf * pb) AS wb FROM ok GROUP BY ALL),
vol AS (SELECT vx.scene, vx.ix, vx.iy, vx.iz, coalesce(w, 0) AS w, CASE WHEN w > 0 THEN (ws + 0.75) / w ELSE 0.75 END AS tsdf, CASE WHEN w > 0 THEN wr / 255 / w ELSE 0.5 END AS r, CASE WHEN w > 0 THEN wg / 255 / w ELSE 0.5 END AS g, CASE WHEN w > 0 THEN wb / 255 / w ELSE 0.5 END AS b
  FROM vx LEFT JOIN su USING (scene, ix, iy, iz))"""

QUERIES = {f.__name__: f for f in (
    unproject_points, project_points, visible_points, best_view_color, conf_gate, masked_gate, open_gate, depth_edges, detections_to_3d, cluster_3d_light,
    placement_aabb, placed_duplicates, consolidate_placements, consolidated_instances, observation_bounds, label_vote, ghost_filter, separated_pairs, aabb_containment_pairs, split_track_pairs, nn_overlap_support, complete_link_groups, relaxed_track_pairs,
    cluster_observations, reprojection_agreement, tsdf_integrate, tsdf_zero_cross, support_image, mesh_quality,
    smooth_depth, point_cloud_export, padded_crops, hash_sample, scene_points, mask_points_local, mesh_support, status_lines,
)}
_VOTE = """v AS (SELECT inst_id, label, count(DISTINCT frame) AS fr, round(sum(score), 9) AS tot, max(score) AS top, sum(n_raw) AS pts, min(ord) AS first FROM observations GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY fr DESC, tot DESC, top DESC, pts DESC, first) = 1),
bo AS (SELECT o.inst_id, obs_id FROM observations o JOIN w ON o.inst_id = w.inst_id AND o.label = w.label QUALIFY row_number() OVER (PARTITION BY o.inst_id ORDER BY n_raw DESC, ord) = 1),
al AS (SELECT inst_id, count(DISTINCT frame) AS frames_seen, count(*) AS n_obs FROM observations GROUP BY inst_id),
vote AS (SELECT w.inst_id, label, top AS score, frames_seen, obs_id AS best_obs, n_obs FROM w JOIN bo USING (inst_id) JOIN al USING (inst_id))"""
_TO_SCENE = lambda x, y, z: ", ".join(f"round({TO_SCENE[k, 0]!r}::DOUBLE * {x} + {TO_SCENE[k, 1]!r}::DOUBLE * {y} + {TO_SCENE[k, 2]!r}::DOUBLE * {z} + {TO_SCENE[k, 3]!r}::DOUBLE, 6) AS {'xyz'[k]}" for k in range(3)).replace("np.float64(", "(")
ORACLES = {
    "scene_points": duck("points", f"SELECT pid, {_TO_SCENE('x', 'y', 'z')} FROM points"),
    "mask_points_local": duck("mask_cells pixels cameras", f"""m AS (SELECT mask_id, ix, iy, row_number() OVER (PARTITION BY mask_id ORDER BY iy, ix) - 1 AS i, count(*) OVER (PARTITION BY mask_id) AS n FROM mask_cells),
k AS (SELECT * FROM m WHERE n <= 7 OR i IN (SELECT j * (m.n - 1) // 6 FROM range(0, 7) t(j))),
w AS (SELECT mask_id AS det_id, u, v, {_TO_WORLD_RAW.format(**_LIFT)} FROM k JOIN pixels p ON p.frame = mask_id % 4 AND p.u = ix AND p.v = iy JOIN cameras c ON c.frame = p.frame)
SELECT det_id, u, v, {_TO_SCENE('wx', 'wy', 'wz')} FROM w"""),
    "mesh_support": duck("points", """q AS (SELECT obj_id, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS ex, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS ey, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS ez FROM points GROUP BY obj_id),
t AS (SELECT obj_id, greatest(0.025, 0.06::DOUBLE * sqrt(ex ** 2 + ey ** 2 + ez ** 2)) AS tol FROM q),
h AS (SELECT a.obj_id, a.pid, EXISTS (SELECT 1 FROM points b WHERE b.obj_id = a.obj_id AND b.frame % 2 = 1 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= t.tol) AS hit FROM points a JOIN t ON t.obj_id = a.obj_id WHERE a.frame % 2 = 0)
SELECT obj_id AS mesh_id, round(count(*) FILTER (WHERE hit) / count(*), 6) AS support FROM h GROUP BY obj_id"""),
    "status_lines": duck("detections", """p AS (SELECT frame, label, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_id) AS place FROM detections)
SELECT frame, place, '**' || place || '. ' || upper(label) || '** (' || CAST(round_even(score * 100, 0) AS BIGINT) || '%)' AS line FROM p"""),
    "unproject_points": duck("pixels cameras", f"SELECT p.frame, u, v, {_TO_WORLD.format(**_LIFT)} FROM pixels p JOIN cameras c ON p.frame = c.frame"),
    "project_points": duck("points cameras", f"{_PROJECTED} SELECT pid, frame, round(pu, 6) AS pu, round(pv, 6) AS pv, round(pz, 6) AS pz FROM pr"),
    "visible_points": duck("points cameras pixels", f"""{_PROJECTED},
h AS (SELECT *, CAST(round_even(pu, 0) AS BIGINT) AS u, CAST(round_even(pv, 0) AS BIGINT) AS v FROM pr WHERE pz > 1e-6 AND pu BETWEEN 0 AND 24 AND pv BETWEEN 0 AND 19)
SELECT pid, h.frame, h.u, h.v, round(pz, 6) AS pz, round(depth, 6) AS seen FROM h JOIN pixels p ON p.frame = h.frame AND p.u = h.u AND p.v = h.v WHERE depth > 1e-6 AND pz <= depth * 1.08 + 0.03"""),
    "best_view_color": duck("points cameras pixels", f"""cam AS (SELECT pid, k.frame, fx, fy, cx, cy, {_CAM} FROM points p JOIN cameras k ON p.obj_id % 8 = k.frame // 4 % 8),
pr AS (SELECT pid, frame, fx * a / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cx AS pu, fy * b / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cy AS pv, c AS pz FROM cam),
h AS (SELECT *, round_even(pu, 0) AS u, round_even(pv, 0) AS v FROM pr WHERE pz > 1e-6 AND pu BETWEEN 0 AND 24 AND pv BETWEEN 0 AND 19)
SELECT pid, h.frame, r, g, b FROM h JOIN pixels p ON p.frame = h.frame AND p.u = h.u AND p.v = h.v WHERE depth > 1e-6 AND pz <= depth * 1.08 + 0.03 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pz, h.frame) = 1"""),
    "conf_gate": _gate("false", 0.2, "k >= bar AND k > 1e-5"),
    "masked_gate": _gate("(u + frame) % 4 = 0", 0.2, "k >= bar AND k > 1e-5"),
    "open_gate": _gate("(u + frame) % 4 = 0", 0, "k >= bar"),
    "depth_edges": duck("pixels", """SELECT frame, u, v, greatest(coalesce(abs(lag(depth) OVER r - depth), 0), coalesce(abs(lead(depth) OVER r - depth), 0), coalesce(abs(lag(depth) OVER c - depth), 0), coalesce(abs(lead(depth) OVER c - depth), 0)) > 0.8 * depth AS edge
FROM pixels WINDOW r AS (PARTITION BY frame, v ORDER BY u), c AS (PARTITION BY frame, u ORDER BY v)"""),
    "detections_to_3d": duck("detections pixels cameras", f"{_BOXED} SELECT det_id, frame, label, {_ROUND3} FROM d3"),
    "cluster_3d_light": duck("detections pixels cameras", f"""{_BOXED},
ranked AS (SELECT *, frame // 4 AS scene, row_number() OVER (PARTITION BY frame // 4, label ORDER BY det_id) - 1 AS rank FROM d3),
ac AS (SELECT p.scene, p.label, p.det_id AS earlier, q.det_id AS later FROM ranked p JOIN ranked q ON p.scene = q.scene AND p.label = q.label AND p.rank < q.rank WHERE sqrt((p.cx3 - q.cx3) ** 2 + (p.cy3 - q.cy3) ** 2 + (p.cz3 - q.cz3) ** 2) < 0.5),
{fit_sql('ranked', 'ac', 'scene, label', 'det_id', True)}
SELECT d.scene, d.label, seed, round(max(score) + {TIE}::DOUBLE, 6) AS score, round(avg(cx3) + {TIE}::DOUBLE, 6) AS cx3, round(avg(cy3) + {TIE}::DOUBLE, 6) AS cy3, round(avg(cz3) + {TIE}::DOUBLE, 6) AS cz3, round(max(sx) + {TIE}::DOUBLE, 6) AS sx, round(max(sy) + {TIE}::DOUBLE, 6) AS sy, round(max(sz) + {TIE}::DOUBLE, 6) AS sz, count(*) AS n
FROM placed_ JOIN ranked d ON d.scene = placed_.scene AND d.label = placed_.label AND d.det_id = placed_.det_id GROUP BY d.scene, d.label, seed"""),
    "observation_bounds": duck("points", """b AS (SELECT obj_id, quantile_cont(x, 0.05) AS lx, quantile_cont(x, 0.95) AS hx, quantile_cont(y, 0.05) AS ly, quantile_cont(y, 0.95) AS hy, quantile_cont(z, 0.05) AS lz, quantile_cont(z, 0.95) AS hz, count(*) AS n FROM points GROUP BY obj_id)
SELECT obj_id, round(lx, 6) AS lo_x, round(ly, 6) AS lo_y, round(lz, 6) AS lo_z, round(hx, 6) AS hi_x, round(hy, 6) AS hi_y, round(hz, 6) AS hi_z, round((lx + hx) / 2, 6) AS c_x, round((ly + hy) / 2, 6) AS c_y, round((lz + hz) / 2, 6) AS c_z,
  round(sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2), 6) AS diag, n AS n_raw FROM b"""),
    "label_vote": duck("observations", f"{_VOTE} SELECT * FROM vote"),
    "ghost_filter": duck("observations", f"{_VOTE} SELECT inst_id, frames_seen, score FROM vote WHERE frames_seen >= 2 OR score >= 0.45"),
    "placement_aabb": duck("placed", """y AS (SELECT *, (inst_id % 24) / 7.0::DOUBLE AS yaw FROM placed), e AS (SELECT *, w / 2 * abs(cos(yaw)) + d / 2 * abs(sin(yaw)) AS hx, w / 2 * abs(sin(yaw)) + d / 2 * abs(cos(yaw)) AS hz FROM y)
SELECT inst_id, round(px - hx, 6) AS lo_x, round(py, 6) AS lo_y, round(pz - hz, 6) AS lo_z, round(px + hx, 6) AS hi_x, round(py + h, 6) AS hi_y, round(pz + hz, 6) AS hi_z FROM e"""),
    "placed_duplicates": duck("points", f"{_TRACKS}, {_PLACED_TRACKS} SELECT scene, earlier, later, round(containment, 6) AS containment FROM pd"),
    "consolidate_placements": duck("points", f"{_TRACKS}, {_PLACED_TRACKS}, {fit_sql('rk', 'pd', 'scene', 'inst_id', False)} SELECT scene, inst_id, seed, cluster FROM placed_"),
    "consolidated_instances": duck("points", f"""{_TRACKS}, {_PLACED_TRACKS}, {fit_sql('rk', 'pd', 'scene', 'inst_id', False)},
ob AS (SELECT inst_id, frame, arg_min(CASE pid % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END, pid) AS label, count(*) AS n_raw, min(pid) AS obs_id FROM tr GROUP BY inst_id, frame),
observations AS (SELECT g.seed AS inst_id, frame, label, n_raw, obs_id, obs_id AS ord, (obs_id % 64) / 64.0::DOUBLE AS score FROM ob JOIN placed_ g ON g.inst_id = ob.inst_id), {_VOTE} SELECT * FROM vote"""),
    "separated_pairs": duck("points", f"{_TRACKS} SELECT a, b FROM sep"),
    "aabb_containment_pairs": duck("points", f"""{_TRACKS.replace('obj_id * 4 + frame % 4', 'obj_id * 4 + pid // 12 % 4')},
mi AS (SELECT a.inst_id AS inst_a, b.inst_id AS inst_b FROM tb a JOIN tb b ON a.frame = b.frame AND a.inst_id < b.inst_id GROUP BY ALL HAVING max({IOU}) >= 0.2)
SELECT inst_a, inst_b FROM mi JOIN rk p ON p.inst_id = inst_a JOIN rk q ON q.inst_id = inst_b WHERE {_CONT} >= 0.45"""),
    "split_track_pairs": duck("points", f"{_TRACKS}, {_PAIR} SELECT scene, earlier, later, round(containment, 6) AS containment FROM st WHERE std AND containment >= 0.68"),
    "nn_overlap_support": duck("points", f"{_TRACKS}, {_SUPPORT} SELECT earlier, later, round(support_max, 6) AS support_max, round(support_mean, 6) AS support_mean FROM su"),
    "complete_link_groups": duck("points", f"{_TRACKS}, {_PAIR}, ac AS (SELECT scene, earlier, later FROM st WHERE std AND containment >= 0.68), {fit_sql('rk', 'ac', 'scene', 'inst_id', False)} SELECT scene, inst_id, seed, cluster FROM placed_"),
    "relaxed_track_pairs": duck("points", f"""{_TRACKS}, {_PAIR}, {_SUPPORT} SELECT scene, st.earlier, st.later, round(containment, 6) AS containment FROM st LEFT JOIN su ON su.earlier = st.earlier AND su.later = st.later
WHERE (std OR (coalesce(support_max, 0) >= 0.68 AND coalesce(support_mean, 0) >= 0.28)) AND (containment >= 0.68 OR (coalesce(support_max, 0) >= 0.48 AND coalesce(support_mean, 0) >= 0.20))"""),
    "reprojection_agreement": duck("pixels cameras", f"""l AS (SELECT p.frame AS ff, p.frame // 4 * 5 + u // 5 AS inst_id, p.frame * 5 + u // 5 AS obs_id, {_TO_WORLD_RAW.format(**_LIFT).replace('AS wx', 'AS x').replace('AS wy', 'AS y').replace('AS wz', 'AS z')} FROM pixels p JOIN cameras c ON p.frame = c.frame),
o AS (SELECT DISTINCT inst_id, obs_id AS target, ff AS frame FROM l),
cam AS (SELECT l.inst_id, obs_id, target, k.frame, fx, fy, cx, cy, {_CAM} FROM l JOIN o ON l.inst_id = o.inst_id AND l.ff <> o.frame JOIN cameras k ON k.frame = o.frame),
pr AS (SELECT inst_id, obs_id, target, frame, fx * a / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cx AS pu, fy * b / CASE WHEN abs(c) <= 1e-9 THEN 1e-9 ELSE c END + cy AS pv, c AS pz FROM cam),
h AS (SELECT *, CAST(round_even(pu, 0) AS BIGINT) AS u, CAST(round_even(pv, 0) AS BIGINT) AS v FROM pr WHERE pz > 1e-6 AND pu BETWEEN 0 AND 24 AND pv BETWEEN 0 AND 19),
s AS (SELECT inst_id, obs_id, target, count(*) AS n, avg(CAST(h.frame * 5 + h.u // 5 = target AND depth > 1e-6 AND abs(pz - depth) <= 0.12 * depth + 0.08 AS INT)) AS share FROM h JOIN pixels p ON p.frame = h.frame AND p.u = h.u AND p.v = h.v GROUP BY ALL HAVING count(*) >= 3)
SELECT inst_id, round(median(share), 6) AS agreement FROM s GROUP BY inst_id"""),
    "smooth_depth": duck("pixels", """sp AS (SELECT frame, greatest(max(depth) - min(depth), 1e-9) AS span FROM pixels GROUP BY frame),
ds AS (SELECT di, dj FROM range(-4, 5) p(di), range(-4, 5) q(dj) WHERE di * di + dj * dj <= 16),
w AS (SELECT p.frame, p.u, p.v, o.depth AS other, exp(-(di * di + dj * dj) / 162.0::DOUBLE - ((o.depth - p.depth) / span / 0.3::DOUBLE) ** 2 / 2) AS w FROM pixels p JOIN sp ON sp.frame = p.frame, ds JOIN pixels o ON o.frame = p.frame AND o.u = p.u - di AND o.v = p.v - dj)
SELECT frame, u, v, round(sum(w * other) / sum(w), 6) AS depth FROM w GROUP BY frame, u, v"""),
    "point_cloud_export": duck("pixels cameras", f"""bs AS (SELECT frame // 4 AS scene, quantile_cont(conf, 0.3) AS bar FROM pixels GROUP BY ALL)
SELECT p.frame, u, v, {_TO_WORLD.format(**_LIFT)} FROM pixels p JOIN cameras c ON p.frame = c.frame JOIN bs ON bs.scene = p.frame // 4 WHERE conf >= bar AND conf > 1e-5 AND r + g + b >= 16 AND NOT (r > 240 AND g > 240 AND b > 240)"""),
    "padded_crops": duck("detections", """c AS (SELECT det_id, CAST(least(greatest(floor(x1 - 0.12::DOUBLE * (x2 - x1)), 0), 480) AS BIGINT) AS cx1, CAST(least(greatest(floor(y1 - 0.12::DOUBLE * (y2 - y1)), 0), 360) AS BIGINT) AS cy1,
  CAST(least(greatest(floor(x2 + 0.12::DOUBLE * (x2 - x1) + 1), 0), 480) AS BIGINT) AS cx2, CAST(least(greatest(floor(y2 + 0.12::DOUBLE * (y2 - y1) + 1), 0), 360) AS BIGINT) AS cy2 FROM detections) SELECT * FROM c WHERE cx2 > cx1 AND cy2 > cy1"""),
    "hash_sample": duck("points", "SELECT obj_id, pid FROM points QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY md5('3:' || pid), pid) <= 40"),
    "tsdf_integrate": duck("pixels cameras", f"{_TSDF} SELECT scene, ix, iy, iz, round(w, 6) AS w, round(tsdf, 6) AS tsdf, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM vol"),
    "tsdf_zero_cross": duck("pixels cameras", f"{_TSDF}, " + "z AS (" + " UNION ALL ".join(f"SELECT scene, ix, iy, iz, '{a}' AS axis, tsdf AS p, lead(tsdf) OVER (PARTITION BY scene, {b}, {c} ORDER BY {a}) AS q FROM vol" for a, b, c in (("ix", "iy", "iz"), ("iy", "ix", "iz"), ("iz", "ix", "iy"))) + ") SELECT scene, ix, iy, iz, axis, round(p / (p - q), 6) AS t FROM z WHERE (p < 0) <> (q < 0)"),
    "support_image": duck("observations", """m AS (SELECT inst_id, obs_id, ord, label = 'monitor' AS lm, (obs_id * 7 % 101) / 100.0::DOUBLE AS support, (obs_id * 13 % 101) / 100.0::DOUBLE AS centre, score, obs_id % 900 AS sharp, obs_id % 2 AS mask,
  least(greatest(obs_id % 400 - 20, 0), 480) AS x1, least(greatest(obs_id % 300 - 10, 0), 360) AS y1, least(greatest(obs_id % 400 + 60, 0), 480) AS x2, least(greatest(obs_id % 300 + 90, 0), 360) AS y2 FROM observations),
k AS (SELECT *, bool_or(lm) OVER (PARTITION BY inst_id) AS any_ FROM m WHERE x2 - x1 >= 4 AND y2 - y1 >= 4),
s AS (SELECT inst_id, obs_id, ord, round(0.42::DOUBLE * support + 0.23::DOUBLE * centre + 0.12::DOUBLE * score + 0.10::DOUBLE * least(ln(1 + sharp) / 7, 1) + 0.08::DOUBLE * mask + 0.05::DOUBLE * CAST(lm AS INT) - 0.08::DOUBLE * CAST(x1 <= 1 OR y1 <= 1 OR x2 >= 479 OR y2 >= 359 AS INT), 9) AS image_score FROM k WHERE lm OR NOT any_)
SELECT inst_id, obs_id, image_score FROM s QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY image_score DESC, ord) = 1"""),
    "mesh_quality": duck("placed", """m AS (SELECT inst_id AS mesh_id, (inst_id * 7 % 101) / 100.0::DOUBLE AS support, (inst_id * 13 % 101) / 100.0::DOUBLE AS bbox, (50 + inst_id % 51) / 100.0::DOUBLE AS comp, n_points AS n, frames_seen AS f, inst_id * 3 % 500 AS faces FROM placed),
s AS (SELECT *, round(0.45::DOUBLE * support + 0.25::DOUBLE * bbox + 0.10::DOUBLE * comp + 0.10::DOUBLE * least(n / 1000.0::DOUBLE, 1) + 0.10::DOUBLE * least(f / 2.0::DOUBLE, 1), 9) AS score FROM m)
SELECT mesh_id, score, faces >= 100 AND n >= 300 AND support >= 0.25 AND bbox >= 0.35 AND comp >= 0.65 AND score >= 0.48 AS good FROM s"""),
}
