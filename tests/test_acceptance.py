"""Small cases with known answers for the scene operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlake.operators import assets, audit, detections, instances, projection, review, room, sampling, scene_objects


def boxes(spark, rows):
    return spark.createDataFrame(rows, "det_id long, frame long, label string, score double, x1 double, y1 double, x2 double, y2 double")


def test_suppression_keeps_other_labels(spark):
    d = boxes(spark, [(0, 0, "table", 0.8, 0.0, 0.0, 100.0, 100.0), (1, 0, "table", 0.7, 2.0, 2.0, 101.0, 101.0), (2, 0, "cabinet", 0.75, 2.0, 2.0, 101.0, 101.0)])
    assert sorted(r.det_id for r in detections.suppress_overlapping(d).collect()) == [0, 2]


def test_suppression_breaks_ties_by_order(spark):
    d = boxes(spark, [(k, 0, "chair", 0.5, 0.0, 0.0, 10.0, 10.0) for k in (5, 3, 9)])
    assert [r.det_id for r in detections.suppress_overlapping(d).collect()] == [3]


def test_empty_detections(spark):
    assert detections.suppress_overlapping(boxes(spark, [])).count() == 0


def observation(obs_id, frame, score, at, label="chair", box=(0, 0, 50, 50), diag=1.0):
    return (obs_id, obs_id, label, 0, frame, score, *map(float, at), float(diag), *map(float, box))


OBS = "obs_id long, ord long, label string, scene long, frame long, score double, cx3 double, cy3 double, cz3 double, diag double, x1 double, y1 double, x2 double, y2 double"


def test_clusters_merge_views_and_drop_ghosts(spark):
    rows = [observation(0, 0, 0.9, (0, 0, 0)), observation(1, 1, 0.8, (0.1, 0, 0)), observation(2, 2, 0.3, (5, 0, 0))]
    got = {r.obs_id: r for r in instances.cluster_observations(spark.createDataFrame(rows, OBS), ["scene", "label"]).collect()}
    assert got[0].cluster == got[1].cluster != got[2].cluster
    assert got[0].frames_seen == 2 and got[0].kept and not got[2].kept


def test_same_frame_neighbours_stay_apart(spark):
    rows = [observation(0, 0, 0.9, (0, 0, 0), box=(0, 0, 50, 50)), observation(1, 0, 0.8, (0.3, 0, 0), box=(60, 0, 110, 50))]
    got = instances.cluster_observations(spark.createDataFrame(rows, OBS), ["scene", "label"]).collect()
    assert len({r.cluster for r in got}) == 2


def test_six_repeated_chairs(spark):
    seen = {0: range(6), 1: [0, 1, 2, 3, 5], 2: [2, 3, 4, 5]}
    rows, k = [], 0
    for frame, ids in seen.items():
        for i in ids:
            rows.append(observation(k, frame, 0.9 - 0.01 * k, (0.45 * i + 0.01 * frame, 0, 0), box=(60 * i, 0, 60 * i + 50, 50)))
            k += 1
    got = instances.cluster_observations(spark.createDataFrame(rows, OBS), ["scene", "label"]).collect()
    assert len({r.cluster for r in got}) == 6


def test_label_vote(spark):
    rows = [(0, 1, 0, 0, "monitor", 0.9, 900), (1, 1, 1, 0, "table", 0.5, 100), (2, 1, 2, 1, "table", 0.6, 200), (3, 1, 3, 2, "table", 0.4, 150)]
    df = spark.createDataFrame(rows, "obs_id long, inst_id long, ord long, frame long, label string, score double, n_raw long")
    (r,) = instances.vote_labels(df).collect()
    assert (r.label, r.score, r.frames_seen, r.best_obs, r.n_obs) == ("table", 0.6, 3, 2, 4)


def test_split_tracks_of_twelve_objects(spark):
    rng = np.random.default_rng(0)
    rows, inst, pid = [], 0, 0
    for obj in range(12):
        for part in range(5 if obj < 6 else 4):
            for p in rng.uniform(-0.4, 0.4, (150, 3)) + [obj % 4 * 1.5, 0.5, obj // 4 * 1.5]:
                rows.append((0, inst, pid, *map(float, p)))
                pid += 1
            inst += 1
    assert inst == 54
    pts = spark.createDataFrame(rows, "scene long, inst_id long, pid long, x double, y double, z double")
    b = instances.robust_bounds(pts, ["scene", "inst_id"]).withColumns({"frames_seen": F.lit(1), "score": F.lit(0.5), "n_points": F.col("n_raw")})
    ranked = instances.evidence_rank(b, "scene")
    none = spark.createDataFrame([], "a long, b long")
    merged = instances.merge_complete_link(b, instances.split_track_pairs(ranked, none, None, "scene"), "scene")
    assert merged.select("seed").distinct().count() == 12


def test_pinhole_projection(spark):
    cam = spark.createDataFrame([(0, *[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.0, 0.0, 0.0, 100.0, 100.0, 32.0, 32.0)], "frame long, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, t0 double, t1 double, t2 double, fx double, fy double, cx double, cy double")
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (1, 0, 0.1, -0.2, 2.0)], "pid long, frame long, x double, y double, z double")
    got = {r.pid: (r.pu, r.pv, r.pz) for r in projection.project_points(pts, cam).collect()}
    assert got[0] == (32.0, 32.0, 1.0) and got[1] == pytest.approx((37.0, 22.0, 2.0))


def test_review_counts(spark):
    inst = spark.createDataFrame([(0, "table"), (1, "chair"), (2, "monitor"), (3, "sofa")], "inst_id long, label string")
    dec = spark.createDataFrame([(0, 0, "relabel", "Work Desk", 0.9), (1, 1, "reject", None, 0.9), (2, 2, "relabel", "plant", 0.75), (3, 3, "reject", None, 0.8), (2, 4, "reject", None, 0.99)], "inst_id long, ord long, action string, new_label string, confidence double")
    got = {r.inst_id: (r.label, r.status) for r in review.apply_decisions(inst, dec).collect()}
    assert got == {0: ("table", "kept"), 1: ("chair", "rejected"), 2: ("plant", "relabelled"), 3: ("sofa", "kept")}


def test_room_yaw_of_a_turned_room(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 1, 4000)
    side = rng.integers(0, 4, 4000)
    x = np.where(side == 0, 0, np.where(side == 1, 4, t * 4))
    z = np.where(side == 2, 0, np.where(side == 3, 2, t * 2))
    a = math.radians(25)
    pts = [(0, float(c), float(d)) for c, d in zip(x * math.cos(a) - z * math.sin(a), x * math.sin(a) + z * math.cos(a))]
    (r,) = room.min_area_yaw(spark.createDataFrame(pts, "scene long, x double, z double")).collect()
    assert abs(math.degrees(r.yaw) - 25) < 1.5


def test_wall_cells_fill_to_the_opening(spark):
    rows = [(0, y, u, u < 2, 0, 3 if u == 5 else 0, False) for y in range(8) for u in range(10)]
    df = spark.createDataFrame(rows, "wall long, iy long, iu long, observed boolean, occluded_views long, through_views long, opening boolean")
    fill = {(r.iy, r.iu) for r in room.wall_fill(df, ["wall"]).collect() if r.fill}
    assert fill == {(y, 3) for y in range(8)}


def test_rack_scale(spark):
    df = spark.createDataFrame([(0, "Server Rack", 1.0), (0, "rack", 1.1), (0, "chair", 9.0), (1, "chair", 1.0)], "scene long, label string, h double")
    got = {r.scene: (r.scale, r.metric) for r in room.rack_scale(df).collect()}
    assert got[0] == (pytest.approx(2 / 1.05), True) and got[1] == (1.0, False)


def test_reflection_statuses(spark):
    row = lambda i, **k: tuple({"inst_id": i, "label": "chair", "frames": 3, "hits": 3, "inside": 0.9, "overlap": 0.05, "reprojection": 0.1, "centre": 0.2, "extent": 0.5, "planarity": 0.1, "normal_y": 0.9, "floor_gap": 0.0, "room_height": 2.5, **k}.values())
    schema = "inst_id long, label string, frames long, hits long, inside double, overlap double, reprojection double, centre double, extent double, planarity double, normal_y double, floor_gap double, room_height double"
    rows = [row(0), row(1, inside=0.0, hits=0, floor_gap=1.0), row(2, inside=0.6, hits=1), row(3, inside=0.0, hits=0)]
    got = {r.inst_id: r.status for r in audit.audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: "rejected_reflection", 1: "rejected_unsupported", 2: "uncertain", 3: "accepted"}


def test_size_groups_are_not_swapped(spark):
    rows = [(0, 0, "rack", 0.6, 2.0, 1.0), (0, 1, "rack", 0.6, 2.0, 1.02), (0, 2, "rack", 1.0, 2.0, 0.6)]
    got = assets.size_groups(spark.createDataFrame(rows, "scene long, inst_id long, label string, w double, h double, d double"), ["scene", "label"]).collect()
    assert len({r.seed for r in got}) == 2 and {r.seed for r in got if r.inst_id in (0, 1)} == {1}


def test_model_fit_finds_turn_and_scale(spark):
    rng = np.random.default_rng(11)
    body = np.stack([rng.uniform(-0.5, 0.5, 300), rng.uniform(0, 1.6, 300), rng.choice([-0.25, 0.25], 300)], 1)
    arm = np.stack([rng.uniform(0.3, 0.5, 84), rng.uniform(1.2, 1.6, 84), rng.uniform(0.25, 0.6, 84)], 1)
    model = np.vstack([body, arm])
    lo, hi = model.min(0), model.max(0)
    centred = (model - [(lo[0] + hi[0]) / 2, lo[1], (lo[2] + hi[2]) / 2]) * 1.2
    turned = np.stack([centred[:, 2], centred[:, 1], -centred[:, 0]], 1)
    size = np.ptp(turned, axis=0)
    scans = spark.createDataFrame([(0, *map(float, size), turned.tolist()), (1, *map(float, size), turned[:5].tolist())], "inst_id long, w double, h double, d double, points array<array<double>>")
    surf = spark.createDataFrame([(0, model.tolist()), (1, model.tolist())], "inst_id long, surface array<array<double>>")
    got = {r.inst_id: r for r in assets.fit_models(scans, surf).collect()}
    assert got[0].yaw_degrees == pytest.approx(90) and got[0].sx == pytest.approx(1.2, abs=0.08) and got[1].reason == "insufficient-scan-points"


def test_up_from_cameras_needs_an_area():
    eye = np.repeat(np.eye(3)[None], 6, 0)
    ring = np.array([[math.cos(a), 0.02 * (k % 2), math.sin(a)] for k, a in enumerate(np.linspace(0, 5, 6))])
    down = eye.copy()
    down[:, 1] *= -1
    assert assets.up_from_cameras(down, -np.einsum("kij,kj->ki", down, ring))[1]
    assert not assets.up_from_cameras(down, np.stack([np.arange(6.0), np.zeros(6), np.zeros(6)], 1))[1]


def test_shared_asset_is_kept(spark):
    rows = [(0, 1, "chair", "objects/1.glb"), (0, 2, "chair", "objects/1.glb"), (0, 3, "sofa", "objects/3.glb")]
    objects = spark.createDataFrame(rows, "scene long, obj_id long, label string, glb string")
    dead = spark.createDataFrame([(0, 1), (0, 3)], "scene long, obj_id long")
    paths = {r.path for r in scene_objects.asset_garbage(objects, dead).collect()}
    assert "objects/1.glb" not in paths and {"objects/3.glb", "objects/1_custom.glb"} <= paths


def test_linspace_keeps_ends(spark):
    df = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r.id for r in sampling.linspace_sample(df, ["g"], ["id"], 4).collect()) == [0, 3, 6, 9]
    assert sampling.linspace_sample(df, ["g"], ["id"], 20).count() == 10


def test_largest_component_of_a_long_strip(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 1000)
    up_down = [*range(0, 1000, 2), *range(999, 0, -2)]
    rows = [(mesh, k, *v[k : k + 3]) for mesh, v in ((0, ids), (1, up_down)) for k in range(998)]
    # smaller pieces apart, and a face of one vertex
    rows += [(mesh, 998 + k, 2000 + k, 2001 + k, 2002 + k) for mesh in (0, 1) for k in range(5)] + [(0, 2000, 5000, 5000, 5000), (2, 0, 7, 7, 7)]
    faces = spark.createDataFrame(rows, "mesh_id long, face_id long, a long, b long, c long")
    got = sorted((r.mesh_id, r.face_id) for r in assets.largest_component(faces, ["mesh_id"]).collect())
    assert got == sorted([(mesh, k) for mesh in (0, 1) for k in range(998)] + [(2, 0)])
