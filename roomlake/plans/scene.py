"""The scene build as one plan over tables: many scenes at once, no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, audit, instances, placements, review, room
from ..operators.quantiles import quantiles
from ..session import checkpointed
from .hooks import SceneHooks, object_generator


def build_scene(points: DataFrame, labels: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """(scene, inst_id, label, px .. pz, yaw, w, h, d, metric, rep): placed objects in metres, with asset representatives.

    points: scene, inst_id, frame, pid, x, y, z; labels: scene, inst_id, label. Floor is p3 and ceiling p97 of a scene's heights; boxes
    near the floor stand on it; racks give the metric scale, else 1; the floor moves to 0 and the median to the origin; objects of one
    label with extents within a tenth share the best seen one's asset.
    """
    q = quantiles(points, ["scene"], {"y": (F.col("y"), (0.03, 0.97)), "x": (F.col("x"), (0.5,)), "z": (F.col("z"), (0.5,))})
    levels = q.select("scene", F.col("y")[0].alias("floor_y"), F.col("y")[1].alias("ceil_y"), F.col("x")[0].alias("mx"), F.col("z")[0].alias("mz"))
    named = labels.select("scene", "inst_id", "label")
    # heights relative to each scene's floor, so one floor level serves all scenes
    level = points.join(levels, "scene").withColumn("y", F.col("y") - F.col("floor_y")).select("scene", "inst_id", "pid", "frame", "x", "y", "z", (F.col("ceil_y") - F.col("floor_y")).alias("room_h"))
    seen = level.groupBy("scene", "inst_id").agg(F.countDistinct("frame").alias("frames_seen"), F.count(F.lit(1)).alias("n_points"))
    boxes = room.place_instances(level, named, ["scene", "inst_id"], 0.0, tolerance).join(named, ["scene", "inst_id"])
    scale = room.rack_scale(boxes)
    metric = boxes.join(scale, "scene").join(levels, "scene")
    s = F.col("scale")
    moved = metric.select(
        "scene", "inst_id", "label", ((F.col("px") - F.col("mx")) * s).alias("px"), (F.col("py") * s).alias("py"), ((F.col("pz") - F.col("mz")) * s).alias("pz"), "yaw", *[(F.col(c) * s).alias(c) for c in "whd"], "metric",
    )
    rows = moved.join(seen, ["scene", "inst_id"]).withColumn("score", F.lit(1.0))
    groups = assets.size_groups(rows, ["scene", "label"], 0.10)
    reps = assets.representatives(groups, rows, ["scene", "label", "seed"]).select("inst_id", "rep")
    return rows.join(reps, "inst_id")


def _instances(observations: DataFrame, points: DataFrame, member: str = "inst_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(voted instances without ghosts, their observations, their points), both with scene and inst_id."""
    voted = instances.drop_ghosts(instances.vote_labels(observations))
    kept = observations.join(voted.select("inst_id"), "inst_id", "left_semi")
    return voted, kept, points.join(kept.select("obs_id", "inst_id"), "obs_id")


def _ranked(voted: DataFrame, cloud: DataFrame) -> DataFrame:
    bounds = instances.robust_bounds(cloud, ["scene", "inst_id"])
    return instances.evidence_rank(bounds.join(voted.select("inst_id", "label", "score", "frames_seen"), "inst_id").withColumn("n_points", F.col("n_raw")), "scene")


def _moved(observations: DataFrame, groups: DataFrame) -> DataFrame:
    return observations.join(groups.select("inst_id", "seed"), "inst_id").withColumn("inst_id", F.col("seed")).drop("seed")


def assemble_scene(points: DataFrame, observations: DataFrame, hooks: SceneHooks | None = None, tolerance: float = 0.12, reflected: DataFrame | None = None, agreement: DataFrame | None = None) -> dict[str, DataFrame]:
    """{objects, rejected, rooms, summary} of many scenes, from observations and their points; stages are checkpointed.

    points: scene, obs_id, frame, pid, x, y, z; observations: scene, obs_id, ord, frame, label, score, x1, y1, x2, y2. Observations of a label are
    clustered, instances voted and ghosts dropped; split tracks join unless a shared frame tells them apart, unclear pairs by
    the overlap of their clouds; labels are reviewed (hooks); the audit rejects reflections and unsupported instances, with ``reflected`` and
    ``agreement`` as of audit.evidence; the rest is placed, placements that overlap are consolidated and placed anew; racks give the scale; objects of one size share
    an asset; the room's rectangle comes from the cloud.
    """
    hooks = hooks or SceneHooks()
    hooks.stage(0.0, "observations")
    sized = instances.robust_bounds(points, ["obs_id"]).select("obs_id", *[F.col(f"c_{c}").alias(f"c{c}3") for c in "xyz"], "diag", "n_raw")
    seen = checkpointed(observations.join(sized, "obs_id"))
    clustered = instances.cluster_observations(seen, ["scene", "label"])
    members = checkpointed(seen.join(clustered.filter("kept").select("obs_id", F.col("cluster").alias("inst_id")), "obs_id"))

    hooks.stage(0.2, "tracks")
    voted, members, cloud = _instances(members, points)
    ranked = checkpointed(_ranked(voted, cloud))
    boxes = members.select("scene", "inst_id", F.struct("scene", "frame").alias("frame"), "x1", "y1", "x2", "y2")
    found = checkpointed(instances.split_track_candidates(ranked, instances.separated_pairs(boxes), "scene"))
    support = instances.cloud_support(cloud, instances.split_tracks_needing_support(found), ranked)
    groups = instances.merge_complete_link(ranked.drop("rank"), instances.split_tracks_settled(found, support), "scene")
    members = checkpointed(_moved(members, groups))

    hooks.stage(0.4, "review")
    voted, members, cloud = _instances(members, points)
    told = checkpointed(hooks.reviewed(voted))
    voted = told.filter("status <> 'rejected'").drop("status")
    members, cloud = checkpointed(review.propagate_labels(members, told)), cloud.join(voted.select("inst_id"), "inst_id", "left_semi")

    hooks.stage(0.5, "audit")
    levels = checkpointed(quantiles(points, ["scene"], {"y": (F.col("y"), (0.03, 0.97))}).select("scene", F.col("y")[0].alias("floor_y"), F.col("y")[1].alias("ceil_y")))
    owned = members.select("inst_id", "obs_id", "frame", F.col("frame").alias("f")).distinct()
    a, b = owned.alias("a"), owned.alias("b")
    views = a.join(b, (F.col("a.inst_id") == F.col("b.inst_id")) & (F.col("a.obs_id") < F.col("b.obs_id")) & (F.col("a.f") != F.col("b.f")))
    of_obs = points.select(F.col("obs_id").alias("inst_id"), "pid", "x", "y", "z")
    mutual = instances.cloud_support(of_obs, views.select(F.col("a.obs_id").alias("earlier"), F.col("b.obs_id").alias("later")), instances.robust_bounds(of_obs, ["inst_id"]))
    overlap = audit.median_pair_overlap(mutual, members.select("obs_id", "inst_id", "frame"))
    steady = audit.stability(instances.robust_bounds(cloud, ["inst_id", "obs_id"]))
    gaps = cloud.groupBy("scene", "inst_id").agg(F.percentile("y", 0.02).alias("low")).join(levels, "scene")
    base = voted.select("inst_id", "label", F.col("frames_seen").alias("frames")).join(gaps.select("inst_id", (F.col("low") - F.col("floor_y")).alias("floor_gap"), (F.col("ceil_y") - F.col("floor_y")).alias("room_height")), "inst_id")
    audited = checkpointed(audit.audit(audit.evidence(base, overlap, steady, audit.planarity(cloud, ["inst_id"]), reflected, agreement)))
    kept, rejected = audit.split_by_status(audited)
    voted, members, cloud = (checkpointed(df.join(kept.select("inst_id"), "inst_id", "left_semi")) for df in (voted, members, cloud))

    hooks.stage(0.7, "placement")
    level = cloud.join(levels, "scene").withColumn("y", F.col("y") - F.col("floor_y"))
    ranked = checkpointed(_ranked(voted, cloud))
    placed = room.place_instances(level, voted.select("inst_id", "label"), ["inst_id"], 0.0, tolerance)
    boxed = placements.placement_boxes(placed.join(ranked.select("scene", "inst_id", "rank"), "inst_id"))
    boxes = members.select("scene", "inst_id", F.struct("scene", "frame").alias("frame"), "x1", "y1", "x2", "y2")
    found = checkpointed(placements.placed_candidates(boxed, instances.separated_pairs(boxes), "scene"))
    support = instances.cloud_support(cloud, placements.needs_support(found), ranked)
    groups = checkpointed(placements.consolidate(ranked.drop("rank"), placements.placed_duplicates(found, support, "scene"), "scene"))
    members = checkpointed(_moved(members, groups))
    final = instances.vote_labels(members)

    hooks.stage(0.9, "objects")
    objects = build_scene(points.join(members.select("obs_id", "inst_id"), "obs_id"), final.join(members.select("scene", "inst_id").distinct(), "inst_id"), tolerance)
    generate = hooks.generate or object_generator()
    objects = SceneHooks(generate=generate).generated(objects.withColumn("glb", F.concat(F.lit("objects/"), F.col("rep"), F.lit(".glb"))))
    heights = levels.select("scene", (F.col("ceil_y") - F.col("floor_y")).alias("height"))
    rooms = room.fit_room_rect(points.join(levels, "scene").withColumn("y", F.col("y") - F.col("floor_y")).drop("floor_y", "ceil_y"), heights).join(heights, "scene")
    counts = objects.groupBy("scene").agg(F.count(F.lit(1)).alias("n_objects"), F.countDistinct("rep").alias("n_assets"), F.countDistinct("label").alias("n_labels"))
    lost = rejected.join(gaps.select("inst_id", "scene"), "inst_id").groupBy("scene").agg(F.count(F.lit(1)).alias("n_rejected"))
    summary = levels.select("scene").join(counts, "scene", "left").join(lost, "scene", "left").fillna(0)
    hooks.stage(1.0, "done")
    return {"objects": objects, "rejected": rejected, "rooms": rooms, "summary": summary}
