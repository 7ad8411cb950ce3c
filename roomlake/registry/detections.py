"""Queries on detections and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as ops
from ..operators import sampling
from ..operators.projection import confidence_gate
from ..sources.carriers import carrier, duck

#: IoU of boxes a and b in SQL.
IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) /
  greatest((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
    - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0), 1e-9)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, det_id) - 1 AS rank FROM detections)"


def box_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.iou_pairs(carrier(spark, sf, "detections"), 0.3).withColumn("iou", F.round("iou", 9))


def nms_keep(spark: SparkSession, sf: str) -> DataFrame:
    return ops.suppress_overlapping(carrier(spark, sf, "detections"))


def nms_frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    kept = nms_keep(spark, sf)
    return kept.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n_kept"))


def _with_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "detections").withColumn("reflector_ratio", (F.col("det_id") % 10) / F.lit(10.0))


def cannot_link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cannot_link_pairs(_with_ratio(spark, sf))


def same_frame_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return ops.same_frame_duplicates(carrier(spark, sf, "detections"))


def shared_frame_max_iou(spark: SparkSession, sf: str) -> DataFrame:
    members = carrier(spark, sf, "detections").withColumn("inst_id", F.expr("frame div 4 * 8 + det_id % 8"))
    return ops.shared_frame_max_iou(members).withColumn("max_iou", F.round("max_iou", 9))


def top_n_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_per_frame(carrier(spark, sf, "detections")).select("frame", "det_id", F.col("rn").cast("long").alias("rn"))


def merge_detector_passes(spark: SparkSession, sf: str) -> DataFrame:
    dets = carrier(spark, sf, "detections")
    again = dets.filter(F.col("label").isin("monitor", "door", "window")).withColumns({"det_id": -F.col("det_id") - 1, "score": F.col("score") - 0.05, "x1": F.col("x1") + 20})
    return ops.merge_passes(dets, again).select("frame", "label", "det_id", F.round("score", 4).alias("score"))


def linspace_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.linspace_sample(carrier(spark, sf, "points"), ["obj_id"], ["pid"], 37).select("obj_id", "pid")


def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stride_sample(carrier(spark, sf, "points"), ["scene"], ["pid"], 1000, wide=True).select("scene", "pid")


def sharpest_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sharpest_frames(carrier(spark, sf, "frames_sharp"), 3)


def resample_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.resample_frames(carrier(spark, sf, "frames_sharp"), 60).select("video", "frame_idx")


def quantile_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quantile_frames(carrier(spark, sf, "frames_sharp")).select("video", "frame_idx")


def second_pass_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = carrier(spark, sf, "frames_sharp").select("video", F.col("frame_idx").alias("frame"))
    return ops.second_pass_frames(frames, 12).select("video", "frame")


def second_pass_labels(spark: SparkSession, sf: str) -> DataFrame:
    dets = carrier(spark, sf, "detections")
    frames = dets.select(F.expr("frame div 40").alias("video"), (F.col("frame") % 40).alias("frame")).distinct()
    numbered = frames.groupBy("video").agg(F.max("frame").alias("top")).withColumn("frame", F.explode(F.expr("sequence(0L, top)"))).select("video", "frame")
    again = ops.second_pass_frames(numbered, 12).select((F.col("video") * 40 + F.col("frame")).alias("frame"))
    return ops.second_pass_missing(dets, again, ["monitor", "window", "door"], 0.3).select("frame", "label", F.round("threshold", 6).alias("threshold"))


def mask_gate(spark: SparkSession, sf: str) -> DataFrame:
    dets = carrier(spark, sf, "detections").withColumns({"mask_pixels": F.col("det_id") % 40, "mask_iou": F.when(F.col("det_id") % 7 > 0, F.col("score"))})
    return ops.mask_gate(dets).select("frame", "det_id", "has_mask")


def observation_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Masks over the pixels that pass the confidence gate."""
    masks = carrier(spark, sf, "mask_cells").select((F.col("mask_id") % 4).alias("frame"), F.col("mask_id").alias("det_id"), F.col("ix").alias("u"), F.col("iy").alias("v"))
    dets = masks.select("frame", "det_id").distinct().withColumn("label", F.expr("CASE det_id % 5 WHEN 0 THEN 'glass door' WHEN 1 THEN 'window' ELSE 'chair' END"))
    pixels = carrier(spark, sf, "pixels").withColumns({"scene": F.expr("frame div 4"), "edge": F.lit(False), "excluded": F.lit(False)})
    return ops.admitted(dets, masks, confidence_gate(pixels, ["scene"], 20), least=3)


def _fold(source: str, least: str, extra: str = "") -> str:
    return f"""{extra}ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, det_id) - 1 AS rank FROM {source}),
c AS (SELECT a.frame, a.label, b.det_id, list(a.det_id) AS xs FROM ranked a JOIN ranked b ON a.frame = b.frame AND a.label = b.label AND a.rank < b.rank WHERE {IOU} >= {least} GROUP BY ALL),
r AS (SELECT ranked.frame, ranked.label, ranked.det_id, ranked.rank, coalesce(c.xs, []) AS xs FROM ranked LEFT JOIN c ON ranked.frame = c.frame AND ranked.label = c.label AND ranked.det_id = c.det_id),
f AS (SELECT frame, label, rank, [det_id] AS acc FROM r WHERE rank = 0 UNION ALL
  SELECT r.frame, r.label, r.rank, CASE WHEN list_has_any(f.acc, r.xs) THEN f.acc ELSE list_append(f.acc, r.det_id) END FROM f JOIN r ON f.frame = r.frame AND f.label = r.label AND r.rank = f.rank + 1),
kept AS (SELECT frame, label, unnest(arg_max(acc, rank)) AS det_id FROM f GROUP BY frame, label)"""


_REFLECT = "list_has_any(string_split(label, ' '), ['television', 'tv', 'monitor', 'screen', 'mirror', 'window', 'glass'])"

QUERIES = {
    "box_iou_pairs": box_iou_pairs, "nms_keep": nms_keep, "nms_frame_counts": nms_frame_counts, "cannot_link_pairs": cannot_link_pairs,
    "same_frame_duplicates": same_frame_duplicates, "shared_frame_max_iou": shared_frame_max_iou, "top_n_per_frame": top_n_per_frame,
    "merge_detector_passes": merge_detector_passes, "linspace_sample": linspace_sample, "stride_sample": stride_sample,
    "sharpest_frames": sharpest_frames, "resample_frames": resample_frames, "quantile_frames": quantile_frames, "second_pass_frames": second_pass_frames,
    "second_pass_labels": second_pass_labels, "mask_gate": mask_gate, "observation_admission": observation_admission,
}
ORACLES = {
    "box_iou_pairs": duck("detections", f"""{_RANKED},
p AS (SELECT a.frame, a.label, a.det_id AS earlier, b.det_id AS later, {IOU} AS iou FROM ranked a JOIN ranked b ON a.frame = b.frame AND a.label = b.label AND a.rank < b.rank)
SELECT frame, label, earlier, later, round(iou, 9) AS iou FROM p WHERE iou >= 0.3"""),
    "nms_keep": duck("detections", _fold("detections", "0.70") + " SELECT frame, label, det_id FROM kept"),
    "nms_frame_counts": duck("detections", _fold("detections", "0.70") + " SELECT frame, label, count(*) AS n_kept FROM kept GROUP BY frame, label"),
    "cannot_link_pairs": duck("detections", f"""d AS (SELECT *, (det_id % 10) / 10.0 AS ratio, {_REFLECT} AS refl FROM detections)
SELECT a.frame, a.det_id AS det_a, b.det_id AS det_b FROM d a JOIN d b ON a.frame = b.frame AND a.det_id < b.det_id
WHERE {IOU} <= 0.15 OR (a.refl <> b.refl AND CASE WHEN a.refl THEN b.ratio ELSE a.ratio END >= 0.5)"""),
    "same_frame_duplicates": duck("detections", f"""SELECT a.frame, a.det_id AS det_a, b.det_id AS det_b FROM detections a JOIN detections b ON a.frame = b.frame AND a.det_id < b.det_id
WHERE {IOU} >= 0.5 AND sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2)
  <= 0.35 * greatest(sqrt((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2), sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2))"""),
    "shared_frame_max_iou": duck("detections", f"""m AS (SELECT *, frame // 4 * 8 + det_id % 8 AS inst_id FROM detections)
SELECT a.inst_id AS inst_a, b.inst_id AS inst_b, round(max({IOU}), 9) AS max_iou, count(*) AS shared FROM m a JOIN m b ON a.frame = b.frame AND a.inst_id < b.inst_id GROUP BY ALL"""),
    "top_n_per_frame": duck("detections", "SELECT frame, det_id, row_number() OVER (PARTITION BY frame ORDER BY det_id) AS rn FROM detections QUALIFY rn <= 20"),
    "merge_detector_passes": duck("detections", _fold("both_", "0.70", """both_ AS (SELECT frame, label, det_id, score, x1, y1, x2, y2 FROM detections
  UNION ALL SELECT frame, label, -det_id - 1, score - 0.05, x1 + 20, y1, x2, y2 FROM detections WHERE label IN ('monitor', 'door', 'window')), """)
        + " SELECT frame, label, det_id, round(score, 4) AS score FROM both_ SEMI JOIN kept USING (frame, label, det_id)"),
    "linspace_sample": duck("points", """n AS (SELECT obj_id, pid, row_number() OVER (PARTITION BY obj_id ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY obj_id) AS n FROM points)
SELECT obj_id, pid FROM n WHERE n <= 37 OR i IN (SELECT k * (n.n - 1) // 36 FROM range(0, 37) t(k))"""),
    "stride_sample": duck("points", "SELECT scene, pid FROM points QUALIFY (row_number() OVER (PARTITION BY scene ORDER BY pid) - 1) % (count(*) OVER (PARTITION BY scene) // 1000 + 1) = 0"),
    "sharpest_frames": duck("frames_sharp", """t AS (SELECT DISTINCT video, frame_idx AS target FROM frames_sharp WHERE frame_idx % 3 = 0)
SELECT video, target, frame_idx, sharpness FROM (SELECT t.video, target, f.frame_idx, f.sharpness, row_number() OVER (PARTITION BY t.video, target ORDER BY f.sharpness DESC, f.frame_idx) AS rn
  FROM t JOIN frames_sharp f ON f.video = t.video AND f.frame_idx >= target AND f.frame_idx < target + 5) WHERE rn = 1"""),
    "resample_frames": duck("frames_sharp", """n AS (SELECT video, frame_idx, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM frames_sharp)
SELECT video, frame_idx FROM n WHERE n >= 2 AND (n <= 60 OR i IN (SELECT CAST(round_even(k * (n.n - 1) / 59.0, 0) AS BIGINT) FROM range(0, 60) t(k)))"""),
    "quantile_frames": duck("frames_sharp", """n AS (SELECT video, frame_idx, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM frames_sharp)
SELECT video, frame_idx FROM n WHERE i IN (SELECT CAST(round_even(q * (n.n - 1), 0) AS BIGINT) FROM (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(q))"""),
    "second_pass_frames": duck("frames_sharp", "n AS (SELECT video, max(frame_idx) + 1 AS n FROM frames_sharp GROUP BY video) SELECT f.video, frame_idx AS frame FROM frames_sharp f JOIN n ON f.video = n.video WHERE frame_idx % CAST(greatest(ceil(n / 12.0), 1) AS BIGINT) = 0 OR frame_idx = n - 1"),
    "second_pass_labels": duck("detections", """n AS (SELECT frame // 40 AS video, max(frame % 40) + 1 AS n FROM detections GROUP BY ALL),
g AS (SELECT video * 40 + k AS frame FROM n, LATERAL (SELECT unnest(range(0, n)) AS k) WHERE k % CAST(greatest(ceil(n / 12.0), 1) AS BIGINT) = 0 OR k = n - 1)
SELECT frame, label, 0.22::DOUBLE AS threshold FROM g, (VALUES ('monitor'), ('window'), ('door')) l(label) WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.frame = g.frame AND d.label = l.label)"""),
    "mask_gate": duck("detections", "SELECT frame, det_id, det_id % 7 > 0 AND score >= 0.5 AND det_id % 40 >= 16 AS has_mask FROM detections QUALIFY row_number() OVER (PARTITION BY frame ORDER BY det_id) <= 20"),
    "observation_admission": duck("mask_cells pixels", """b AS (SELECT frame // 4 AS scene, quantile_cont(CASE WHEN conf > 1e-5 THEN conf END, 0.2) AS bar FROM pixels GROUP BY ALL),
g AS (SELECT frame, u, v FROM pixels JOIN b ON scene = frame // 4 WHERE conf >= bar AND conf > 1e-5)
SELECT mask_id % 4 AS frame, mask_id AS det_id, count(*) AS n_good FROM mask_cells m JOIN g ON g.frame = mask_id % 4 AND g.u = ix AND g.v = iy WHERE mask_id % 5 > 1 GROUP BY mask_id HAVING count(*) >= 3"""),
}
