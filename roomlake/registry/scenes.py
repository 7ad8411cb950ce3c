"""Queries on scene documents, audits and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, instances
from ..operators import scene_objects as ops
from ..plans import scene as plan
from ..sources.carriers import carrier, duck
from ..streaming import jobs
from .points import _SUPPORT, _TRACKS, fit_sql
from .points import _support as support_of_tracks


def _r(*names: str, places: int = 6) -> list:
    return [(F.round(n, places) + 0.0).alias(n) for n in names]


def layout_merge(spark: SparkSession, sf: str) -> DataFrame:
    return ops.merge_layout(carrier(spark, sf, "scene_objects"), carrier(spark, sf, "layout_updates"))


def layout_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Updates with a bad label or scale now and then: their scenes stay as they are."""
    bad = F.when(F.col("ord") % 397 == 1, F.lit("  ")).when(F.col("ord") % 401 == 1, F.lit("a\tb")).otherwise(F.col("label"))
    updates = carrier(spark, sf, "layout_updates").withColumns({"label": bad, "editor_scale": F.when(F.col("ord") % 409 == 1, 500.0).otherwise(F.col("editor_scale"))})
    return ops.merge_layout(carrier(spark, sf, "scene_objects"), updates)


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "scene_objects").filter("obj_id % 3 = 1 or obj_id % 10 = 2").select("scene", "obj_id")


def asset_gc(spark: SparkSession, sf: str) -> DataFrame:
    return ops.asset_garbage(carrier(spark, sf, "scene_objects"), _deleted(spark, sf))


def object_delete(spark: SparkSession, sf: str) -> DataFrame:
    return ops.delete_objects(carrier(spark, sf, "scene_objects"), _deleted(spark, sf)).select("scene", "obj_id", "glb")


def object_add(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(0).cast("long").alias("scene"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("obj_id"), F.when(F.col("n_nationkey") % 5 == 0, F.lit(" ")).otherwise(F.col("n_name")).alias("label"), F.concat(F.lit("objects/custom_"), F.col("n_nationkey")).alias("glb"))
    return ops.add_objects(carrier(spark, sf, "scene_objects"), models)


def object_replace(spark: SparkSession, sf: str) -> DataFrame:
    objects = carrier(spark, sf, "scene_objects")
    return ops.replace_models(objects, objects.filter("obj_id % 4 = 0")).select("scene", "obj_id", "glb", "source", "editor_scale")


def scene_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.scene_summary(carrier(spark, sf, "scene_objects"))


def scene_json(spark: SparkSession, sf: str) -> DataFrame:
    objects = carrier(spark, sf, "scene_objects")
    rooms = objects.select("scene").distinct().select("scene", *[F.lit(v).alias(k) for k, v in (("xmin", 0.0), ("xmax", 4.0), ("zmin", 0.0), ("zmax", 3.0), ("height", 2.5))])
    return ops.scene_documents(objects, rooms)


def job_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest_job_state(carrier(spark, sf, "job_events"))


def job_progress_windows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.windowed_progress(carrier(spark, sf, "job_events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "state", "n")


def object_stability(spark: SparkSession, sf: str) -> DataFrame:
    points = carrier(spark, sf, "points").withColumn("inst_id", F.col("obj_id"))
    b = instances.robust_bounds(points.withColumn("half", F.col("frame") % 4), ["inst_id", "half"])
    return audit.stability(b).select("inst_id", *_r("centre", "extent"))


def cloud_planarity(spark: SparkSession, sf: str) -> DataFrame:
    return audit.planarity(carrier(spark, sf, "points").withColumn("z", F.col("z") / 100), ["obj_id"]).select("obj_id", *_r("planarity", "normal_y"))


def geometry_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("inst_id")
    e = carrier(spark, sf, "placed").select(
        "inst_id", "label", F.col("frames_seen").alias("frames"), (k % 4).alias("hits"), (k * 7 % 100 / 100.0).alias("inside"), (k * 11 % 60 / 100.0).alias("overlap"), F.when(k % 5 > 0, k * 13 % 100 / 100.0).alias("reprojection"),
        (k * 17 % 100 / 100.0).alias("centre"), (k * 19 % 100 / 100.0).alias("extent"), (k * 23 % 100 / 100.0).alias("planarity"), (k * 29 % 100 / 100.0).alias("normal_y"), (k * 31 % 120 / 100.0).alias("floor_gap"), F.lit(2.5).alias("room_height"),
    )
    return audit.audit(e, places=6)


def evidence_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit with evidence worked out from the clouds: mutual overlap of an object's tracks, stability, planarity, gap to the floor."""
    points = carrier(spark, sf, "points").withColumn("inst_id", F.col("obj_id"))
    tracks = points.select("inst_id", (F.col("obj_id") * 4 + F.col("frame") % 4).alias("obs_id"), (F.col("frame") % 4).alias("frame")).distinct()
    overlap = audit.median_pair_overlap(support_of_tracks(spark, sf), tracks)
    steady = audit.stability(instances.robust_bounds(points.withColumn("half", F.col("frame") % 4), ["inst_id", "half"]))
    flat = audit.planarity(points, ["inst_id"])
    seen = points.groupBy("inst_id").agg(F.countDistinct(F.col("frame") % 4).alias("frames"), (F.percentile("y", 0.02) - 0.01).alias("floor_gap"))
    label = F.expr("CASE inst_id % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'monitor' WHEN 2 THEN 'lamp' ELSE 'table' END")
    return audit.audit(audit.evidence(seen.withColumn("label", label), overlap, steady, flat).withColumn("room_height", F.lit(2.5)), places=6)


def audited_split(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and rejected instances of the evidence audit, counted by status."""
    kept, rejected = audit.split_by_status(evidence_audit(spark, sf))
    parts = kept.withColumn("kept", F.lit(True)).unionAll(rejected.withColumn("kept", F.lit(False)))
    return parts.groupBy("status", "kept").agg(F.count(F.lit(1)).alias("n"))


def _reflected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(mask pixels, reflector_containment of them)"""
    cells = carrier(spark, sf, "mask_cells").select((F.expr("mask_id div 5")).alias("frame"), F.col("mask_id").alias("det_id"), F.col("ix").alias("u"), F.col("iy").alias("v"))
    refl = cells.filter("det_id % 5 < 2").select("frame", F.col("det_id").alias("refl_id"), F.when(F.col("det_id") % 5 == 0, "mirror").otherwise("tv").alias("label"), "u", "v")
    return cells, audit.reflector_containment(cells, refl)


def reflector_containment(spark: SparkSession, sf: str) -> DataFrame:
    return _reflected(spark, sf)[1].select("det_id", F.round("ratio", 6).alias("ratio"), F.concat_ws(",", "labels").alias("labels"))


def reflector_evidence(spark: SparkSession, sf: str) -> DataFrame:
    cells, contained = _reflected(spark, sf)
    members = cells.select(F.expr("det_id div 15").alias("inst_id"), "det_id", "frame").distinct()
    return audit.reflector_ratios(contained, members).select("inst_id", "hits", *_r("inside"))


def exclude_mask(spark: SparkSession, sf: str) -> DataFrame:
    cells = carrier(spark, sf, "mask_cells").select((F.expr("mask_id div 5")).alias("frame"), F.col("mask_id").alias("det_id"), F.col("ix").alias("u"), F.col("iy").alias("v"))
    ids = cells.select("det_id").distinct()
    return audit.exclude_mask(ids.filter("det_id % 2 = 0"), cells, ids.filter("det_id % 6 = 0"), (16, 10))


def scene_build(spark: SparkSession, sf: str) -> DataFrame:
    """The whole relational scene build over the observed points."""
    labels = carrier(spark, sf, "points").select("scene", F.col("obj_id").alias("inst_id")).distinct().withColumn("label", F.expr("CASE inst_id % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END"))
    return plan.build_scene(carrier(spark, sf, "points").withColumn("inst_id", F.col("obj_id")), labels).select("scene", "inst_id", "label", *_r("px", "py", "pz", "yaw", "w", "h", "d", places=4), "metric", "rep")


_MERGE = """u AS (SELECT * FROM {upd} QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY ord DESC) = 1),
j AS (SELECT o.*, u.obj_id IS NOT NULL AS hit, u.label AS ul, u.px AS ux, u.py AS uy, u.pz AS uz, u.yaw AS uw, coalesce(u.editor_scale, o.editor_scale, 1) AS sc FROM scene_objects o LEFT JOIN u ON u.obj_id = o.obj_id),
k AS (SELECT *, sc BETWEEN 0.01 AND 100 AND (ul IS NULL OR (len(trim(ul)) BETWEEN 1 AND 100 AND NOT regexp_matches(ul, '[\\x00-\\x1f]'))) AS good FROM j),
g AS (SELECT *, hit AND NOT bool_or(hit AND NOT good) OVER (PARTITION BY scene) AS go FROM k)
SELECT scene, obj_id, CASE WHEN go THEN coalesce(trim(ul), label) ELSE label END AS label, CASE WHEN go THEN round(ux, 4) ELSE px END AS px, CASE WHEN go THEN round(uy, 4) ELSE py END AS py, CASE WHEN go THEN round(uz, 4) ELSE pz END AS pz, CASE WHEN go THEN round(uw, 5) ELSE yaw END AS yaw,
  CASE WHEN go THEN round(sc, 5) ELSE editor_scale END AS editor_scale, glb, go AS updated FROM g"""
_GONE = "dl AS (SELECT * FROM scene_objects WHERE obj_id % 3 = 1 OR obj_id % 10 = 2), st AS (SELECT * FROM scene_objects ANTI JOIN dl USING (scene, obj_id))"

QUERIES = {f.__name__: f for f in (
    layout_merge, layout_validation, asset_gc, object_delete, object_add, object_replace, scene_summary, scene_json, job_latest_state, job_progress_windows, object_stability, cloud_planarity, geometry_audit, evidence_audit, audited_split,
    reflector_containment, reflector_evidence, exclude_mask, scene_build,
)}
_BUILD = f"""lv AS (SELECT scene, quantile_cont(y, 0.03) AS fl, median(x) AS mx, median(z) AS mz FROM points GROUP BY scene),
pt AS (SELECT p.scene, obj_id AS inst_id, frame, x, y - fl AS y, z FROM points p JOIN lv ON p.scene = lv.scene),
cv AS (SELECT inst_id, var_samp(x) AS a, covar_samp(x, z) AS b, var_samp(z) AS c FROM pt GROUP BY inst_id),
yw AS (SELECT inst_id, CASE WHEN th >= pi() / 2 THEN th - pi() ELSE th END AS yaw, sqrt((m + r) / greatest(m - r, 1e-9)) AS ratio FROM (SELECT inst_id, atan2(2 * b, a - c) / 2 AS th, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM cv)),
sn AS (SELECT inst_id, CASE WHEN abs(q - round_even(q / (pi() / 2), 0) * (pi() / 2)) <= radians(15) THEN round_even(q / (pi() / 2), 0) * (pi() / 2) ELSE q END AS yaw FROM (SELECT inst_id, CASE WHEN ratio >= 1.2 THEN yaw ELSE 0 END AS q FROM yw)),
tu AS (SELECT pt.scene, pt.inst_id, yaw, cos(-yaw) AS c, sin(-yaw) AS s, cos(-yaw) * x - sin(-yaw) * z AS xr, sin(-yaw) * x + cos(-yaw) * z AS zr, y, frame FROM pt JOIN sn ON pt.inst_id = sn.inst_id),
q AS (SELECT scene, inst_id, yaw, any_value(c) AS c, any_value(s) AS s, quantile_cont(xr, 0.02) AS xl, quantile_cont(xr, 0.98) AS xh, quantile_cont(zr, 0.02) AS zl, quantile_cont(zr, 0.98) AS zh, quantile_cont(y, 0.02) AS yl, quantile_cont(y, 0.98) AS yh,
  count(*) AS n_points, count(DISTINCT frame) AS frames_seen, CASE inst_id % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END AS label FROM tu GROUP BY scene, inst_id, yaw),
b AS (SELECT *, CASE WHEN yl < 0.12 * CASE label WHEN 'server rack' THEN 3.5 ELSE 1 END THEN 0 ELSE yl END AS base FROM q),
bx AS (SELECT *, greatest(xh - xl, 0.02) AS w0, greatest(yh - base, 0.02) AS h0, greatest(zh - zl, 0.02) AS d0 FROM b),
sc AS (SELECT scene, coalesce(2 / median(CASE WHEN label = 'server rack' AND h0 > 1e-3 THEN h0 END), 1) AS k, count(*) FILTER (WHERE label = 'server rack') > 0 AS metric FROM bx GROUP BY scene),
mv AS (SELECT bx.scene, inst_id, label, (c * (xl + xh) / 2 + s * (zl + zh) / 2 - mx) * k AS px, base * k AS py, (-s * (xl + xh) / 2 + c * (zl + zh) / 2 - mz) * k AS pz, yaw, w0 * k AS w, h0 * k AS h, d0 * k AS d, metric, frames_seen, n_points FROM bx JOIN sc ON bx.scene = sc.scene JOIN lv ON lv.scene = bx.scene),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY w * h * d DESC, inst_id) - 1 AS rank FROM mv),
ac AS (SELECT p.scene, p.label, p.inst_id AS earlier, q.inst_id AS later FROM ranked p JOIN ranked q ON p.scene = q.scene AND p.label = q.label AND p.rank < q.rank AND abs(q.w - p.w) / p.w <= 0.10 AND abs(q.h - p.h) / p.h <= 0.10 AND abs(q.d - p.d) / p.d <= 0.10),
{fit_sql('ranked', 'ac', 'scene, label', 'inst_id', True)},
rp AS (SELECT g.inst_id, first_value(g.inst_id) OVER (PARTITION BY g.scene, g.label, g.seed ORDER BY frames_seen DESC, n_points DESC, g.inst_id) AS rep FROM placed_ g JOIN mv ON mv.inst_id = g.inst_id)
SELECT scene, mv.inst_id, label, round(px, 4) AS px, round(py, 4) AS py, round(pz, 4) AS pz, round(yaw, 4) AS yaw, round(w, 4) AS w, round(h, 4) AS h, round(d, 4) AS d, metric, rep FROM mv JOIN rp ON rp.inst_id = mv.inst_id"""
#: Eigenvalues of each object's 3 x 3 covariance by the trigonometric formula; the normal is the longest cross product of two rows of (A - least I).
_PLANAR_SQL = """cv AS (SELECT obj_id, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM {src} GROUP BY obj_id HAVING count(*) >= 30),
e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), e2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM e1),
e3 AS (SELECT *, acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p) / 2, -1), 1)) / 3 AS phi FROM e2),
e4 AS (SELECT *, q + 2 * p * cos(phi) AS l2, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM e3),
e5 AS (SELECT *, [[xy * yz - xz * (yy - l0), xz * xy - (xx - l0) * yz, (xx - l0) * (yy - l0) - xy * xy], [xy * (zz - l0) - xz * yz, xz * xz - (xx - l0) * (zz - l0), (xx - l0) * yz - xy * xz], [(yy - l0) * (zz - l0) - yz * yz, yz * xz - xy * (zz - l0), xy * yz - (yy - l0) * xz]] AS c FROM e4),
e6 AS (SELECT *, list_sort(list_transform(c, lambda v: [sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2), abs(v[2])]))[3] AS n FROM e5),
pl AS (SELECT obj_id, least(greatest(1 - greatest(l0, 0) / greatest(l2, 1e-9) / 0.08, 0), 1) AS planarity, n[2] / n[1] AS normal_y FROM e6)"""
_STABLE_SQL = """b AS (SELECT obj_id, frame % 4 AS k, """ + ", ".join(f"quantile_cont({c}, 0.05) AS l{c}, quantile_cont({c}, 0.95) AS h{c}" for c in "xyz") + """ FROM points GROUP BY obj_id, frame % 4 HAVING count(*) >= 10),
e AS (SELECT obj_id, """ + ", ".join(f"greatest(h{c} - l{c}, 1e-6) AS e{c}, (l{c} + h{c}) / 2 AS c{c}" for c in "xyz") + """ FROM b),
r_ AS (SELECT obj_id, """ + ", ".join(f"median(e{c}) AS re{c}, median(c{c}) AS rc{c}" for c in "xyz") + """ FROM e GROUP BY obj_id),
d_ AS (SELECT e.obj_id, sqrt((cx - rcx) ** 2 + (cy - rcy) ** 2 + (cz - rcz) ** 2) AS drift, greatest(sqrt(rex ** 2 + rey ** 2 + rez ** 2), 1e-6) AS dd, [abs(ex - rex) / greatest(rex, 1e-6), abs(ey - rey) / greatest(rey, 1e-6), abs(ez - rez) / greatest(rez, 1e-6)] AS g FROM e JOIN r_ USING (obj_id)),
x_ AS (SELECT obj_id, exp(-median(g) / 0.35) AS extent FROM (SELECT obj_id, unnest(g) AS g FROM d_) GROUP BY obj_id),
sb AS (SELECT d_.obj_id, exp(-median(drift) / (0.20::DOUBLE * any_value(dd))) AS centre, any_value(extent) AS extent FROM d_ JOIN x_ ON x_.obj_id = d_.obj_id GROUP BY d_.obj_id)"""
_LABEL = "CASE obj_id % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'monitor' WHEN 2 THEN 'lamp' ELSE 'table' END"
ORACLES = {
    "scene_build": duck("points", _BUILD),
    "cloud_planarity": duck("points", "fl AS (SELECT * REPLACE (z / 100 AS z) FROM points), " + _PLANAR_SQL.replace("{src}", "fl") + " SELECT obj_id, round(planarity, 6) AS planarity, round(normal_y, 6) AS normal_y FROM pl"),
    "scene_json": duck("scene_objects", """o AS (SELECT scene, list({'obj_id': obj_id, 'label': label, 'position': [px, py, pz], 'yaw': yaw, 'glb': glb} ORDER BY obj_id) AS objects FROM scene_objects GROUP BY scene)
SELECT scene, CAST(to_json({'name': CAST(scene AS VARCHAR), 'room': {'width': 4.0::DOUBLE, 'depth': 3.0::DOUBLE, 'height': 2.5::DOUBLE}, 'objects': objects}) AS VARCHAR) AS document FROM o"""),
    "evidence_audit": duck("points", f"""{_TRACKS}, {_SUPPORT}, {_PLANAR_SQL.replace("{src}", "points")}, {_STABLE_SQL},
ov AS (SELECT earlier // 4 AS obj_id, median(support_mean) AS overlap FROM su GROUP BY ALL),
fr AS (SELECT obj_id, count(DISTINCT frame % 4) AS frames, greatest(quantile_cont(y, 0.02) - 0.01::DOUBLE, 0) AS gap, {_LABEL} AS label FROM points GROUP BY obj_id),
ev AS (SELECT fr.*, coalesce(overlap, 0) AS ov, coalesce(centre, 0) AS ce, coalesce(extent, 0) AS ex, coalesce(planarity, 0) AS pl_, coalesce(normal_y, 0) AS ny FROM fr LEFT JOIN ov USING (obj_id) LEFT JOIN sb USING (obj_id) LEFT JOIN pl USING (obj_id)),
g_ AS (SELECT *, least(greatest(0.50::DOUBLE * ov + 0.25::DOUBLE * ce + 0.25::DOUBLE * ex, 0), 1) AS geometry, (label <> 'monitor' AND pl_ >= 0.75 AND ny <= 0.45) OR (frames >= 2 AND ov < 0.15 AND ce < 0.5) AS conflict, CASE WHEN label IN ('chair', 'table') THEN gap / 2.5 ELSE 0 END AS gr FROM ev)
SELECT obj_id AS inst_id, round(geometry, 6) AS geometry, 0::DOUBLE AS reflection, conflict, CASE WHEN frames <= 3 AND gr >= 0.30 THEN 'rejected_unsupported' WHEN frames < 2 THEN 'uncertain' ELSE 'accepted' END AS status FROM g_"""),
    "layout_merge": duck("scene_objects layout_updates", _MERGE.format(upd="layout_updates")),
    "layout_validation": duck("scene_objects layout_updates", """b AS (SELECT * REPLACE (CASE WHEN ord % 397 = 1 THEN '  ' WHEN ord % 401 = 1 THEN 'a' || chr(9) || 'b' ELSE label END AS label, CASE WHEN ord % 409 = 1 THEN 500.0::DOUBLE ELSE editor_scale END AS editor_scale) FROM layout_updates), """ + _MERGE.format(upd="b")),
    "asset_gc": duck("scene_objects", f"{_GONE}, c AS (SELECT DISTINCT scene, unnest([glb, 'objects/' || obj_id || '.glb', 'objects/' || obj_id || '_custom.glb', 'objects/' || obj_id || '_trellis.glb']) AS path FROM dl) SELECT scene, path FROM c WHERE (scene, path) NOT IN (SELECT (scene, glb) FROM st)"),
    "object_delete": duck("scene_objects", f"{_GONE} SELECT scene, obj_id, glb FROM st"),
    "object_add": duck("scene_objects", """SELECT scene, obj_id, label, px, py, pz, yaw, editor_scale, glb FROM scene_objects
UNION ALL SELECT 0, n_nationkey + 1000000, trim(n_name), 0, 0, 0, 0, 1, 'objects/custom_' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 0"""),
    "object_replace": duck("scene_objects", "SELECT scene, obj_id, CASE WHEN obj_id % 4 = 0 THEN 'objects/' || obj_id || '_custom.glb' ELSE glb END AS glb, CASE WHEN obj_id % 4 = 0 THEN 'custom-upload' END AS source, CASE WHEN obj_id % 4 = 0 THEN 1 ELSE editor_scale END AS editor_scale FROM scene_objects"),
    "scene_summary": duck("scene_objects", "SELECT scene, count(*) AS n_objects, count(glb) - count(DISTINCT glb) AS n_reused, count(DISTINCT label) AS n_labels FROM scene_objects GROUP BY scene"),
    "job_latest_state": duck("job_events", """SELECT job_id, arg_max(state, (ts, event_id)) FILTER (WHERE state <> 'cancel') AS state, arg_max(frac, (ts, event_id)) FILTER (WHERE state <> 'cancel') AS frac, bool_or(state = 'cancel') AS cancelled, count(*) AS n_events FROM job_events GROUP BY job_id"""),
    "job_progress_windows": duck("job_events", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, state, count(*) AS n FROM job_events GROUP BY ALL"),
    "object_stability": duck("points", """b AS (SELECT obj_id, frame % 4 AS k, """ + ", ".join(f"quantile_cont({c}, 0.05) AS l{c}, quantile_cont({c}, 0.95) AS h{c}" for c in "xyz") + """ FROM points GROUP BY obj_id, frame % 4 HAVING count(*) >= 10),
e AS (SELECT obj_id, """ + ", ".join(f"greatest(h{c} - l{c}, 1e-6) AS e{c}, (l{c} + h{c}) / 2 AS c{c}" for c in "xyz") + """ FROM b),
r AS (SELECT obj_id, """ + ", ".join(f"median(e{c}) AS re{c}, median(c{c}) AS rc{c}" for c in "xyz") + """ FROM e GROUP BY obj_id),
d AS (SELECT e.obj_id, sqrt((cx - rcx) ** 2 + (cy - rcy) ** 2 + (cz - rcz) ** 2) AS drift, greatest(sqrt(rex ** 2 + rey ** 2 + rez ** 2), 1e-6) AS dd, [abs(ex - rex) / greatest(rex, 1e-6), abs(ey - rey) / greatest(rey, 1e-6), abs(ez - rez) / greatest(rez, 1e-6)] AS g FROM e JOIN r USING (obj_id)),
x AS (SELECT obj_id, exp(-median(g) / 0.35) AS extent FROM (SELECT obj_id, unnest(g) AS g FROM d) GROUP BY obj_id)
SELECT d.obj_id AS inst_id, round(exp(-median(drift) / (0.20::DOUBLE * any_value(dd))), 6) AS centre, round(any_value(extent), 6) AS extent FROM d JOIN x ON x.obj_id = d.obj_id GROUP BY d.obj_id"""),
    "geometry_audit": duck("placed", """e AS (SELECT inst_id AS k, label, frames_seen AS f, inst_id % 4 AS hits, inst_id * 7 % 100 / 100.0::DOUBLE AS ins, inst_id * 11 % 60 / 100.0::DOUBLE AS ov, CASE WHEN inst_id % 5 > 0 THEN inst_id * 13 % 100 / 100.0::DOUBLE END AS rp, inst_id * 17 % 100 / 100.0::DOUBLE AS ce, inst_id * 19 % 100 / 100.0::DOUBLE AS ex,
  inst_id * 23 % 100 / 100.0::DOUBLE AS pl, inst_id * 29 % 100 / 100.0::DOUBLE AS ny, inst_id * 31 % 120 / 100.0::DOUBLE AS gap FROM placed),
g AS (SELECT *, least(greatest(CASE WHEN rp IS NOT NULL THEN 0.30::DOUBLE * ov + 0.30::DOUBLE * rp + 0.20::DOUBLE * ce + 0.20::DOUBLE * ex ELSE 0.50::DOUBLE * ov + 0.25::DOUBLE * ce + 0.25::DOUBLE * ex END, 0), 1) AS geometry,
  (label <> 'monitor' AND pl >= 0.75 AND ny <= 0.45) OR (f >= 2 AND ov < 0.15 AND (coalesce(rp < 0.25, false) OR ce < 0.5)) AS conflict FROM e),
h AS (SELECT *, CASE WHEN ins > 0 THEN least(greatest(0.55::DOUBLE * ins + 0.25::DOUBLE * CAST(conflict AS INT) + 0.20::DOUBLE * (1 - ov), 0), 1) ELSE 0 END AS refl, CASE WHEN label IN ('server rack', 'table', 'chair') THEN greatest(gap, 0) / 2.5 ELSE 0 END AS gr FROM g)
SELECT k AS inst_id, round(geometry, 6) AS geometry, round(refl, 6) AS reflection, conflict, CASE WHEN f >= 2 AND hits >= 2 AND ins >= 0.70 AND conflict AND refl >= 0.65 THEN 'rejected_reflection' WHEN f <= 3 AND gr >= 0.30 THEN 'rejected_unsupported' WHEN ins >= 0.50 OR f < 2 THEN 'uncertain' ELSE 'accepted' END AS status FROM h"""),
    "reflector_containment": duck("mask_cells", """n AS (SELECT mask_id, count(*) AS n FROM mask_cells GROUP BY mask_id),
h AS (SELECT a.mask_id, b.mask_id AS r, CASE WHEN b.mask_id % 5 = 0 THEN 'mirror' ELSE 'tv' END AS label, count(*) AS k FROM mask_cells a JOIN mask_cells b ON a.mask_id // 5 = b.mask_id // 5 AND a.ix = b.ix AND a.iy = b.iy AND a.mask_id <> b.mask_id WHERE b.mask_id % 5 < 2 GROUP BY a.mask_id, b.mask_id)
SELECT n.mask_id AS det_id, round(max(coalesce(k, 0) / greatest(n, 1)), 6) AS ratio, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE k / n >= 0.5), '') AS labels FROM n LEFT JOIN h ON h.mask_id = n.mask_id GROUP BY n.mask_id"""),
    "reflector_evidence": duck("mask_cells", """n AS (SELECT mask_id, count(*) AS n FROM mask_cells GROUP BY mask_id),
h AS (SELECT a.mask_id, b.mask_id AS r, count(*) AS k FROM mask_cells a JOIN mask_cells b ON a.mask_id // 5 = b.mask_id // 5 AND a.ix = b.ix AND a.iy = b.iy AND a.mask_id <> b.mask_id WHERE b.mask_id % 5 < 2 GROUP BY a.mask_id, b.mask_id),
rt AS (SELECT n.mask_id, max(coalesce(k, 0) / greatest(n, 1)) AS ratio FROM n LEFT JOIN h ON h.mask_id = n.mask_id GROUP BY n.mask_id)
SELECT mask_id // 15 AS inst_id, count(DISTINCT CASE WHEN ratio >= 0.70 THEN mask_id // 5 END) AS hits, round(coalesce(median(CASE WHEN ratio >= 0.50 THEN ratio END), 0), 6) AS inside FROM rt GROUP BY ALL"""),
    "exclude_mask": duck("mask_cells", "SELECT DISTINCT mask_id // 5 AS frame, ix + a AS u, iy + b AS v FROM mask_cells, range(-1, 2) p(a), range(-1, 2) q(b) WHERE mask_id % 2 = 0 AND mask_id % 6 <> 0 AND ix + a BETWEEN 0 AND 15 AND iy + b BETWEEN 0 AND 9"),
}
ORACLES["audited_split"] = "SELECT status, NOT starts_with(status, 'rejected') AS kept, count(*) AS n FROM (" + ORACLES["evidence_audit"] + ") GROUP BY ALL"
