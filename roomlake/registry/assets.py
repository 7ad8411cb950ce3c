"""Queries on assets, models and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets, room
from ..sources.carriers import carrier, duck
from .points import fit_sql



def _r(*names: str, places: int = 5) -> list:
    return [(F.round(n, places) + 0.0).alias(n) for n in names]


def size_groups(spark: SparkSession, sf: str) -> DataFrame:
    return assets.size_groups(carrier(spark, sf, "placed"), ["scene", "label"])


def asset_reps(spark: SparkSession, sf: str) -> DataFrame:
    placed = carrier(spark, sf, "placed")
    return assets.representatives(assets.size_groups(placed, ["scene", "label"]), placed, ["scene", "label", "seed"])


def asset_fit(spark: SparkSession, sf: str) -> DataFrame:
    placed = carrier(spark, sf, "placed")
    members = asset_reps(spark, sf).select("inst_id", "rep").join(placed.select("inst_id", "w", "h", "d"), "inst_id").withColumn("source", F.lit("scan-dense"))
    b = placed.select(F.col("inst_id").alias("rep"), (-F.col("w") / 2).alias("lo_x"), (F.col("w") / 2).alias("hi_x"), F.lit(-0.1).alias("lo_y"), (F.col("h") - 0.1).alias("hi_y"), (-F.col("d") / 3).alias("lo_z"), (F.col("d") / 1.5).alias("hi_z"))
    return assets.fit_to_member(members, b)


def _descriptors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.expr("vec_id div 64").alias("scene"), "label", F.transform(e, lambda x: x.cast("double")).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    d = d.withColumn("hist", F.transform("v", lambda x: x / size))
    return d.select(
        F.col("vec_id"), "scene", "label", F.when(F.col("vec_id") % 17 != 0, F.col("hist")).alias("hist"), F.transform("v", lambda x, i: F.pmod(F.floor(x * 1000) + i, F.lit(256)).cast("double")).alias("thumb"),
        F.transform("v", lambda x, i: F.pmod(i + F.floor(F.abs(x) * 10), F.lit(4)) != 0).alias("mask"), F.transform("v", lambda x, i: F.pmod(i, F.lit(5)) == 0).alias("edge"),
    )


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one label in one scene (64 vectors), as objects are compared inside a size group of their scene."""
    d = _descriptors(spark, sf)
    a = d.select(F.col("vec_id").alias("a"), "scene", "label", *[F.col(c).alias(f"{c}_a") for c in ("hist", "thumb", "mask", "edge")])
    b = d.select(F.col("vec_id").alias("b"), "scene", "label", *[F.col(c).alias(f"{c}_b") for c in ("hist", "thumb", "mask", "edge")])
    return a.join(b, ["scene", "label"]).filter("a < b").select("a", "b", assets.appearance_similarity().alias("similarity"))


def appearance_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


def visual_groups(spark: SparkSession, sf: str) -> DataFrame:
    coarse = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.expr("vec_id div 64").cast("long").alias("scene"), F.col("label").cast("long").alias("seed"), F.col("vec_id").alias("inst_id"), F.col("vec_id").alias("ord"))
    rounded = _similar(spark, sf).withColumn("similarity", F.round("similarity", 6))
    return assets.visual_groups(coarse, rounded, ["scene"], least=0.62).select("scene", F.col("coarse").alias("label"), "inst_id", F.col("seed").alias("first"), "cluster")


def fit_points_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    pts = carrier(spark, sf, "points").withColumn("inst_id", F.col("obj_id"))
    box = pts.select("inst_id").distinct().select("inst_id", ((F.col("inst_id") % 8) * 1.5 + 0.3).alias("px"), F.lit(0.0).alias("py"), (F.expr("inst_id div 8") % 5 * 1.5 + 0.25).alias("pz"), F.lit(0.0).alias("yaw"), F.lit(0.5).alias("w"), F.lit(1.5).alias("h"), F.lit(0.4).alias("d"))
    return assets.fit_points(pts, box, most=40)


def raw_scan(spark: SparkSession, sf: str) -> DataFrame:
    return assets.raw_scan(carrier(spark, sf, "points"), 2000).select("scene", "pid", "r", "g", "b")


def prefab_parts(spark: SparkSession, sf: str) -> DataFrame:
    return assets.prefab_parts(carrier(spark, sf, "placed")).groupBy("inst_id", "kind", "turned").agg(
        F.count(F.lit(1)).alias("n_parts"), F.round(F.sum(F.col("w") * F.col("h") * F.col("d")), 6).alias("volume"), F.round(F.max(F.col("y") + F.col("h") / 2), 6).alias("top")
    )


def mesh_source(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("inst_id")
    flags = {n: (k * m % q) < t for n, m, q, t in (("hires_ok", 7, 10, 3), ("dense_ok", 11, 10, 4), ("poisson_ok", 13, 10, 3), ("quality_good", 3, 10, 6), ("has_generator", 17, 10, 5), ("generated", 19, 10, 5), ("photo_ok", 23, 10, 5))}
    return assets.mesh_source(carrier(spark, sf, "placed").select("inst_id", F.when(k % 7 == 0, "plant").otherwise(F.col("label")).alias("label"), *[c.alias(n) for n, c in flags.items()]))


def box_corners(spark: SparkSession, sf: str) -> DataFrame:
    p = carrier(spark, sf, "placed")
    boxes = p.select("inst_id", F.col("px").alias("cx3"), F.col("h").alias("cy3"), F.col("pz").alias("cz3"), F.col("w").alias("sx"), F.col("h").alias("sy"), F.col("d").alias("sz"), ((F.col("inst_id") % 7) / 5.0).alias("yaw"))
    return assets.box_corners(boxes, ["inst_id"]).select("inst_id", "corner", *_r("x", "y", "z"))


def box_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = carrier(spark, sf, "placed")
    boxes = p.select("inst_id", F.col("px").alias("cx3"), F.col("h").alias("cy3"), F.col("pz").alias("cz3"), F.col("w").alias("sx"), F.col("h").alias("sy"), F.col("d").alias("sz"), ((F.col("inst_id") % 7) / 5.0).alias("yaw"))
    return assets.box_edges(boxes, ["inst_id"]).select("inst_id", "edge", *_r("x0", "y0", "z0", "x1", "y1", "z1"))


def label_palette(spark: SparkSession, sf: str) -> DataFrame:
    return assets.label_palette(carrier(spark, sf, "detections"), ["frame"])


def _mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Strips of triangles: order keys as vertices of customers' meshes, cut at every 9th."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    v = o.select(F.expr("CAST(o_custkey div 20 AS BIGINT)").alias("mesh_id"), F.col("o_orderkey").alias("vid"), ((F.col("o_orderkey") * 7 % 100) / 100.0 - 0.5).alias("x"), ((F.col("o_orderkey") * 13 % 100) / 100.0).alias("y"), ((F.col("o_orderkey") * 29 % 100) / 100.0 - 0.5).alias("z"))
    n = F.expr("row_number() over (partition by mesh_id order by vid) - 1")
    nxt = lambda k: F.expr(f"lead(vid, {k}) over (partition by mesh_id order by vid)")
    f = v.select("mesh_id", F.col("vid").alias("face_id"), n.alias("n"), F.col("vid").alias("a"), nxt(1).alias("b"), nxt(2).alias("c")).filter("c is not null and n % 9 < 5").drop("n")
    return v, f.filter("mesh_id % 3 > 0 or face_id % 7 > 0")


def crop_faces(spark: SparkSession, sf: str) -> DataFrame:
    v, f = _mesh(spark, sf)
    boxes = v.select("mesh_id").distinct().select("mesh_id", F.lit(0.8).alias("w"), F.lit(0.9).alias("h"), F.lit(0.85).alias("d"))
    return assets.crop_faces(v, f, boxes, least=2)


def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    return assets.largest_component(_mesh(spark, sf)[1], ["mesh_id"])


def carve_shell(spark: SparkSession, sf: str) -> DataFrame:
    rooms = carrier(spark, sf, "points").select("scene").distinct().select("scene", *[F.lit(v).alias(k) for k, v in (("xmin", 0.0), ("xmax", 11.1), ("zmin", 0.0), ("zmax", 6.5), ("height", 2.0))])
    return assets.carve_shell(carrier(spark, sf, "points").select("scene", F.col("pid").alias("face_id"), "x", "y", "z"), rooms, 0.25)


def wall_patches(spark: SparkSession, sf: str) -> DataFrame:
    rooms = carrier(spark, sf, "mask_cells").select((F.expr("mask_id div 4")).alias("scene")).distinct().select("scene", *[F.lit(v).alias(k) for k, v in (("xmin", 0.0), ("xmax", 3.2), ("zmin", -1.0), ("zmax", 2.2), ("height", 2.0))])
    rects = room.mask_rectangles(carrier(spark, sf, "mask_cells"), ["mask_id"]).withColumns({"scene": F.expr("mask_id div 4"), "wall": F.col("mask_id") % 4})
    return assets.wall_patches(rects, room.walls_of(rooms)).select("scene", "wall", *_r("u", "y", "across", "du", "dy"))


def photo_texture(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _mesh(spark, sf)
    rows = v.select("mesh_id", "vid", (F.col("x") * 500 + 200).alias("pu"), (F.col("y") * 400 - 10).alias("pv"), (F.col("vid") % 10 < 3 + F.col("mesh_id") % 7).alias("seen"))
    return assets.photo_texture(rows, 480, 360).select("mesh_id", "vid", *_r("tu", "tv"))


def local_mesh(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _mesh(spark, sf)
    sizes = v.select("mesh_id").distinct().select("mesh_id", F.lit(1.2).alias("w"), F.lit(0.7).alias("h"), F.lit(0.6).alias("d"))
    return assets.local_mesh(v, sizes).select("mesh_id", "vid", *_r("x", "y", "z"))


def model_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Each object's points, in its own frame, against the corners and faces of a box of its size."""
    pts = carrier(spark, sf, "points").select("obj_id", F.struct((F.col("x") - F.col("obj_id") % 8 * 1.5 - 0.3).alias("x"), "y", (F.col("z") - F.expr("obj_id div 8") % 5 * 1.5 - 0.25).alias("z")).alias("p"))
    scans = pts.groupBy(F.col("obj_id").alias("inst_id")).agg(F.sort_array(F.collect_list("p")).alias("points")).select("inst_id", F.lit(0.6).alias("w"), F.lit(2.0).alias("h"), F.lit(0.5).alias("d"), F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"])).alias("points"))
    steps = [i / 5 for i in range(6)]
    cube = [[a, b, c] for a in steps for b in steps for c in steps if a in (0, 1) or c in (0, 1)]
    surface = scans.select("inst_id").withColumn("surface", F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in cube]))
    return assets.fit_models(scans, surface)


def level_rotations(spark: SparkSession, sf: str) -> DataFrame:
    tilted = carrier(spark, sf, "points").withColumn("y", F.col("y") * 0.05 + F.col("x") * 0.1)
    ups = tilted.select("scene").distinct().select("scene", F.lit(0.0).alias("ux"), F.lit(1.0).alias("uy"), F.lit(0.0).alias("uz"), F.lit(True).alias("trusted"))
    return assets.level_rotations(tilted, ups)


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY w * h * d DESC, inst_id) - 1 AS rank FROM placed)"
_ACCEPT = "ac AS (SELECT p.scene, p.label, p.inst_id AS earlier, q.inst_id AS later FROM ranked p JOIN ranked q ON p.scene = q.scene AND p.label = q.label AND p.rank < q.rank AND abs(q.w - p.w) / p.w <= 0.15 AND abs(q.h - p.h) / p.h <= 0.15 AND abs(q.d - p.d) / p.d <= 0.15)"
_GROUPS = f"{_RANKED}, {_ACCEPT}, {fit_sql('ranked', 'ac', 'scene, label', 'inst_id', True)}"
_REPS = f"{_GROUPS}, rp AS (SELECT g.scene, g.label, g.seed, g.inst_id, first_value(g.inst_id) OVER (PARTITION BY g.scene, g.label, g.seed ORDER BY p.frames_seen DESC, p.score DESC, p.n_points DESC, g.inst_id) AS rep FROM placed_ g JOIN placed p ON p.inst_id = g.inst_id)"
_SIM = """d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS hist, list_transform(v, lambda x, i: (((CAST(floor(x * 1000) AS BIGINT) + i - 1) % 256) + 256) % 256) AS thumb,
  list_transform(v, lambda x, i: (i - 1 + CAST(floor(abs(x) * 10) AS BIGINT)) % 4 <> 0) AS mask, list_transform(v, lambda x, i: (i - 1) % 5 = 0) AS edge FROM d),
pz AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, a.hist AS ha, b.hist AS hb, list_zip(a.thumb, b.thumb, a.mask, b.mask, a.edge, b.edge) AS z FROM e a JOIN e b ON a.vec_id // 64 = b.vec_id // 64 AND a.label = b.label AND a.vec_id < b.vec_id),
q AS (SELECT a, b, label, a % 17 = 0 OR b % 17 = 0 AS none, list_dot_product(ha, hb) AS color, len(list_filter(z, lambda t: t[3] OR t[4])) AS un, len(list_filter(z, lambda t: t[3] AND t[4])) AS it,
  coalesce(list_sum(list_transform(list_filter(z, lambda t: t[3] OR t[4]), lambda t: abs(t[1] - t[2]))), 0) AS gap, len(list_filter(z, lambda t: t[5] OR t[6])) AS eu, len(list_filter(z, lambda t: t[5] AND t[6])) AS ei FROM pz),
sim AS (SELECT a, b, label, round(CASE WHEN none OR un = 0 THEN 0 ELSE least(greatest(0.40::DOUBLE * least(greatest(color, 0), 1) + 0.25::DOUBLE * (1 - gap / un / 255) + 0.20::DOUBLE * it / un + 0.15::DOUBLE * CASE WHEN eu > 0 THEN ei / eu ELSE 1 END, 0), 1) END, 6) AS similarity FROM q)"""
_KIND = "CASE label WHEN 'server rack' THEN 'rack' WHEN 'table' THEN 'desk' ELSE label END"
_MESH = """v AS (SELECT CAST(o_custkey // 20 AS BIGINT) AS mesh_id, o_orderkey AS vid, (o_orderkey * 7 % 100) / 100.0::DOUBLE - 0.5::DOUBLE AS x, (o_orderkey * 13 % 100) / 100.0::DOUBLE AS y, (o_orderkey * 29 % 100) / 100.0::DOUBLE - 0.5::DOUBLE AS z FROM orders),
f0 AS (SELECT mesh_id, vid AS face_id, row_number() OVER k - 1 AS n, vid AS a, lead(vid, 1) OVER k AS b, lead(vid, 2) OVER k AS c FROM v WINDOW k AS (PARTITION BY mesh_id ORDER BY vid)),
fc AS (SELECT mesh_id, face_id, a, b, c FROM f0 WHERE c IS NOT NULL AND n % 9 < 5 AND (mesh_id % 3 > 0 OR face_id % 7 > 0))"""

QUERIES = {f.__name__: f for f in (
    size_groups, asset_reps, asset_fit, appearance_similarity, visual_groups, fit_points_dedupe, raw_scan, prefab_parts, mesh_source, box_corners, box_edges, label_palette, crop_faces, largest_component,
    carve_shell, wall_patches, photo_texture, local_mesh, model_fit, level_rotations,
)}
ORACLES = {
    "size_groups": duck("placed", f"{_GROUPS} SELECT scene, label, inst_id, seed, cluster FROM placed_"),
    "asset_reps": duck("placed", f"{_REPS} SELECT * FROM rp"),
    "asset_fit": duck("placed", f"""{_REPS},
j AS (SELECT m.inst_id, m.w, m.h, m.d, rp.rep, r.w AS rw, r.h AS rh, r.d AS rd FROM rp JOIN placed m ON m.inst_id = rp.inst_id JOIN placed r ON r.inst_id = rp.rep)
SELECT inst_id, CASE WHEN inst_id = rep THEN 'scan-dense' ELSE 'reuse:scan-dense' END AS source, CASE WHEN inst_id <> rep THEN rep END AS reuse_of, CASE WHEN inst_id <> rep THEN round(-((-rw / 2) + rw / 2) / 2, 5) END AS ox, CASE WHEN inst_id <> rep THEN round(0.1::DOUBLE, 5) END AS oy,
  CASE WHEN inst_id <> rep THEN round(-((-rd / 3) + rd / 1.5::DOUBLE) / 2, 5) END AS oz, CASE WHEN inst_id <> rep THEN round(w / greatest(rw / 2 + rw / 2, 1e-6), 5) END AS mx, CASE WHEN inst_id <> rep THEN round(h / greatest((rh - 0.1::DOUBLE) + 0.1::DOUBLE, 1e-6), 5) END AS my, CASE WHEN inst_id <> rep THEN round(d / greatest(rd / 1.5::DOUBLE + rd / 3, 1e-6), 5) END AS mz FROM j"""),
    "appearance_similarity": "WITH " + _SIM + " SELECT a, b, similarity FROM sim",
    "visual_groups": "WITH RECURSIVE " + _SIM + f""",
ranked AS (SELECT vec_id // 64 AS scene, CAST(label AS BIGINT) AS label, vec_id AS inst_id, row_number() OVER (PARTITION BY vec_id // 64, label ORDER BY vec_id) - 1 AS rank FROM embeddings),
ac AS (SELECT a // 64 AS scene, CAST(label AS BIGINT) AS label, a AS earlier, b AS later FROM sim WHERE similarity >= 0.62), {fit_sql('ranked', 'ac', 'scene, label', 'inst_id', False)} SELECT scene, label, inst_id, seed AS first, cluster FROM placed_""",
    "fit_points_dedupe": duck("points", """b AS (SELECT obj_id AS inst_id, pid, x - ((obj_id % 8) * 1.5::DOUBLE + 0.3::DOUBLE) AS lx, y AS ly, z - ((obj_id // 8) % 5 * 1.5::DOUBLE + 0.25::DOUBLE) AS lz FROM points),
n AS (SELECT * FROM b WHERE abs(lx) <= 0.5::DOUBLE * (0.5::DOUBLE + 0.15::DOUBLE) AND ly >= -0.10::DOUBLE * 1.5::DOUBLE AND ly <= 1.10::DOUBLE * 1.5::DOUBLE AND abs(lz) <= 0.4::DOUBLE * (0.5::DOUBLE + 0.15::DOUBLE)),
vx AS (SELECT *, greatest(sqrt(0.5::DOUBLE * 0.5::DOUBLE + 1.5::DOUBLE * 1.5::DOUBLE + 0.4::DOUBLE * 0.4::DOUBLE) / 70, 1e-5) AS s FROM n),
f AS (SELECT * FROM vx QUALIFY row_number() OVER (PARTITION BY inst_id, floor(lx / s), floor(ly / s), floor(lz / s) ORDER BY pid) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY inst_id) AS n FROM f)
SELECT inst_id, pid, round(lx, 4) AS lx, round(ly, 4) AS ly, round(lz, 4) AS lz FROM c WHERE n <= 40 OR i IN (SELECT k * (c.n - 1) // 39 FROM range(0, 40) t(k))"""),
    "raw_scan": duck("points", "n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM points) SELECT scene, pid, r, g, b FROM n WHERE n <= 2000 OR i IN (SELECT k * (n.n - 1) // 1999 FROM range(0, 2000) t(k))"),
    "mesh_source": duck("placed", """f AS (SELECT inst_id AS k, inst_id % 7 <> 0 AS known FROM placed),
s AS (SELECT k, known, CASE WHEN k * 7 % 10 < 3 THEN 'scan-hires' WHEN k * 11 % 10 < 4 THEN 'scan-dense' WHEN k * 13 % 10 < 3 THEN 'scan-poisson' END AS scan, CASE WHEN known THEN 'prefab' ELSE 'box' END AS st FROM f),
c AS (SELECT k, CASE WHEN scan IS NULL THEN st WHEN k * 3 % 10 < 6 THEN scan WHEN k * 17 % 10 < 5 OR known THEN st ELSE 'scan-low-support' END AS src FROM s),
m AS (SELECT k, CASE WHEN src IN ('prefab', 'box') AND k * 19 % 10 < 5 THEN 'trellis' ELSE src END AS src FROM c)
SELECT k AS inst_id, CASE WHEN src LIKE 'scan-%' AND k * 23 % 10 < 5 THEN src || '+photo' ELSE src END AS source FROM m"""),
    "box_corners": duck("placed", """k AS (SELECT k, CASE WHEN k & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS a, CASE WHEN (k >> 1) & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS b, CASE WHEN (k >> 2) & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS c FROM range(0, 8) t(k)),
p AS (SELECT *, (inst_id % 7) / 5.0::DOUBLE AS yaw FROM placed)
SELECT inst_id, k AS corner, round(px + cos(yaw) * a * w + sin(yaw) * c * d, 5) AS x, round(h + b * h, 5) AS y, round(pz - sin(yaw) * a * w + cos(yaw) * c * d, 5) AS z FROM p, k"""),
    "box_edges": duck("placed", """p AS (SELECT *, (inst_id % 7) / 5.0::DOUBLE AS yaw FROM placed),
k AS (SELECT inst_id, k, px + cos(yaw) * a * w + sin(yaw) * c * d AS x, h + b * h AS y, pz - sin(yaw) * a * w + cos(yaw) * c * d AS z
  FROM p, (SELECT k, CASE WHEN k & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS a, CASE WHEN (k >> 1) & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS b, CASE WHEN (k >> 2) & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS c FROM range(0, 8) t(k))),
e AS (SELECT row_number() OVER (ORDER BY bit, k) - 1 AS edge, k AS f, k + (1 << bit) AS t FROM range(0, 3) b(bit), range(0, 8) c(k) WHERE (k >> bit) & 1 = 0)
SELECT m.inst_id, edge, round(m.x, 5) AS x0, round(m.y, 5) AS y0, round(m.z, 5) AS z0, round(n.x, 5) AS x1, round(n.y, 5) AS y1, round(n.z, 5) AS z1 FROM e JOIN k m ON m.k = f JOIN k n ON n.k = t AND n.inst_id = m.inst_id"""),
    "prefab_parts": duck("placed", f"""b AS (SELECT inst_id, {_KIND} AS kind, w, h, d, greatest(floor(h / 0.12::DOUBLE), 4) AS n, least(w, d) * 0.06::DOUBLE AS leg, least(0.04::DOUBLE * h / 0.75::DOUBLE, h * 0.2::DOUBLE) AS top FROM placed)
SELECT inst_id, kind, kind = 'rack' AND w > d AS turned, CASE kind WHEN 'rack' THEN 3 + CAST(n AS BIGINT) WHEN 'desk' THEN 5 WHEN 'monitor' THEN 3 ELSE 4 END AS n_parts, round(CASE kind
  WHEN 'rack' THEN w * h * 0.985::DOUBLE * d + w * h * 0.015::DOUBLE * d + w * 0.92::DOUBLE * h * 0.9::DOUBLE * d * 0.02::DOUBLE + n * (w * 0.8::DOUBLE * h * 0.012::DOUBLE * d * 0.005::DOUBLE)
  WHEN 'desk' THEN w * top * d + 4 * leg * leg * (h - top)
  WHEN 'monitor' THEN w * h * 0.7::DOUBLE * greatest(d * 0.15::DOUBLE, 0.01) + w * 0.12::DOUBLE * h * 0.25::DOUBLE * greatest(d * 0.3::DOUBLE, 0.02) + w * 0.45::DOUBLE * h * 0.04::DOUBLE * greatest(d * 0.8::DOUBLE, 0.04)
  ELSE w * h * 0.06::DOUBLE * d + w * h * 0.5::DOUBLE * d * 0.12::DOUBLE + w * 0.1::DOUBLE * h * 0.45::DOUBLE * w * 0.1::DOUBLE + w * 0.9::DOUBLE * h * 0.03::DOUBLE * d * 0.9::DOUBLE END, 6) AS volume,
  round(CASE kind WHEN 'chair' THEN h * 0.98::DOUBLE ELSE h END, 6) AS top FROM b"""),
    "label_palette": duck("detections", "SELECT frame, label, (dense_rank() OVER (PARTITION BY frame ORDER BY label) - 1) % 10 AS color FROM (SELECT DISTINCT frame, label FROM detections)"),
    "crop_faces": f"""WITH {_MESH},
i AS (SELECT mesh_id, vid FROM v WHERE abs(x) <= 0.8::DOUBLE / 2 * 1.15::DOUBLE AND y >= -0.9::DOUBLE * ((1.15::DOUBLE - 1) / 2) AND y <= 0.9::DOUBLE * (1 + (1.15::DOUBLE - 1) / 2) AND abs(z) <= 0.85::DOUBLE / 2 * 1.15::DOUBLE),
w AS (SELECT mesh_id, face_id FROM fc WHERE (mesh_id, a) IN (SELECT (mesh_id, vid) FROM i) AND (mesh_id, b) IN (SELECT (mesh_id, vid) FROM i) AND (mesh_id, c) IN (SELECT (mesh_id, vid) FROM i))
SELECT mesh_id, face_id FROM w QUALIFY count(*) OVER (PARTITION BY mesh_id) >= 2""",
    "largest_component": f"""WITH RECURSIVE {_MESH},
ed AS (SELECT mesh_id, a AS p, b AS q FROM fc UNION SELECT mesh_id, b, a FROM fc UNION SELECT mesh_id, b, c FROM fc UNION SELECT mesh_id, c, b FROM fc UNION SELECT mesh_id, a, c FROM fc UNION SELECT mesh_id, c, a FROM fc),
re AS (SELECT DISTINCT mesh_id, p AS vid, p AS lab FROM ed UNION SELECT re.mesh_id, ed.q, re.lab FROM re JOIN ed ON ed.mesh_id = re.mesh_id AND ed.p = re.vid WHERE re.lab < ed.q),
lb AS (SELECT mesh_id, vid, min(lab) AS lab FROM re GROUP BY mesh_id, vid),
ow AS (SELECT fc.mesh_id, face_id, lab FROM fc JOIN lb ON lb.mesh_id = fc.mesh_id AND lb.vid = fc.a),
sz AS (SELECT mesh_id, lab, count(*) AS n FROM ow GROUP BY mesh_id, lab QUALIFY row_number() OVER (PARTITION BY mesh_id ORDER BY count(*) DESC, lab) = 1)
SELECT mesh_id, face_id FROM ow SEMI JOIN sz USING (mesh_id, lab)""",
    "carve_shell": duck("points", "SELECT scene, pid AS face_id FROM points WHERE NOT (x <= 0.25 OR x >= 11.1::DOUBLE - 0.25 OR z <= 0.25 OR z >= 6.25 OR y <= 0.25 OR y >= 1.75)"),
    "wall_patches": duck("mask_cells", """ru AS (SELECT mask_id, iy, min(ix) AS u0, max(ix) + 1 AS u1 FROM (SELECT *, ix - row_number() OVER (PARTITION BY mask_id, iy ORDER BY ix) AS k FROM mask_cells) GROUP BY mask_id, iy, k),
rc AS (SELECT mask_id, min(iy) AS y0, max(iy) + 1 AS y1, u0, u1 FROM (SELECT *, iy - row_number() OVER (PARTITION BY mask_id, u0, u1 ORDER BY iy) AS k FROM ru) GROUP BY mask_id, u0, u1, k),
wl AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, -1.0::DOUBLE, -1.0::DOUBLE, 2.2::DOUBLE), (1, 3.2, 1.0, -1.0, 2.2), (2, -1.0, -1.0, 0.0, 3.2), (3, 2.2, 1.0, 0.0, 3.2)) t(wall, plane, sign, u_min, u_max))
SELECT mask_id // 4 AS scene, mask_id % 4 AS wall, round(u_min + (u0 + u1) / 2 * (u_max - u_min) / ceil((u_max - u_min) / 0.2::DOUBLE), 5) AS u, round((y0 + y1) / 2 * 0.2::DOUBLE, 5) AS y, round(plane + sign * 0.02::DOUBLE, 5) AS across, round((u1 - u0) * (u_max - u_min) / ceil((u_max - u_min) / 0.2::DOUBLE), 5) AS du, round((y1 - y0) * 0.2::DOUBLE, 5) AS dy
FROM rc JOIN wl ON wl.wall = mask_id % 4"""),
    "photo_texture": f"""WITH {_MESH}, s AS (SELECT mesh_id FROM v GROUP BY mesh_id HAVING avg(CAST(vid % 10 < 3 + mesh_id % 7 AS INT)) >= 0.6)
SELECT mesh_id, vid, round(least(greatest((x * 500 + 200) / 479, 0), 1), 5) AS tu, round(least(greatest(1 - (y * 400 - 10) / 359, 0), 1), 5) AS tv FROM v SEMI JOIN s USING (mesh_id)""".replace("least(greatest(1 - (y * 400 - 10) / 359, 0), 1)", "1 - least(greatest((y * 400 - 10) / 359, 0), 1)"),
    "local_mesh": f"""WITH {_MESH}, b AS (SELECT mesh_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM v GROUP BY mesh_id HAVING max(x) - min(x) > 1e-6 AND max(y) - min(y) > 1e-6 AND max(z) - min(z) > 1e-6)
SELECT mesh_id, vid, round(((x - lx) / (hx - lx) - 0.5) * 1.2::DOUBLE, 5) AS x, round((y - ly) / (hy - ly) * 0.7::DOUBLE, 5) AS y, round(((z - lz) / (hz - lz) - 0.5) * 0.6::DOUBLE, 5) AS z FROM v JOIN b USING (mesh_id)""",
}
