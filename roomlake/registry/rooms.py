"""Queries on rooms, walls, grids and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets, room
from ..sources.carriers import carrier, duck


def _r(*names: str, places: int = 6) -> list:
    return [(F.round(n, places) + 0.0).alias(n) for n in names]


#: Added before rounding weighted means of lattice values, which may end in a 5 just behind the last digit.
TIE = 1.23e-8


def _rgb(places: int = 5) -> list:
    return [F.round(F.col(c) + TIE, places).alias(c) for c in "rgb"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "points")


def _rooms(spark: SparkSession, sf: str) -> DataFrame:
    """A room inside each scene's cloud, so that some points lie beyond its walls."""
    at = {"xmin": 1.0, "xmax": 9.0, "zmin": 1.0, "zmax": 5.0, "height": 2.0}
    return _points(spark, sf).select("scene").distinct().select("scene", *[F.lit(v).alias(k) for k, v in at.items()])


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return _rooms(spark, sf).select("scene", F.lit(0.0).alias("floor_y"), F.lit(1.9).alias("ceil_y"), "height")


def _rays(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).withColumns({"cam_x": 5 + F.col("frame") / 10.0, "cam_y": F.lit(1.5), "cam_z": 3 + F.col("frame") / 20.0})


def principal_yaw(spark: SparkSession, sf: str) -> DataFrame:
    return room.principal_yaw(_points(spark, sf), ["obj_id"]).select("obj_id", *_r("yaw", "ratio", places=5))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    labels = _points(spark, sf).select("obj_id").distinct().withColumn("label", F.expr("CASE obj_id % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END"))
    return room.place_instances(_points(spark, sf), labels, ["obj_id"], 0.01, 0.02)


def placement(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).select("obj_id", *_r("px", "py", "pz", "yaw", "w", "h", "d", places=5))


def rack_scale(spark: SparkSession, sf: str) -> DataFrame:
    return room.rack_scale(carrier(spark, sf, "placed").filter("h > 0")).select("scene", *_r("scale"), "metric")


def min_area_yaw(spark: SparkSession, sf: str) -> DataFrame:
    tilted = _points(spark, sf).withColumns({"x": F.col("x") * 0.8 - F.col("z") * 0.6, "z": F.col("x") * 0.6 + F.col("z") * 0.8})
    return room.min_area_yaw(tilted).select("scene", *_r("yaw"))


def room_rect(spark: SparkSession, sf: str) -> DataFrame:
    heights = _rooms(spark, sf).select("scene", "height")
    return room.fit_room_rect(_points(spark, sf), heights).select("scene", *_r("xmin", "xmax", "zmin", "zmax"))


def surface_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return room.surface_coverage(_points(spark, sf), _rooms(spark, sf))


def horizontal_infill(spark: SparkSession, sf: str) -> DataFrame:
    return room.horizontal_infill(_points(spark, sf), _rooms(spark, sf), least=1)


def ceiling_support(spark: SparkSession, sf: str) -> DataFrame:
    return room.ceiling_support(_points(spark, sf), _levels(spark, sf))


def surface_color(spark: SparkSession, sf: str) -> DataFrame:
    return room.level_colors(_points(spark, sf), _levels(spark, sf))


def wall_specs(spark: SparkSession, sf: str) -> DataFrame:
    return room.walls_of(_rooms(spark, sf)).select("scene", "wall", "along_x", "plane", "sign", "u_min", "u_max", "ny", "nu")


def wall_ray_cells(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for mode in ("occluded", "through", "opening"):
        part = room.ray_wall_cells(_rays(spark, sf), _rooms(spark, sf), mode).select(F.lit(mode).alias("mode"), "scene", "pid", "wall", "iy", "iu")
        out = part if out is None else out.unionAll(part)
    return out


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    rays = _rays(spark, sf)
    return room.wall_evidence(_points(spark, sf), rays.filter("pid % 2 = 0"), rays.filter("pid % 2 = 1"), rays.filter("obj_id % 10 = 3"), _rooms(spark, sf))


def wall_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf)


def wall_plane_supported(spark: SparkSession, sf: str) -> DataFrame:
    return room.plane_supported(_evidence(spark, sf))


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    """Full 10 x 16 grids with evidence from the mask cells."""
    cells = carrier(spark, sf, "mask_cells")
    full = cells.select("mask_id").distinct().withColumn("iy", F.explode(F.expr("sequence(0L, 9L)"))).withColumn("iu", F.explode(F.expr("sequence(0L, 15L)")))
    seen = full.join(cells.select("mask_id", "iy", F.col("ix").alias("iu"), F.lit(True).alias("hit")), ["mask_id", "iy", "iu"], "left")
    hit = F.coalesce("hit", F.lit(False))
    return seen.select(
        "mask_id", "iy", "iu", (hit & (F.col("iu") < 4) & (F.col("iy") % 3 == 0)).alias("observed"), ((hit & (F.col("iu") == 13) & (F.col("iy") > 6)).cast("long")).alias("occluded_views"),
        F.when((F.col("mask_id") % 3 == 0) & (F.col("iu") == 8) & ((F.col("iy") != 4) | (F.col("mask_id") % 2 == 0)), 3).otherwise(0).cast("long").alias("through_views"), ((F.col("mask_id") % 5 == 0) & (F.col("iu") == 6) & (F.col("iy") < 5)).alias("opening"),
    )


def wall_fill(spark: SparkSession, sf: str) -> DataFrame:
    return room.wall_fill(_grids(spark, sf), ["mask_id"])


def color_field_observed(spark: SparkSession, sf: str) -> DataFrame:
    rooms = _rooms(spark, sf).withColumn("height", F.lit(2.0))
    return room.wall_colors(_wide(spark, sf), rooms, least=1).select("scene", "wall", "iy", "iu", *_r("r", "g", "b"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Points pressed onto the wall x = 1 where they are close to it."""
    return _points(spark, sf).withColumn("x", F.when(F.col("x") < 2.5, 1.0).otherwise(F.col("x")))


def color_field_filled(spark: SparkSession, sf: str) -> DataFrame:
    rooms = _rooms(spark, sf)
    seen = room.wall_colors(_wide(spark, sf), rooms, least=1)
    grid = room.walls_of(rooms).withColumn("iy", F.explode(F.expr("sequence(0L, ny - 1)"))).withColumn("iu", F.explode(F.expr("sequence(0L, nu - 1)"))).select("scene", "wall", "iy", "iu")
    return room.fill_colors(seen, grid, ["scene", "wall"]).select("scene", "wall", "iy", "iu", "observed", *_rgb())


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """Points pressed onto the floor where they are close to it, and the rest of the upper half onto the ceiling."""
    return _points(spark, sf).withColumn("y", F.when(F.col("y") < 0.9, 0.0).when(F.col("y") > 1.2, 2.0).otherwise(F.col("y")))


def horizontal_color_observed(spark: SparkSession, sf: str) -> DataFrame:
    return room.horizontal_colors(_flat(spark, sf), _rooms(spark, sf), least=1).select("scene", "surface", "iz", "ix", *_r("r", "g", "b"))


def _horizontal_filled(spark: SparkSession, sf: str) -> DataFrame:
    seen = room.horizontal_colors(_flat(spark, sf), _rooms(spark, sf), least=1).withColumnsRenamed({"iz": "iy", "ix": "iu"})
    planes = room.horizontal_planes(_rooms(spark, sf))
    grid = planes.withColumn("iy", F.explode(F.expr("sequence(0L, nz - 1)"))).withColumn("iu", F.explode(F.expr("sequence(0L, nx - 1)")))
    return room.fill_colors(seen, grid, ["scene", "surface"]).withColumnsRenamed({"iy": "iz", "iu": "ix"})


def horizontal_color_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _horizontal_filled(spark, sf).select("scene", "surface", "iz", "ix", "observed", *_rgb())


def horizontal_patches(spark: SparkSession, sf: str) -> DataFrame:
    holes = room.horizontal_infill(_flat(spark, sf), _rooms(spark, sf), least=1).filter("fill").select("scene", "surface", F.col("iz").alias("iy"), "ix")
    rects = room.mask_rectangles(holes, ["scene", "surface"])
    return assets.horizontal_patches(rects, _rooms(spark, sf)).select("scene", "surface", *_r("x", "y", "z", "dx", "dz"))


def colored_patches(spark: SparkSession, sf: str) -> DataFrame:
    cells = _horizontal_filled(spark, sf).filter("not observed")
    return assets.colored_patches(cells, _rooms(spark, sf)).select("scene", "surface", "iz", "ix", "corner", *_r("x", "y", "z", places=5), *_rgb())


def mask_dilate(spark: SparkSession, sf: str) -> DataFrame:
    cells = carrier(spark, sf, "mask_cells")
    cross = room.dilate(cells, ["mask_id"], (10, 16), box=False).withColumn("kind", F.lit("cross"))
    return cross.unionByName(room.dilate(cells, ["mask_id"], (10, 16), box=True, reach=2).withColumn("kind", F.lit("box5")))


def mask_resize(spark: SparkSession, sf: str) -> DataFrame:
    return room.resize_nearest(carrier(spark, sf, "mask_cells"), ["mask_id"], (10, 16), (7, 25))


def mask_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    wide = room.dilate(carrier(spark, sf, "mask_cells"), ["mask_id"], (10, 16), box=False)
    return room.mask_rectangles(wide, ["mask_id"])


_ROOM = "rm AS (SELECT DISTINCT scene, 1.0::DOUBLE AS xmin, 9.0::DOUBLE AS xmax, 1.0::DOUBLE AS zmin, 5.0::DOUBLE AS zmax, 2.0::DOUBLE AS height FROM points)"
_WALL = f"""{_ROOM},
wl AS (SELECT scene, height, least(xmax - xmin, zmax - zmin) AS ms, w.wall, w.ax AS along_x, w.plane, w.sign, w.u0 AS u_min, w.u1 AS u_max,
  CAST(least(greatest(ceil((w.u1 - w.u0) / 0.2::DOUBLE), 1), 96) AS BIGINT) AS nu, CAST(least(greatest(ceil(height / 0.2::DOUBLE), 1), 64) AS BIGINT) AS ny
  FROM rm, LATERAL (VALUES (0::BIGINT, false, xmin, -1.0::DOUBLE, zmin, zmax), (1, false, xmax, 1.0, zmin, zmax), (2, true, zmin, -1.0, xmin, xmax), (3, true, zmax, 1.0, xmin, xmax)) w(wall, ax, plane, sign, u0, u1))"""
_CELL = "CAST(least(floor((u - u_min) / greatest(u_max - u_min, 1e-9) * nu), nu - 1) AS BIGINT) AS iu, CAST(least(floor(y / greatest(height, 1e-9) * ny), ny - 1) AS BIGINT) AS iy"
_NEAR = f"""nr AS (SELECT p.*, {_CELL}, wall, height FROM (SELECT p.pid, p.frame, p.y, p.r, p.g, p.b, wl.*, CASE WHEN along_x THEN p.z ELSE p.x END AS pa, CASE WHEN along_x THEN p.x ELSE p.z END AS u FROM {{src}} p JOIN wl ON p.scene = wl.scene) p
  WHERE abs(pa - plane) <= greatest(0.04, 0.025::DOUBLE * greatest(ms, 1e-6)) AND u BETWEEN u_min AND u_max AND y BETWEEN 0 AND height)"""
_RAYS = f"""ry AS (SELECT *, CASE WHEN along_x THEN cz ELSE cx END AS ca, CASE WHEN along_x THEN z ELSE x END AS pa FROM (SELECT p.pid, p.obj_id, p.frame, p.x, p.y, p.z, 5 + p.frame / 10.0::DOUBLE AS cx, 1.5::DOUBLE AS cy, 3 + p.frame / 20.0::DOUBLE AS cz, wl.* FROM points p JOIN wl ON p.scene = wl.scene)),
rt AS (SELECT *, (plane - ca) / (pa - ca) AS t FROM ry WHERE abs(pa - ca) > 1e-8 AND sign * (ca - plane) < 0.05),
rm2 AS (SELECT rt.*, m.mode FROM rt, (VALUES ('occluded'), ('through'), ('opening')) m(mode) WHERE (mode = 'occluded' AND t > 1.02) OR (mode = 'through' AND t > 0 AND t < 0.98 AND sign * (pa - plane) > 0.05) OR (mode = 'opening' AND t > 0)),
rc AS (SELECT mode, scene, pid, obj_id, frame, wall, {_CELL} FROM (SELECT mode, scene, pid, obj_id, frame, wall, u_min, u_max, nu, ny, height, CASE WHEN along_x THEN cx + t * (x - cx) ELSE cz + t * (z - cz) END AS u, cy + t * (y - cy) AS y FROM rm2) WHERE u BETWEEN u_min AND u_max AND y BETWEEN 0 AND height)"""
_EVID = f"""{_WALL}, {_NEAR.format(src='points')}, {_RAYS},
ob AS (SELECT DISTINCT scene, wall, iy, iu FROM nr WHERE y >= 0.05 * height AND y <= 0.95 * height),
oc AS (SELECT scene, wall, iy, iu, count(DISTINCT frame) AS n FROM rc WHERE mode = 'occluded' AND pid % 2 = 0 GROUP BY ALL),
th AS (SELECT scene, wall, iy, iu, count(DISTINCT frame) AS n FROM rc WHERE mode = 'through' AND pid % 2 = 1 GROUP BY ALL),
op AS (SELECT DISTINCT scene, wall, iy, iu FROM rc WHERE mode = 'opening' AND obj_id % 10 = 3),
al AS (SELECT scene, wall, iy, iu FROM ob UNION SELECT scene, wall, iy, iu FROM oc UNION SELECT scene, wall, iy, iu FROM th UNION SELECT scene, wall, iy, iu FROM op),
ev AS (SELECT al.*, ob.iy IS NOT NULL AS observed, coalesce(oc.n, 0) AS occluded_views, coalesce(th.n, 0) AS through_views, op.iy IS NOT NULL AS opening FROM al
  LEFT JOIN ob ON al.scene = ob.scene AND al.wall = ob.wall AND al.iy = ob.iy AND al.iu = ob.iu LEFT JOIN oc ON al.scene = oc.scene AND al.wall = oc.wall AND al.iy = oc.iy AND al.iu = oc.iu
  LEFT JOIN th ON al.scene = th.scene AND al.wall = th.wall AND al.iy = th.iy AND al.iu = th.iu LEFT JOIN op ON al.scene = op.scene AND al.wall = op.wall AND al.iy = op.iy AND al.iu = op.iu)"""
_YAW = """cv AS (SELECT obj_id, var_samp(x) AS a, covar_samp(x, z) AS b, var_samp(z) AS c FROM points GROUP BY obj_id),
yw AS (SELECT obj_id, CASE WHEN th >= pi() / 2 THEN th - pi() ELSE th END AS yaw, sqrt((m + r) / greatest(m - r, 1e-9)) AS ratio FROM (SELECT obj_id, atan2(2 * b, a - c) / 2 AS th, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM cv))"""
_KIND = "CASE label WHEN 'server rack' THEN 3.5 ELSE 1.0 END"
_COVER = """ff AS (SELECT p.scene, f.* FROM points p JOIN rm ON p.scene = rm.scene, LATERAL (VALUES
  ('floor', abs(p.y) <= th, p.x, xmin, xmax, p.z, zmin, zmax), ('ceiling', abs(p.y - height) <= th, p.x, xmin, xmax, p.z, zmin, zmax),
  ('wall_0', abs(p.x - xmin) <= tw AND p.y > 0.05 * height AND p.y < 0.95 * height, p.z, zmin, zmax, p.y, 0, height), ('wall_1', abs(p.x - xmax) <= tw AND p.y > 0.05 * height AND p.y < 0.95 * height, p.z, zmin, zmax, p.y, 0, height),
  ('wall_2', abs(p.z - zmin) <= tw AND p.y > 0.05 * height AND p.y < 0.95 * height, p.x, xmin, xmax, p.y, 0, height), ('wall_3', abs(p.z - zmax) <= tw AND p.y > 0.05 * height AND p.y < 0.95 * height, p.x, xmin, xmax, p.y, 0, height)) f(surface, near, a, a0, a1, b, b0, b1)
  WHERE f.near)""".replace("th,", "greatest(0.04, 0.04::DOUBLE * greatest(height, 1e-6)),").replace("<= tw", "<= greatest(0.04, 0.025::DOUBLE * greatest(least(xmax - xmin, zmax - zmin), 1e-6))")
_LEVEL = "lv AS (SELECT DISTINCT scene, 0.0::DOUBLE AS floor_y, 1.9::DOUBLE AS ceil_y, 2.0::DOUBLE AS height FROM points)"
_SIDE = lambda c, up: f"CASE WHEN nb >= 200 AND count(*) FILTER (WHERE band AND {c} {'>' if up else '<'} {c}{'h' if up else 'l'}) >= 20 THEN median(CASE WHEN band AND {c} {'>' if up else '<'} {c}{'h' if up else 'l'} THEN {c} END) ELSE any_value({c}{'x' if up else 'n'}) END"
_GRIDS = """gr AS (SELECT f.mask_id, f.iy, f.iu, c.mask_id IS NOT NULL AS hit FROM (SELECT mask_id, iy, iu FROM (SELECT DISTINCT mask_id FROM mask_cells), range(0, 10) a(iy), range(0, 16) b(iu)) f LEFT JOIN mask_cells c ON c.mask_id = f.mask_id AND c.iy = f.iy AND c.ix = f.iu),
g0 AS (SELECT mask_id, iy, iu, hit AND iu < 4 AND iy % 3 = 0 AS ob, hit AND iu = 13 AND iy > 6 AS oc, (mask_id % 3 = 0 AND iu = 8 AND (iy <> 4 OR mask_id % 2 = 0)) OR (mask_id % 5 = 0 AND iu = 6 AND iy < 5) AS op FROM gr),
mv AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(a, b)),
g1 AS (SELECT g.mask_id, g.iy, g.iu, bool_or(n.ob) AS ob, bool_or(n.oc) AS oc, bool_or(n.op) AS op FROM g0 g, mv JOIN g0 n ON n.mask_id = g.mask_id AND n.iy = g.iy + a AND n.iu = g.iu + b GROUP BY ALL),
fl AS (SELECT mask_id, iy, iu FROM g1 WHERE ob UNION SELECT g.mask_id, g.iy, g.iu FROM fl, mv JOIN g1 g ON g.mask_id = fl.mask_id AND g.iy = fl.iy + a AND g.iu = fl.iu + b WHERE NOT g.op)"""

QUERIES = {f.__name__: f for f in (
    principal_yaw, placement, rack_scale, min_area_yaw, room_rect, surface_coverage, horizontal_infill, ceiling_support, surface_color, wall_specs, wall_ray_cells, wall_evidence,
    wall_plane_supported, wall_fill, color_field_observed, color_field_filled, horizontal_color_observed, horizontal_color_filled, horizontal_patches, colored_patches, mask_dilate, mask_resize, mask_rectangles,
)}
_WIDE = "wd AS (SELECT * REPLACE (CASE WHEN x < 2.5 THEN 1.0::DOUBLE ELSE x END AS x) FROM points)"
_COLORS = f"""{_WALL}, {_WIDE}, {_NEAR.format(src='wd')},
vw AS (SELECT scene, wall, iy, iu, frame, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM nr GROUP BY ALL), cl AS (SELECT scene, wall, iy, iu, median(r) AS r, median(g) AS g, median(b) AS b FROM vw GROUP BY ALL)"""
_RUNS = """dl AS (SELECT DISTINCT mask_id, iy + a AS iy, ix + b AS ix FROM mask_cells, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(a, b) WHERE iy + a BETWEEN 0 AND 9 AND ix + b BETWEEN 0 AND 15)"""
_RGB = ", ".join(f"round({c} + {TIE}::DOUBLE, 5) AS {c}" for c in "rgb")
_RGB_MEAN = ", ".join(f"round(sum({c} * wt) / sum(wt) + {TIE}::DOUBLE, 5)" for c in "rgb")
_FLAT = "fp AS (SELECT * REPLACE (CASE WHEN y < 0.9 THEN 0.0::DOUBLE WHEN y > 1.2 THEN 2.0::DOUBLE ELSE y END AS y) FROM points)"
_PLANES = f"""{_ROOM}, {_FLAT},
sp AS (SELECT scene, xmin, xmax, zmin, zmax, height, s.surface, s.level, CAST(least(greatest(ceil((xmax - xmin) / 0.2::DOUBLE), 1), 96) AS BIGINT) AS nx, CAST(least(greatest(ceil((zmax - zmin) / 0.2::DOUBLE), 1), 96) AS BIGINT) AS nz FROM rm, LATERAL (VALUES ('floor', 0.0::DOUBLE), ('ceiling', height)) s(surface, level)),
hc AS (SELECT p.scene, surface, CAST(least(floor((x - xmin) / greatest(xmax - xmin, 1e-9) * nx), nx - 1) AS BIGINT) AS ix, CAST(least(floor((z - zmin) / greatest(zmax - zmin, 1e-9) * nz), nz - 1) AS BIGINT) AS iz, frame, r, g, b FROM fp p JOIN sp ON p.scene = sp.scene
  WHERE abs(y - level) <= greatest(0.04, 0.04::DOUBLE * greatest(height, 1e-6)) AND x BETWEEN xmin AND xmax AND z BETWEEN zmin AND zmax),
hv AS (SELECT scene, surface, iz, ix, frame, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM hc GROUP BY ALL), hl AS (SELECT scene, surface, iz, ix, median(r) AS r, median(g) AS g, median(b) AS b FROM hv GROUP BY ALL),
he AS (SELECT scene, surface, iz, ix, nx, nz, xmin, xmax, zmin, zmax, height FROM sp, LATERAL (SELECT unnest(range(0, nz)) AS iz), LATERAL (SELECT unnest(range(0, nx)) AS ix)),
hm AS (SELECT he.* FROM he ANTI JOIN hl USING (scene, surface, iz, ix)),
hn AS (SELECT hm.*, 1 / greatest(sqrt((hm.iz - hl.iz) ** 2 + (hm.ix - hl.ix) ** 2), 0.75) ** 2 AS wt, r, g, b FROM hm JOIN hl ON hm.scene = hl.scene AND hm.surface = hl.surface QUALIFY row_number() OVER (PARTITION BY hm.scene, hm.surface, hm.iz, hm.ix ORDER BY (hm.iz - hl.iz) ** 2 + (hm.ix - hl.ix) ** 2, hl.iz, hl.ix) <= 4),
hf AS (SELECT scene, surface, iz, ix, sum(r * wt) / sum(wt) AS r, sum(g * wt) / sum(wt) AS g, sum(b * wt) / sum(wt) AS b FROM hn GROUP BY ALL)"""
ORACLES = {
    "horizontal_color_observed": duck("points", f"{_PLANES} SELECT scene, surface, iz, ix, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM hl"),
    "horizontal_color_filled": duck("points", f"""{_PLANES} SELECT scene, surface, iz, ix, true AS observed, {_RGB} FROM hl
UNION ALL SELECT scene, surface, iz, ix, false, {_RGB} FROM hf"""),
    "horizontal_patches": duck("points", f"""{_PLANES},
ho AS (SELECT scene, surface, iz, ix FROM he ANTI JOIN (SELECT DISTINCT scene, surface, iz, ix FROM hc) o USING (scene, surface, iz, ix)),
ru AS (SELECT scene, surface, iz, min(ix) AS u0, max(ix) + 1 AS u1 FROM (SELECT *, ix - row_number() OVER (PARTITION BY scene, surface, iz ORDER BY ix) AS k FROM ho) GROUP BY scene, surface, iz, k),
rc AS (SELECT scene, surface, min(iz) AS y0, max(iz) + 1 AS y1, u0, u1 FROM (SELECT *, iz - row_number() OVER (PARTITION BY scene, surface, u0, u1 ORDER BY iz) AS k FROM ru) GROUP BY scene, surface, u0, u1, k)
SELECT scene, surface, round(xmin + (u0 + u1) / 2 * ((xmax - xmin) / nx), 6) AS x, round(CASE surface WHEN 'floor' THEN -0.02::DOUBLE ELSE height + 0.02::DOUBLE END, 6) AS y, round(zmin + (y0 + y1) / 2 * ((zmax - zmin) / nz), 6) AS z,
  round((u1 - u0) * ((xmax - xmin) / nx), 6) AS dx, round((y1 - y0) * ((zmax - zmin) / nz), 6) AS dz FROM rc JOIN sp USING (scene, surface)"""),
    "colored_patches": duck("points", f"""{_PLANES},
cr AS (SELECT * FROM (VALUES ('floor', 0::BIGINT, 0, 0), ('floor', 1, 0, 1), ('floor', 2, 1, 1), ('floor', 3, 1, 0), ('ceiling', 0, 0, 0), ('ceiling', 1, 1, 0), ('ceiling', 2, 1, 1), ('ceiling', 3, 0, 1)) t(surface, corner, dx, dz))
SELECT scene, surface, iz, ix, corner, round(xmin + (ix + dx) / nx * (xmax - xmin), 5) AS x, round(CASE surface WHEN 'floor' THEN -0.01::DOUBLE ELSE height + 0.01::DOUBLE END, 5) AS y, round(zmin + (iz + dz) / nz * (zmax - zmin), 5) AS z,
  {_RGB} FROM hf JOIN sp USING (scene, surface) JOIN cr USING (surface)"""),
    "principal_yaw": duck("points", f"{_YAW} SELECT obj_id, round(yaw, 5) AS yaw, round(ratio, 5) AS ratio FROM yw"),
    "placement": duck("points", f"""{_YAW},
sn AS (SELECT obj_id, CASE WHEN abs(y1 - round_even(y1 / (pi() / 2), 0) * (pi() / 2)) <= radians(15) THEN round_even(y1 / (pi() / 2), 0) * (pi() / 2) ELSE y1 END AS yaw FROM (SELECT obj_id, CASE WHEN ratio >= 1.2 THEN yaw ELSE 0 END AS y1 FROM yw)),
tu AS (SELECT p.obj_id, yaw, cos(-yaw) AS c, sin(-yaw) AS s, cos(-yaw) * x - sin(-yaw) * z AS xr, sin(-yaw) * x + cos(-yaw) * z AS zr, y FROM points p JOIN sn ON p.obj_id = sn.obj_id),
q AS (SELECT obj_id, yaw, any_value(c) AS c, any_value(s) AS s, quantile_cont(xr, 0.02) AS xl, quantile_cont(xr, 0.98) AS xh, quantile_cont(zr, 0.02) AS zl, quantile_cont(zr, 0.98) AS zh, quantile_cont(y, 0.02) AS yl, quantile_cont(y, 0.98) AS yh,
  CASE obj_id % 3 WHEN 0 THEN 'server rack' WHEN 1 THEN 'monitor' ELSE 'sofa' END AS label FROM tu GROUP BY obj_id, yaw),
b AS (SELECT *, CASE WHEN yl - 0.01 < 0.02 * {_KIND} THEN 0.01 ELSE yl END AS base FROM q)
SELECT obj_id, round(c * (xl + xh) / 2 + s * (zl + zh) / 2, 5) AS px, round(base, 5) AS py, round(-s * (xl + xh) / 2 + c * (zl + zh) / 2, 5) AS pz, round(yaw, 5) AS yaw, round(greatest(xh - xl, 0.02), 5) AS w, round(greatest(yh - base, 0.02), 5) AS h, round(greatest(zh - zl, 0.02), 5) AS d FROM b"""),
    "rack_scale": duck("placed", """m AS (SELECT scene, 2.0 / median(CASE WHEN contains(label, 'rack') AND h > 1e-3 THEN h END) AS raw FROM placed GROUP BY scene)
SELECT scene, round(CASE WHEN raw > 0.05 AND raw < 100 THEN raw ELSE 1 END, 6) AS scale, coalesce(raw > 0.05 AND raw < 100, false) AS metric FROM m"""),
    "min_area_yaw": duck("points", """tp AS (SELECT scene, x * 0.8::DOUBLE - z * 0.6::DOUBLE AS x, x * 0.6::DOUBLE + z * 0.8::DOUBLE AS z FROM points),
ar AS (SELECT scene, k, round((max(x * cos(radians(k)) + z * sin(radians(k))) - min(x * cos(radians(k)) + z * sin(radians(k)))) * (max(z * cos(radians(k)) - x * sin(radians(k))) - min(z * cos(radians(k)) - x * sin(radians(k)))), 9) AS area, count(*) AS n FROM tp, range(0, 91) t(k) GROUP BY scene, k),
b1 AS (SELECT scene, k AS deg, n FROM ar QUALIFY row_number() OVER (PARTITION BY scene ORDER BY area, k) = 1),
a2 AS (SELECT tp.scene, j, deg + j / 10.0::DOUBLE AS th, n, round((max(x * cos(radians(deg + j / 10.0::DOUBLE)) + z * sin(radians(deg + j / 10.0::DOUBLE))) - min(x * cos(radians(deg + j / 10.0::DOUBLE)) + z * sin(radians(deg + j / 10.0::DOUBLE)))) * (max(z * cos(radians(deg + j / 10.0::DOUBLE)) - x * sin(radians(deg + j / 10.0::DOUBLE))) - min(z * cos(radians(deg + j / 10.0::DOUBLE)) - x * sin(radians(deg + j / 10.0::DOUBLE)))), 9) AS area
  FROM tp JOIN b1 ON tp.scene = b1.scene, range(-10, 11) t(j) GROUP BY tp.scene, j, deg, n),
b2 AS (SELECT scene, n, radians(th) + pi() / 4 AS q FROM a2 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY area, j) = 1)
SELECT scene, round(CASE WHEN n < 50 THEN 0 ELSE q - floor(q / (pi() / 2)) * (pi() / 2) - pi() / 4 END, 6) AS yaw FROM b2"""),
    "room_rect": duck("points", f"""bd AS (SELECT scene, x, z, y > 0.15 * 2.0 AND y < 0.85 * 2.0 AS band FROM points),
q AS (SELECT scene, count(*) FILTER (WHERE band) AS nb, quantile_cont(CASE WHEN band THEN x END, 0.05) AS xl, quantile_cont(CASE WHEN band THEN x END, 0.95) AS xh, quantile_cont(CASE WHEN band THEN z END, 0.05) AS zl, quantile_cont(CASE WHEN band THEN z END, 0.95) AS zh,
  quantile_cont(x, 0.02) AS xn, quantile_cont(x, 0.98) AS xx, quantile_cont(z, 0.02) AS zn, quantile_cont(z, 0.98) AS zx FROM bd GROUP BY scene)
SELECT bd.scene, round({_SIDE('x', False)}, 6) AS xmin, round({_SIDE('x', True)}, 6) AS xmax, round({_SIDE('z', False)}, 6) AS zmin, round({_SIDE('z', True)}, 6) AS zmax FROM bd JOIN q ON bd.scene = q.scene GROUP BY bd.scene, nb"""),
    "surface_coverage": duck("points", f"""{_ROOM}, {_COVER},
cc AS (SELECT scene, surface, count(*) AS n, count(DISTINCT least(floor((a - a0) / (a1 - a0) * 10), 9) * 10 + least(floor((b - b0) / (b1 - b0) * 10), 9)) AS k FROM ff WHERE a BETWEEN a0 AND a1 AND b BETWEEN b0 AND b1 GROUP BY ALL)
SELECT rm.scene, s.surface, CASE WHEN n >= 20 THEN k / 100.0::DOUBLE ELSE 0 END AS coverage FROM rm, (VALUES ('floor'), ('ceiling'), ('wall_0'), ('wall_1'), ('wall_2'), ('wall_3')) s(surface) LEFT JOIN cc ON cc.scene = rm.scene AND cc.surface = s.surface"""),
    "horizontal_infill": duck("points", f"""{_ROOM},
sp AS (SELECT scene, xmin, xmax, zmin, zmax, height, s.surface, s.level, CAST(least(greatest(ceil((xmax - xmin) / 0.2::DOUBLE), 1), 96) AS BIGINT) AS nx, CAST(least(greatest(ceil((zmax - zmin) / 0.2::DOUBLE), 1), 96) AS BIGINT) AS nz FROM rm, LATERAL (VALUES ('floor', 0.0::DOUBLE), ('ceiling', height)) s(surface, level)),
sn AS (SELECT p.scene, surface, CAST(least(floor((x - xmin) / greatest(xmax - xmin, 1e-9) * nx), nx - 1) AS BIGINT) AS ix, CAST(least(floor((z - zmin) / greatest(zmax - zmin, 1e-9) * nz), nz - 1) AS BIGINT) AS iz, count(*) AS k FROM points p JOIN sp ON p.scene = sp.scene
  WHERE abs(y - level) <= greatest(0.04, 0.04::DOUBLE * greatest(height, 1e-6)) AND x BETWEEN xmin AND xmax AND z BETWEEN zmin AND zmax GROUP BY ALL),
ce AS (SELECT scene, surface, iz, ix FROM sp, LATERAL (SELECT unnest(range(0, nx)) AS ix), LATERAL (SELECT unnest(range(0, nz)) AS iz))
SELECT ce.scene, ce.surface, ce.iz, ce.ix, coalesce(k, 0) AS support_count, coalesce(k, 0) >= 1 AS observed, coalesce(k, 0) < 1 AS fill FROM ce LEFT JOIN sn ON sn.scene = ce.scene AND sn.surface = ce.surface AND sn.iz = ce.iz AND sn.ix = ce.ix"""),
    "ceiling_support": duck("points", f"""{_LEVEL},
q AS (SELECT scene, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1 FROM points GROUP BY scene),
s AS (SELECT p.scene, count(*) AS n, count(DISTINCT least(greatest(floor((x - x0) / ((x1 - x0) / 8)), 0), 7) * 8 + least(greatest(floor((z - z0) / ((z1 - z0) / 8)), 0), 7)) AS k FROM points p JOIN lv ON p.scene = lv.scene JOIN q ON q.scene = p.scene WHERE y > ceil_y - 0.08 * height AND (x1 - x0) / 8 > 1e-9 AND (z1 - z0) / 8 > 1e-9 GROUP BY p.scene)
SELECT lv.scene, coalesce(n >= 50 AND k / 64.0 >= 0.35, false) AS supported FROM lv LEFT JOIN s ON lv.scene = s.scene"""),
    "surface_color": duck("points", f"""{_LEVEL},
sp AS (SELECT scene, 0.1::DOUBLE * greatest(max(y) - min(y), 1e-6) AS tol FROM points GROUP BY scene),
f AS (SELECT p.scene, median(r) AS r, median(g) AS g, median(b) AS b FROM points p JOIN lv ON p.scene = lv.scene JOIN sp ON sp.scene = p.scene WHERE y < floor_y + tol GROUP BY p.scene),
c AS (SELECT p.scene, median(r) AS r, median(g) AS g, median(b) AS b FROM points p JOIN lv ON p.scene = lv.scene JOIN sp ON sp.scene = p.scene WHERE y > ceil_y - tol GROUP BY p.scene)
SELECT lv.scene, 'floor' AS surface, CAST(coalesce(floor(r), 128) AS BIGINT) AS r, CAST(coalesce(floor(g), 126) AS BIGINT) AS g, CAST(coalesce(floor(b), 122) AS BIGINT) AS b FROM lv LEFT JOIN f ON f.scene = lv.scene
UNION ALL SELECT lv.scene, 'ceiling', CAST(coalesce(floor(r), 235) AS BIGINT), CAST(coalesce(floor(g), 235) AS BIGINT), CAST(coalesce(floor(b), 230) AS BIGINT) FROM lv LEFT JOIN c ON c.scene = lv.scene"""),
    "wall_specs": duck("points", f"{_WALL} SELECT scene, wall, along_x, plane, sign, u_min, u_max, ny, nu FROM wl"),
    "wall_ray_cells": duck("points", f"{_WALL}, {_RAYS} SELECT mode, scene, pid, wall, iy, iu FROM rc"),
    "wall_evidence": duck("points", f"{_EVID} SELECT * FROM ev"),
    "wall_plane_supported": duck("points", f"{_EVID} SELECT scene, wall, count(*) >= 6 AND count(DISTINCT iy) >= 2 AND count(DISTINCT iu) >= 2 AS supported FROM ev WHERE observed GROUP BY scene, wall"),
    "wall_fill": duck("mask_cells", f"""{_GRIDS}
SELECT g1.mask_id, g1.iy, g1.iu, (oc OR fl.iy IS NOT NULL) AND NOT ob AND NOT op AS fill FROM g1 LEFT JOIN fl ON fl.mask_id = g1.mask_id AND fl.iy = g1.iy AND fl.iu = g1.iu"""),
    "color_field_observed": duck("points", f"{_COLORS} SELECT scene, wall, iy, iu, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM cl"),
    "color_field_filled": duck("points", f"""{_COLORS},
ce AS (SELECT scene, wall, iy, iu FROM wl, LATERAL (SELECT unnest(range(0, ny)) AS iy), LATERAL (SELECT unnest(range(0, nu)) AS iu)),
ms AS (SELECT ce.* FROM ce ANTI JOIN cl USING (scene, wall, iy, iu)),
nn AS (SELECT ms.scene, ms.wall, ms.iy, ms.iu, 1 / greatest(sqrt((ms.iy - cl.iy) ** 2 + (ms.iu - cl.iu) ** 2), 0.75) ** 2 AS wt, r, g, b FROM ms JOIN cl ON ms.scene = cl.scene AND ms.wall = cl.wall QUALIFY row_number() OVER (PARTITION BY ms.scene, ms.wall, ms.iy, ms.iu ORDER BY (ms.iy - cl.iy) ** 2 + (ms.iu - cl.iu) ** 2, cl.iy, cl.iu) <= 4)
SELECT scene, wall, iy, iu, true AS observed, {_RGB} FROM cl
UNION ALL SELECT scene, wall, iy, iu, false, {_RGB_MEAN} FROM nn GROUP BY scene, wall, iy, iu"""),
    "mask_dilate": duck("mask_cells", f"""{_RUNS} SELECT mask_id, iy, ix, 'cross' AS kind FROM dl
UNION ALL SELECT DISTINCT mask_id, iy + a, ix + b, 'box5' FROM mask_cells, range(-2, 3) p(a), range(-2, 3) q(b) WHERE iy + a BETWEEN 0 AND 9 AND ix + b BETWEEN 0 AND 15"""),
    "mask_resize": duck("mask_cells", "SELECT mask_id, a AS iy, b AS ix FROM mask_cells, range(0, 7) p(a), range(0, 25) q(b) WHERE a * 10 // 7 = iy AND b * 16 // 25 = ix"),
    "mask_rectangles": duck("mask_cells", f"""{_RUNS},
ru AS (SELECT mask_id, iy, min(ix) AS u0, max(ix) + 1 AS u1 FROM (SELECT *, ix - row_number() OVER (PARTITION BY mask_id, iy ORDER BY ix) AS k FROM dl) GROUP BY mask_id, iy, k)
SELECT mask_id, min(iy) AS y0, max(iy) + 1 AS y1, u0, u1 FROM (SELECT *, iy - row_number() OVER (PARTITION BY mask_id, u0, u1 ORDER BY iy) AS k FROM ru) GROUP BY mask_id, u0, u1, k"""),
}
