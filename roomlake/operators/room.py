"""Rooms: yaw, fitted walls, coverage, wall and floor evidence, infill, colours, masks on grids.

A room is a row (scene, xmin, xmax, zmin, zmax, height); points are rows of a scene. Everything groups by scene and
cell, so scenes spread over the cluster and no scene's cloud is gathered; quantiles over a scene go by quantiles.quantiles,
those of one object's points by the built-in aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import snap_yaw
from .quantiles import quantiles, sorted_quantiles

CELL, MAX_U, MAX_Y = 0.20, 96, 64
FLOOR_COLOR, CEILING_COLOR = (128, 126, 122), (235, 235, 230)
#: Prefab kind of a label; kinds that stand on the floor.
PREFAB_KINDS = {
    "server rack": "rack", "rack": "rack", "server cabinet": "rack", "desk": "desk", "table": "desk", "monitor": "monitor", "screen": "monitor",
    "chair": "chair", "cabinet": "cabinet", "ups": "cabinet", "pdu": "cabinet", "network switch": "shelfbox", "server": "shelfbox", "patch panel": "shelfbox",
}
FLOOR_KINDS = ("rack", "desk", "chair", "cabinet")


def prefab_kind(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PREFAB_KINDS.items() for x in kv])
    return F.element_at(table, F.trim(F.lower(label)))


def principal_yaw(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, yaw, ratio): direction of the longest spread on the floor in [-90, 90) degrees, and elongation."""
    a = points.groupBy(*keys).agg(F.var_samp("x").alias("a"), F.covar_samp("x", "z").alias("b"), F.var_samp("z").alias("c"))
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    mean = (F.col("a") + F.col("c")) / 2
    theta = F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2
    finite = F.col("a").isNotNull() & ~F.isnan("a") & ~F.isnan("b") & ~F.isnan("c")
    folded = F.pmod(theta + math.pi / 2, F.lit(math.pi)) - math.pi / 2
    return a.select(*keys, F.when(finite, folded).otherwise(0.0).alias("yaw"), F.when(finite, F.sqrt((mean + root) / F.greatest(mean - root, F.lit(1e-9)))).otherwise(1.0).alias("ratio"))


def place_instances(points: DataFrame, labels: DataFrame, keys: list[str], floor_y: float, tolerance: float, room_yaw: float = 0.0) -> DataFrame:
    """(keys, px, py, pz, yaw, w, h, d): oriented robust boxes that stand on the floor where they nearly do.

    Two aggregates: principal yaw first, then percentiles in the yaw frame.
    """
    yaw = principal_yaw(points, keys).withColumn("yaw", snap_yaw(F.when(F.col("ratio") >= 1.2, F.col("yaw")).otherwise(F.lit(room_yaw)), F.lit(room_yaw)))
    turned = points.join(yaw, keys).withColumns({"c": F.cos(-F.col("yaw")), "s": F.sin(-F.col("yaw"))}).withColumns({"xr": F.col("c") * F.col("x") - F.col("s") * F.col("z"), "zr": F.col("s") * F.col("x") + F.col("c") * F.col("z")})
    lists = turned.groupBy(*keys, "yaw", "c", "s").agg(*[F.sort_array(F.collect_list(c)).alias(n) for c, n in (("xr", "qx"), ("zr", "qz"), ("y", "qy"))])
    boxes = lists.withColumns({n: sorted_quantiles(F.col(n), (0.02, 0.98)) for n in ("qx", "qz", "qy")}).join(labels, keys)
    kind = prefab_kind(F.col("label"))
    tol = F.lit(tolerance) * F.when(kind.isin(*FLOOR_KINDS), 3.5).otherwise(1.0)
    mx, mz = (F.col("qx")[0] + F.col("qx")[1]) / 2, (F.col("qz")[0] + F.col("qz")[1]) / 2
    base = F.when(F.col("qy")[0] - floor_y < tol, F.lit(floor_y)).otherwise(F.col("qy")[0])
    return boxes.select(
        *keys, (F.col("c") * mx + F.col("s") * mz).alias("px"), base.alias("py"), (-F.col("s") * mx + F.col("c") * mz).alias("pz"), "yaw",
        F.greatest(F.col("qx")[1] - F.col("qx")[0], F.lit(0.02)).alias("w"), F.greatest(F.col("qy")[1] - base, F.lit(0.02)).alias("h"), F.greatest(F.col("qz")[1] - F.col("qz")[0], F.lit(0.02)).alias("d"),
    )


def rack_scale(placed: DataFrame, rack_height: float = 2.0) -> DataFrame:
    """(scene, scale, metric): metric scale from the median height of racks; 1 and false if there is none or it is absurd."""
    tall = F.median(F.when(F.lower("label").contains("rack") & (F.col("h") > 1e-3), F.col("h")))
    rows = placed.groupBy("scene").agg((F.lit(rack_height) / tall).alias("raw"))
    good = F.coalesce((F.col("raw") > 0.05) & (F.col("raw") < 100), F.lit(False))
    return rows.select("scene", F.when(good, F.col("raw")).otherwise(1.0).alias("scale"), good.alias("metric"))


def _areas(points: DataFrame, angles: DataFrame) -> DataFrame:
    """(scene, k, theta, area) of each scene's floor box turned by each of its angles."""
    turned = points.join(angles, "scene").withColumns({"u": F.col("x") * F.col("ct") + F.col("z") * F.col("st"), "w": F.col("z") * F.col("ct") - F.col("x") * F.col("st")})
    return turned.groupBy("scene", "k", "theta").agg(F.round((F.max("u") - F.min("u")) * (F.max("w") - F.min("w")), 9).alias("area"))


def min_area_yaw(points: DataFrame) -> DataFrame:
    """(scene, yaw) of the smallest floor box: 91 coarse angles, then 21 within a degree; first of ties; 0 under 50 points; in [-45, 45) degrees."""
    scenes = points.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    with_trig = lambda df: df.withColumns({"ct": F.cos("theta"), "st": F.sin("theta")})
    coarse = with_trig(scenes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(90)))).withColumn("theta", F.radians(F.col("k").cast("double"))))
    first = _areas(points, coarse.drop("n")).groupBy("scene").agg(F.min(F.struct("area", "k")).alias("m")).select("scene", F.col("m.k").alias("deg"))
    fine = with_trig(first.withColumn("k", F.explode(F.sequence(F.lit(-10), F.lit(10)))).withColumn("theta", F.radians(F.col("deg") + F.col("k") / 10.0)))
    best = _areas(points, fine.drop("deg")).groupBy("scene").agg(F.min(F.struct("area", "k", "theta")).alias("m"))
    folded = F.pmod(F.col("m.theta") + math.pi / 4, F.lit(math.pi / 2)) - math.pi / 4
    return best.join(scenes, "scene").select("scene", F.when(F.col("n") < 50, 0.0).otherwise(folded).alias("yaw"))


def fit_room_rect(points: DataFrame, heights: DataFrame, support: int = 200, outer: int = 20) -> DataFrame:
    """(scene, xmin, xmax, zmin, zmax): walls as medians of the outer points of a mid-height band, else p2 or p98 of all points."""
    rows = points.join(heights, "scene").withColumn("band", (F.col("y") > 0.15 * F.col("height")) & (F.col("y") < 0.85 * F.col("height"))).select("scene", "x", "z", "band")
    sides = {"xmin": ("x", False), "xmax": ("x", True), "zmin": ("z", False), "zmax": ("z", True)}
    at = lambda name, up: F.col(name)[int(up)]
    q = quantiles(rows, ["scene"], {f"band_{c}": (F.when(F.col("band"), F.col(c)), (0.05, 0.95)) for c in "xz"} | {f"all_{c}": (F.col(c), (0.02, 0.98)) for c in "xz"})
    outer_rows = rows.join(q, "scene")
    beyond = {k: F.when(F.col("band") & ((F.col(c) > at(f"band_{c}", up)) if up else (F.col(c) < at(f"band_{c}", up))), F.col(c)) for k, (c, up) in sides.items()}
    counts = outer_rows.groupBy("scene").agg(F.count_if("band").alias("n_band"), *[F.count(b).alias(f"n_{k}") for k, b in beyond.items()])
    fits = quantiles(outer_rows, ["scene"], {f"fit_{k}": (b, (0.5,)) for k, b in beyond.items()})
    fitted = counts.join(q, "scene").join(fits, "scene", "left")
    return fitted.select("scene", *[
        F.when((F.col("n_band") >= support) & (F.col(f"n_{k}") >= outer), F.col(f"fit_{k}")[0]).otherwise(at(f"all_{c}", up)).alias(k) for k, (c, up) in sides.items()
    ])


def walls_of(rooms: DataFrame) -> DataFrame:
    """Four rows a room: wall, along_x (its plane is a z), plane, sign, u range, height and grid shape (ny, nu)."""
    side = lambda k, along_x, plane, sign, a, b: F.struct(F.lit(k).cast("long").alias("wall"), F.lit(along_x).alias("along_x"), F.col(plane).alias("plane"), F.lit(sign).alias("sign"), F.col(a).alias("u_min"), F.col(b).alias("u_max"))
    four = F.array(side(0, False, "xmin", -1.0, "zmin", "zmax"), side(1, False, "xmax", 1.0, "zmin", "zmax"), side(2, True, "zmin", -1.0, "xmin", "xmax"), side(3, True, "zmax", 1.0, "xmin", "xmax"))
    rows = rooms.select("scene", "height", F.least(F.col("xmax") - F.col("xmin"), F.col("zmax") - F.col("zmin")).alias("min_side"), F.explode(four).alias("s")).select("scene", "height", "min_side", "s.*")
    count = lambda length, most: F.least(F.greatest(F.ceil(length / CELL), F.lit(1)), F.lit(most)).cast("long")
    return rows.withColumns({"nu": count(F.col("u_max") - F.col("u_min"), MAX_U), "ny": count(F.col("height"), MAX_Y)})


def to_wall_cells(rows: DataFrame, u: Column, y: Column) -> DataFrame:
    """Rows inside their wall's area with cell iu, iy; the far edge belongs to the last cell."""
    inside = u.between(F.col("u_min"), F.col("u_max")) & y.between(F.lit(0.0), F.col("height"))
    iu = F.floor((u - F.col("u_min")) / F.greatest(F.col("u_max") - F.col("u_min"), F.lit(1e-9)) * F.col("nu"))
    iy = F.floor(y / F.greatest(F.col("height"), F.lit(1e-9)) * F.col("ny"))
    return rows.filter(inside).withColumns({"iu": F.least(iu, F.col("nu") - 1), "iy": F.least(iy, F.col("ny") - 1)})


def ray_wall_cells(rays: DataFrame, rooms: DataFrame, mode: str, beyond: float = 0.05) -> DataFrame:
    """Rays (scene, frame, pid, x, y, z, camera cam_x, cam_y, cam_z) with the wall cell they cross.

    occluded: the wall is behind the endpoint; through: the endpoint is behind the wall; opening: any ray
    toward it. Cameras outside the wall don't count.
    """
    rows = rays.join(walls_of(rooms), "scene")
    ca = F.when(F.col("along_x"), F.col("cam_z")).otherwise(F.col("cam_x"))
    pa = F.when(F.col("along_x"), F.col("z")).otherwise(F.col("x"))
    rows = rows.withColumns({"ca": ca, "pa": pa}).filter((F.abs(F.col("pa") - F.col("ca")) > 1e-8) & (F.col("sign") * (F.col("ca") - F.col("plane")) < beyond))
    rows = rows.withColumn("t", F.try_divide(F.col("plane") - F.col("ca"), F.col("pa") - F.col("ca")))
    if mode == "occluded":
        rows = rows.filter("t > 1.02")
    elif mode == "through":
        rows = rows.filter((F.col("t") > 0) & (F.col("t") < 0.98) & (F.col("sign") * (F.col("pa") - F.col("plane")) > beyond))
    elif mode == "opening":
        rows = rows.filter("t > 0")
    else:
        raise ValueError(f"unknown ray mode {mode}")
    at = lambda c: F.col(f"cam_{c}") + F.col("t") * (F.col(c) - F.col(f"cam_{c}"))
    return to_wall_cells(rows, F.when(F.col("along_x"), at("x")).otherwise(at("z")), at("y"))


def near_wall_points(points: DataFrame, rooms: DataFrame) -> DataFrame:
    """Points on each wall's plane (tolerance by room size), with their cell."""
    rows = points.join(walls_of(rooms), "scene").withColumn("tol", F.greatest(F.lit(0.04), 0.025 * F.greatest("min_side", F.lit(1e-6))))
    pa, u = F.when(F.col("along_x"), F.col("z")).otherwise(F.col("x")), F.when(F.col("along_x"), F.col("x")).otherwise(F.col("z"))
    return to_wall_cells(rows.filter(F.abs(pa - F.col("plane")) <= F.col("tol")), u, F.col("y"))


def wall_evidence(points: DataFrame, occluding: DataFrame, free: DataFrame, semantic: DataFrame, rooms: DataFrame) -> DataFrame:
    """(scene, wall, iy, iu, observed, occluded_views, through_views, opening) for cells with any evidence.

    Views are distinct frames of rays that end before the wall (``occluding``) or beyond it (``free``); ``semantic`` rays
    are of openings. Each kind is one aggregate by cell; the four are summed in one more.
    """
    keys = ["scene", "wall", "iy", "iu"]
    zero = {"observed": F.lit(False), "occluded_views": F.lit(0).cast("long"), "through_views": F.lit(0).cast("long"), "opening": F.lit(False)}

    def part(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.groupBy(*keys).agg(value.alias(name)).select(*keys, *[F.col(name) if k == name else v.alias(k) for k, v in zero.items()])

    band = near_wall_points(points, rooms).filter((F.col("y") >= 0.05 * F.col("height")) & (F.col("y") <= 0.95 * F.col("height")))
    views = F.countDistinct("frame")
    rows = (
        part(band, "observed", F.lit(True) & (F.count(F.lit(1)) > 0)).unionByName(part(ray_wall_cells(occluding, rooms, "occluded"), "occluded_views", views))
        .unionByName(part(ray_wall_cells(free, rooms, "through"), "through_views", views)).unionByName(part(ray_wall_cells(semantic, rooms, "opening"), "opening", F.count(F.lit(1)) > 0))
    )
    return rows.groupBy(*keys).agg(F.max("observed").alias("observed"), F.max("occluded_views").alias("occluded_views"), F.max("through_views").alias("through_views"), F.max("opening").alias("opening"))


def plane_supported(cells: DataFrame, least: int = 6) -> DataFrame:
    """(scene, wall, supported): enough observed cells, over two rows and two columns at least."""
    seen = cells.filter("observed").groupBy("scene", "wall").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("iy").alias("ny"), F.countDistinct("iu").alias("nu"))
    return seen.select("scene", "wall", ((F.col("n") >= max(least, 1)) & (F.col("ny") >= 2) & (F.col("nu") >= 2)).alias("supported"))


def wall_fill(cells: DataFrame, keys: list[str], min_through: int = 2, complete: bool = True) -> DataFrame:
    """(keys, iy, iu, fill) over full grids with observed, occluded_views, through_views and opening.

    Occluded cells are filled, and with ``complete`` also those that connect to the observed wall without crossing an
    opening; observed cells, openings and their neighbours stay. The flood is a fixpoint on one wall's grid of at
    most 64 x 96 cells, so a wall is a numpy group.
    """

    def grow(m: np.ndarray) -> np.ndarray:
        out = m.copy()
        out[1:] |= m[:-1]
        out[:-1] |= m[1:]
        out[:, 1:] |= m[:, :-1]
        out[:, :-1] |= m[:, 1:]
        return out

    def run(f: pd.DataFrame) -> pd.DataFrame:
        iy, iu = f["iy"].to_numpy(), f["iu"].to_numpy()
        grid = lambda v: _grid(v, iy, iu)
        observed, occluded = grow(grid(f["observed"])), grow(grid(f["occluded_views"] > 0))
        opening = grow(grid(f["opening"]) | grid(f["through_views"] >= min_through))
        eligible = occluded
        if complete and observed.any():
            reach = observed
            while True:
                wider = reach | (grow(reach) & ~opening)
                if (wider == reach).all():
                    break
                reach = wider
            eligible = eligible | reach
        out = f[[*keys, "iy", "iu"]].copy()
        out["fill"] = (eligible & ~observed & ~opening)[iy, iu]
        return out

    types = dict(cells.dtypes)
    return cells.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", iy long, iu long, fill boolean")


def _grid(values: pd.Series, iy: np.ndarray, iu: np.ndarray) -> np.ndarray:
    out = np.zeros((int(iy.max()) + 1, int(iu.max()) + 1), bool)
    out[iy, iu] = values.to_numpy(bool)
    return out


def surface_coverage(points: DataFrame, rooms: DataFrame, least: int = 20) -> DataFrame:
    """(scene, surface, coverage): share of a 10 x 10 grid that points touch on floor, ceiling and the four walls; 0 with too few points."""
    r = points.join(rooms, "scene")
    tol_w = F.greatest(F.lit(0.04), 0.025 * F.greatest(F.least(F.col("xmax") - F.col("xmin"), F.col("zmax") - F.col("zmin")), F.lit(1e-6)))
    tol_h = F.greatest(F.lit(0.04), 0.04 * F.greatest("height", F.lit(1e-6)))
    y, x, z = F.col("y"), F.col("x"), F.col("z")
    vertical = (y > 0.05 * F.col("height")) & (y < 0.95 * F.col("height"))
    zero = F.lit(0.0)
    face = lambda name, on, a, a0, a1, b, b0, b1: F.when(on, F.struct(F.lit(name).alias("surface"), a.alias("a"), a0.alias("a0"), a1.alias("a1"), b.alias("b"), b0.alias("b0"), b1.alias("b1")))
    c = F.col
    faces = F.array(
        face("floor", F.abs(y) <= tol_h, x, c("xmin"), c("xmax"), z, c("zmin"), c("zmax")), face("ceiling", F.abs(y - c("height")) <= tol_h, x, c("xmin"), c("xmax"), z, c("zmin"), c("zmax")),
        face("wall_0", (F.abs(x - c("xmin")) <= tol_w) & vertical, z, c("zmin"), c("zmax"), y, zero, c("height")), face("wall_1", (F.abs(x - c("xmax")) <= tol_w) & vertical, z, c("zmin"), c("zmax"), y, zero, c("height")),
        face("wall_2", (F.abs(z - c("zmin")) <= tol_w) & vertical, x, c("xmin"), c("xmax"), y, zero, c("height")), face("wall_3", (F.abs(z - c("zmax")) <= tol_w) & vertical, x, c("xmin"), c("xmax"), y, zero, c("height")),
    )
    rows = r.select("scene", F.explode(F.array_compact(faces)).alias("f")).select("scene", "f.*")
    inside = rows.filter(F.col("a").between(F.col("a0"), F.col("a1")) & F.col("b").between(F.col("b0"), F.col("b1")) & (F.col("a1") - F.col("a0") > 1e-6) & (F.col("b1") - F.col("b0") > 1e-6))
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 10), F.lit(9))
    seen = inside.groupBy("scene", "surface").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cell("a", "a0", "a1") * 10 + cell("b", "b0", "b1")).alias("k"))
    names = rooms.select("scene", F.explode(F.array(*[F.lit(n) for n in ("floor", "ceiling", "wall_0", "wall_1", "wall_2", "wall_3")])).alias("surface"))
    return names.join(seen, ["scene", "surface"], "left").select("scene", "surface", F.when(F.col("n") >= least, F.col("k") / 100.0).otherwise(0.0).alias("coverage"))


def grid_shape(rooms: DataFrame) -> DataFrame:
    """Rooms with nx and nz, the cells of their floor and ceiling grids."""
    count = lambda a, b: F.least(F.greatest(F.ceil((F.col(b) - F.col(a)) / CELL), F.lit(1)), F.lit(MAX_U)).cast("long")
    return rooms.withColumns({"nx": count("xmin", "xmax"), "nz": count("zmin", "zmax")})


def horizontal_planes(rooms: DataFrame) -> DataFrame:
    """Rooms with their grid shape, once for the floor and once for the ceiling (surface, level)."""
    levels = F.array(F.struct(F.lit("floor").alias("surface"), F.lit(0.0).alias("level")), F.struct(F.lit("ceiling").alias("surface"), F.col("height").alias("level")))
    return grid_shape(rooms).withColumn("s", F.explode(levels)).select("*", "s.*").drop("s")


def horizontal_cells(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Points near a floor or ceiling plane and over the room, with their cell iz, ix."""
    on = (F.abs(F.col("y") - F.col("level")) <= F.greatest(F.lit(0.04), 0.04 * F.greatest("height", F.lit(1e-6)))) & F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("z").between(F.col("zmin"), F.col("zmax"))
    cell = lambda v, lo, hi, n: F.least(F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * F.col(n)), F.col(n) - 1)
    return points.join(planes, "scene").filter(on).withColumns({"ix": cell("x", "xmin", "xmax", "nx"), "iz": cell("z", "zmin", "zmax", "nz")})


def horizontal_infill(points: DataFrame, rooms: DataFrame, least: int = 3) -> DataFrame:
    """(scene, surface, iz, ix, support_count, observed, fill): every floor and ceiling cell of 0.2 m; cells with too few points are filled."""
    planes = horizontal_planes(rooms)
    spine = planes.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("iz", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1))).select("scene", "surface", "iz", "ix")
    seen = horizontal_cells(points, planes).groupBy("scene", "surface", "iz", "ix").agg(F.count(F.lit(1)).alias("k"))
    rows = spine.join(seen, ["scene", "surface", "iz", "ix"], "left").withColumn("support_count", F.coalesce("k", F.lit(0)).cast("long"))
    return rows.select("scene", "surface", "iz", "ix", "support_count", (F.col("support_count") >= least).alias("observed"), (F.col("support_count") < least).alias("fill"))


def ceiling_support(points: DataFrame, levels: DataFrame, least: int = 50, share: float = 0.35) -> DataFrame:
    """(scene, supported): whether points near the ceiling spread over the room's 8 x 8 floor grid (outside points count for edge cells)."""
    q = quantiles(points, ["scene"], {"qx": (F.col("x"), (0.02, 0.98)), "qz": (F.col("z"), (0.02, 0.98))})
    rows = points.join(levels, "scene").filter(F.col("y") > F.col("ceil_y") - 0.08 * F.greatest("height", F.lit(1e-6))).join(q, "scene")
    cell = lambda v, b: F.least(F.greatest(F.floor((F.col(v) - F.col(b)[0]) / ((F.col(b)[1] - F.col(b)[0]) / 8)), F.lit(0)), F.lit(7))
    wide = ((F.col("qx")[1] - F.col("qx")[0]) / 8 > 1e-9) & ((F.col("qz")[1] - F.col("qz")[0]) / 8 > 1e-9)
    seen = rows.filter(wide).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cell("x", "qx") * 8 + cell("z", "qz")).alias("k"))
    return levels.join(seen, "scene", "left").select("scene", F.coalesce((F.col("n") >= least) & (F.col("k") / 64.0 >= share), F.lit(False)).alias("supported"))


def level_colors(points: DataFrame, levels: DataFrame) -> DataFrame:
    """(scene, surface, r, g, b): median colour within a tenth of the height range of floor and ceiling, with defaults."""
    span = points.groupBy("scene").agg((F.max("y") - F.min("y")).alias("span"))
    rows = points.join(levels, "scene").join(span, "scene").withColumn("tol", 0.1 * F.greatest("span", F.lit(1e-6)))
    out = None
    for name, near, fixed in (("floor", F.col("y") < F.col("floor_y") + F.col("tol"), FLOOR_COLOR), ("ceiling", F.col("y") > F.col("ceil_y") - F.col("tol"), CEILING_COLOR)):
        seen = quantiles(rows.filter(near), ["scene"], {k: (F.col(k), (0.5,)) for k in "rgb"}).select("scene", *[F.floor(F.col(k)[0]).alias(k) for k in "rgb"])
        part = levels.select("scene").join(seen, "scene", "left").select("scene", F.lit(name).alias("surface"), *[F.coalesce(k, F.lit(v)).cast("long").alias(k) for k, v in zip("rgb", fixed)])
        out = part if out is None else out.unionAll(part)
    return out


def wall_colors(points: DataFrame, rooms: DataFrame, least: int = 2) -> DataFrame:
    """(scene, wall, iy, iu, r, g, b) of observed cells: mean of each frame with enough points, then median over frames."""
    keys = ["scene", "wall", "iy", "iu"]
    views = near_wall_points(points, rooms).groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in "rgb"]).filter(F.col("n") >= least)
    return views.groupBy(*keys).agg(*[F.median(k).alias(k) for k in "rgb"])


def horizontal_colors(points: DataFrame, rooms: DataFrame, least: int = 2) -> DataFrame:
    """(scene, surface, iz, ix, r, g, b) of observed floor and ceiling cells: mean of each frame with enough points, then median over frames."""
    keys = ["scene", "surface", "iz", "ix"]
    views = horizontal_cells(points, horizontal_planes(rooms)).groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in "rgb"]).filter(F.col("n") >= least)
    return views.groupBy(*keys).agg(*[F.median(k).alias(k) for k in "rgb"])


def fill_colors(observed: DataFrame, grid: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """(keys, iy, iu, observed, r, g, b): cells of the grid with their own colour, or the inverse-square mean of the k nearest observed cells.

    Ties in distance go by row and column; a grid without an observed cell gives no rows. A grid has at most 96 x 96 cells and is one numpy group; its missing cells meet the observed ones
    a few hundred at a time, so no pair becomes a row.
    """
    joined = grid.select(*keys, "iy", "iu").join(observed.withColumn("seen", F.lit(True)), [*keys, "iy", "iu"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["iy", "iu"], kind="stable").reset_index(drop=True)
        at, seen, rgb = f[["iy", "iu"]].to_numpy(np.int64), f["seen"].to_numpy(bool), f[["r", "g", "b"]].to_numpy(float)
        known, missing = np.flatnonzero(seen), np.flatnonzero(~seen)
        if not len(known):
            missing = missing[:0]
        n = min(k, len(known))
        for a in range(0, len(missing), 512):
            rows = missing[a : a + 512]
            d2 = ((at[rows][:, None, :] - at[known]) ** 2).sum(2)
            order = d2 * len(known) + np.arange(len(known))  # known cells stand in order of row and column
            near = np.sort(np.argpartition(order, n - 1, axis=1)[:, :n], axis=1)
            weight = 1 / np.maximum(np.sqrt(np.take_along_axis(d2, near, 1)), 0.75) ** 2
            rgb[rows] = (rgb[known][near] * weight[..., None]).sum(1) / weight.sum(1, keepdims=True)
        kept = np.sort(np.concatenate([known, missing]))
        out = f.loc[kept, [*keys, "iy", "iu"]].copy()
        out["observed"] = seen[kept]
        out["r"], out["g"], out["b"] = rgb[kept].T
        return out

    types = dict(joined.dtypes)
    return joined.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in keys) + ", iy long, iu long, observed boolean, r double, g double, b double")


def dilate(cells: DataFrame, keys: list[str], shape: tuple[int, int], box: bool, reach: int = 1) -> DataFrame:
    """Cells grown by a square (``box``) or a cross, within the grid."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if box or abs(a) + abs(b) <= reach]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    grown = cells.withColumn("m", F.explode(moves)).select(*keys, (F.col("iy") + F.col("m.a")).alias("iy"), (F.col("ix") + F.col("m.b")).alias("ix"))
    return grown.filter(F.col("iy").between(0, shape[0] - 1) & F.col("ix").between(0, shape[1] - 1)).distinct()


def resize_nearest(cells: DataFrame, keys: list[str], old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Mask cells on a grid of another size: a new cell copies old cell floor(i old / new)."""
    spread = lambda c, a, b: F.filter(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.floor(i * a / F.lit(float(b))) == F.col(c))
    rows = cells.withColumns({"ny": spread("iy", old[0], new[0]), "nx": spread("ix", old[1], new[1])})
    return rows.select(*keys, F.explode("ny").alias("iy"), "nx").select(*keys, F.col("iy").cast("long").alias("iy"), F.explode("nx").alias("ix")).withColumn("ix", F.col("ix").cast("long"))


def mask_rectangles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y0, y1, u0, u1): horizontal runs, merged down consecutive rows with the same run; ends are exclusive."""
    row = Window.partitionBy(*keys, "iy").orderBy("ix")
    runs = cells.withColumn("island", F.col("ix") - F.row_number().over(row)).groupBy(*keys, "iy", "island").agg(F.min("ix").alias("u0"), (F.max("ix") + 1).alias("u1"))
    down = Window.partitionBy(*keys, "u0", "u1").orderBy("iy")
    return runs.withColumn("block", F.col("iy") - F.row_number().over(down)).groupBy(*keys, "u0", "u1", "block").agg(F.min("iy").alias("y0"), (F.max("iy") + 1).alias("y1")).select(*keys, "y0", "y1", "u0", "u1")
