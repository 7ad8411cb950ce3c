"""Geometry as column expressions; all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length of the common part of two intervals."""
    return F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b), F.lit(0.0))


def iou_of(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """Intersection over union of two XYXY boxes, each a struct (or columns by name) x1, y1, x2, y2."""
    inter = overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    area = lambda t: F.greatest(t["x2"] - t["x1"], F.lit(0.0)) * F.greatest(t["y2"] - t["y1"], F.lit(0.0))
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of the XYXY boxes of rows with aliases ``a`` and ``b``."""
    side = lambda t: {n: F.col(f"{t}.{n}") for n in ("x1", "y1", "x2", "y2")}
    return iou_of(side(a), side(b))


def norm(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))


def to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R p + t with the camera's columns in scope."""
    return tuple(F.col(f"r{k}0") * x + F.col(f"r{k}1") * y + F.col(f"r{k}2") * z + F.col(f"t{k}") for k in range(3))


def to_world(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Rt (c - t)."""
    d = (x - F.col("t0"), y - F.col("t1"), z - F.col("t2"))
    return tuple(F.col(f"r0{k}") * d[0] + F.col(f"r1{k}") * d[1] + F.col(f"r2{k}") * d[2] for k in range(3))


def unproject(u: Column, v: Column, depth: Column) -> tuple[Column, Column, Column]:
    """World point of a pixel with depth."""
    return to_world((u - F.col("cx")) / F.col("fx") * depth, (v - F.col("cy")) / F.col("fy") * depth, depth)


def project(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, camera depth) of a world point; depth too near zero counts as 1e-9."""
    a, b, c = to_camera(x, y, z)
    safe = F.when(F.abs(c) <= 1e-9, F.lit(1e-9)).otherwise(c)
    return F.col("fx") * a / safe + F.col("cx"), F.col("fy") * b / safe + F.col("cy"), c


def snap_yaw(yaw: Column, room_yaw: Column, within: float = math.radians(15)) -> Column:
    """Nearest quarter turn from the room's yaw if it is close."""
    quarter = F.lit(math.pi / 2)
    turns = F.rint((yaw - room_yaw) / quarter)
    snapped = room_yaw + turns * quarter
    return F.when(F.abs(yaw - snapped) <= within, snapped).otherwise(yaw)


def placed_half_extents(w: Column, d: Column, yaw: Column) -> tuple[Column, Column]:
    """Half extents along x and z of a footprint w x d turned by yaw about +Y."""
    c, s = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    return w / 2 * c + d / 2 * s, w / 2 * s + d / 2 * c


def cell(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Grid cell of x in [lo, hi], the upper bound in the last cell; callers filter the range."""
    return F.least(F.floor((x - lo) / (hi - lo) * n), n - 1).cast("long")
