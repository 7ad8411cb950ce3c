"""Pixels and points: lifting, projecting, visibility, confidence gates, view colours, voxel fusion.

Cameras join on the frame key, so Spark picks broadcast or sort-merge by their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .quantiles import quantiles
from .sampling import linspace_sample

#: A scene's points and cameras meet in this many parts at least, whatever the scene's size.
SCENE_PARTS = 32
#: Voxels of one slab task.
SLAB = 65_536
#: Tiles smoothed at a time.
TILES = 32
BIAS_RATIO, BIAS = 0.08, 0.03
AGREE_RATIO, AGREE = 0.12, 0.08


def unproject_pixels(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels with world coordinates wx, wy, wz."""
    wx, wy, wz = G.unproject(F.col("u"), F.col("v"), F.col("depth"))
    return pixels.join(cameras, "frame").select(*pixels.columns, wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))


def project_points(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points in every frame of their scene with pixel position pu, pv and camera depth pz; expects ``frame`` on both sides."""
    pu, pv, pz = G.project(F.col("x"), F.col("y"), F.col("z"))
    return points.join(cameras, "frame").select(*points.columns, pu.alias("pu"), pv.alias("pv"), pz.alias("pz"))


def sample_depth(projected: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """In-bounds projections with the depth and colour of the pixel they round to (half to even)."""
    inside = (F.col("pz") > 1e-6) & F.col("pu").between(0, width - 1) & F.col("pv").between(0, height - 1)
    hit = projected.filter(inside).withColumns({"u": F.rint("pu").cast("long"), "v": F.rint("pv").cast("long")})
    pix = pixels.select("frame", "u", "v", F.col("depth").alias("seen"), F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
    return hit.join(pix, ["frame", "u", "v"])


def visible(sampled: DataFrame) -> DataFrame:
    """Samples not hidden: at most a tolerance behind the seen surface (one-sided)."""
    return sampled.filter((F.col("seen") > 1e-6) & (F.col("pz") <= F.col("seen") * (1 + BIAS_RATIO) + BIAS))


def scene_transform(rotation: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """4 x 4 matrix that takes world points into the first camera's frame, y up and z toward the viewer; from that camera's R (3 x 3) and t."""
    first = np.eye(4)
    first[:3, :3], first[:3, 3] = rotation, shift
    return np.linalg.inv(first) @ np.diag([1.0, -1.0, -1.0, 1.0])


def apply_transform(points: DataFrame, matrix: np.ndarray, columns: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points after a rigid or similarity transform: three linear expressions; chains of transforms are multiplied beforehand."""
    old = [F.col(c) for c in columns]
    new = [sum((F.lit(float(matrix[k, j])) * old[j] for j in range(1, 3)), F.lit(float(matrix[k, 0])) * old[0]) + F.lit(float(matrix[k, 3])) for k in range(3)]
    return points.select(*[c for c in points.columns if c not in columns], *[n.alias(c) for n, c in zip(new, columns)])


def mask_points_local(mask_pixels: DataFrame, pixels: DataFrame, cameras: DataFrame, matrix: np.ndarray, most: int = 6000) -> DataFrame:
    """(det_id, u, v, x, y, z): at most ``most`` evenly spaced pixels of each mask (row by row), as points after ``matrix``.

    mask_pixels: det_id, frame, u, v. Pixels without finite depth go after the choice.
    """
    picked = linspace_sample(mask_pixels, ["det_id"], ["v", "u"], most)
    seen = picked.join(pixels.select("frame", "u", "v", "depth"), ["frame", "u", "v"]).filter(F.col("depth").isNotNull() & ~F.isnan("depth") & (F.abs("depth") < float("inf")))
    lifted = unproject_pixels(seen, cameras).select("det_id", "u", "v", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    return apply_transform(lifted, matrix)


def best_view_color(points: DataFrame, pixels: DataFrame, cameras: DataFrame, width: int, height: int) -> DataFrame:
    """(pid, frame, r, g, b): colour from the visible frame with the least depth, first frame of ties.

    Every point meets every camera of its scene. Points are dealt by (scene, part), the cameras, some hundred rows a scene, copied to
    all SCENE_PARTS parts, so a large scene is no single task.
    """
    pu, pv, pz = G.project(F.col("x"), F.col("y"), F.col("z"))
    spread = cameras.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SCENE_PARTS - 1))))
    rows = points.select("pid", "scene", "x", "y", "z", F.pmod(F.xxhash64("pid"), F.lit(SCENE_PARTS)).cast("int").alias("part"))
    seen = rows.join(spread, ["scene", "part"]).select("pid", "frame", pu.alias("pu"), pv.alias("pv"), pz.alias("pz"))
    good = visible(sample_depth(seen, pixels, width, height))
    best = good.groupBy("pid").agg(F.min(F.struct("pz", "frame", "pr", "pg", "pb")).alias("m"))
    return best.select("pid", "m.frame", F.col("m.pr").alias("r"), F.col("m.pg").alias("g"), F.col("m.pb").alias("b"))


def depth_edges(pixels: DataFrame, rtol: float = 0.03) -> DataFrame:
    """Adds edge: depth jumps by more than rtol of itself in the 3x3 cross (an approximation; the original is not public)."""
    d = F.col("depth")
    row = Window.partitionBy("frame", "v").orderBy("u")
    col = Window.partitionBy("frame", "u").orderBy("v")
    near = [F.lag("depth").over(row), F.lead("depth").over(row), F.lag("depth").over(col), F.lead("depth").over(col)]
    jump = F.greatest(*[F.coalesce(F.abs(n - d), F.lit(0.0)) for n in near])
    return pixels.withColumn("edge", jump > rtol * d)


def confidence_gate(pixels: DataFrame, group: list[str], percent: float, and_valid: bool = True) -> DataFrame:
    """Pixels whose confidence reaches the percentile of the group's valid ones; all frames of the group together.

    Edge pixels (``edge``) and masked-out pixels (``excluded``) count as confidence 0 before the percentile.
    ``and_valid`` false keeps zero-confidence pixels when the threshold is 0.
    """
    conf = F.when(F.col("edge") | F.col("excluded"), F.lit(0.0)).otherwise(F.col("conf"))
    rows = pixels.withColumn("conf_used", conf)
    valid = ~F.isnan("conf_used") & (F.col("conf_used") > 1e-5)
    bars = rows.select(*group).distinct()
    if percent > 0:
        found = quantiles(rows, group, {"q": (F.when(valid, F.col("conf_used")), (percent / 100.0,))})
        bars = bars.join(found, group, "left").select(*group, F.coalesce(F.col("q")[0], F.lit(0.0)).alias("bar"))
    else:
        bars = bars.withColumn("bar", F.lit(0.0))
    keep = F.col("conf_used") >= F.col("bar")
    return rows.join(bars, group).filter((keep & valid) if and_valid else keep)


def lift_boxes(dets: DataFrame, pixels: DataFrame, cameras: DataFrame, grid: tuple[int, int], image: tuple[int, int]) -> DataFrame:
    """(det_id, frame, label, score, cx3, cy3, cz3, sx, sy, sz): 3-D boxes from depth inside 2-D boxes.

    Boxes scale to the depth grid with truncation; at least 4 valid pixels; from 10 on, depths outside p10 to p90 go
    if 4 stay; the centre is the mean, the size the range, at least 0.05. The range join runs inside each frame.
    """
    w, h = grid
    clip = lambda x, a, b: F.least(F.greatest(x, F.lit(float(a))), F.lit(float(b))).cast("long")
    sx, sy = w / image[0], h / image[1]
    boxes = dets.select("det_id", "frame", "label", "score", clip(F.col("x1") * sx, 0, w - 1).alias("bx1"), clip(F.col("y1") * sy, 0, h - 1).alias("by1"), clip(F.col("x2") * sx, 1, w).alias("bx2"), clip(F.col("y2") * sy, 1, h).alias("by2"))
    inside = (F.col("u") >= F.col("bx1")) & (F.col("u") < F.col("bx2")) & (F.col("v") >= F.col("by1")) & (F.col("v") < F.col("by2"))
    hits = boxes.join(pixels.select("frame", "u", "v", "depth"), "frame").filter(inside & (F.col("depth") > 1e-4))
    keys = ["det_id", "frame", "label", "score"]
    bars = hits.groupBy("det_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("depth", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).filter("n >= 4")
    core = (F.col("depth") >= F.col("q")[0]) & (F.col("depth") <= F.col("q")[1])
    marked = hits.join(bars, "det_id").withColumn("core", core)
    counted = marked.groupBy("det_id").agg(F.count_if("core").alias("n_core"))
    kept = marked.join(counted, "det_id").filter((F.col("n") < 10) | (F.col("n_core") < 4) | F.col("core"))
    wx, wy, wz = G.unproject(F.col("u"), F.col("v"), F.col("depth"))
    pts = kept.join(cameras, "frame").select(*keys, wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))
    span = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(0.05))
    return pts.groupBy(*keys).agg(F.avg("wx").alias("cx3"), F.avg("wy").alias("cy3"), F.avg("wz").alias("cz3"), span("wx").alias("sx"), span("wy").alias("sy"), span("wz").alias("sz"))


def reprojection_agreement(points: DataFrame, observations: DataFrame, mask: DataFrame, pixels: DataFrame, cameras: DataFrame, width: int, height: int, least: int = 10) -> DataFrame:
    """(inst_id, agreement): median over ordered observation pairs of the share of a source's points that land in the
    target's mask at the target's depth (two-sided tolerance); pairs with fewer than ``least`` in-bounds points are skipped.

    points(inst_id, obs_id, x, y, z), observations(inst_id, obs_id, frame), mask(obs_id, u, v).
    """
    src = points.join(observations.select("obs_id", F.col("frame").alias("from_frame")), "obs_id")
    tgt = observations.select("inst_id", F.col("obs_id").alias("target"), F.col("frame"))
    pu, pv, pz = G.project(F.col("x"), F.col("y"), F.col("z"))
    pairs = src.join(tgt, "inst_id").filter("from_frame <> frame").join(cameras, "frame")
    spots = sample_depth(pairs.select("inst_id", "obs_id", "target", "frame", pu.alias("pu"), pv.alias("pv"), pz.alias("pz")), pixels, width, height)
    held = mask.select(F.col("obs_id").alias("target"), "u", "v", F.lit(True).alias("in_mask"))
    good = F.coalesce(F.col("in_mask"), F.lit(False)) & (F.col("seen") > 1e-6) & (F.abs(F.col("pz") - F.col("seen")) <= AGREE_RATIO * F.col("seen") + AGREE)
    shares = spots.join(held, ["target", "u", "v"], "left").groupBy("inst_id", "obs_id", "target").agg(F.count(F.lit(1)).alias("n"), F.avg(good.cast("double")).alias("share"))
    return shares.filter(F.col("n") >= least).groupBy("inst_id").agg(F.median("share").alias("agreement"))


def integrate_volume(pixels: DataFrame, cameras: DataFrame, lower: tuple[float, ...], upper: tuple[float, ...], dims: tuple[int, ...], trunc: float, bar: float, width: int, height: int) -> DataFrame:
    """(scene, ix, iy, iz, w, tsdf, r, g, b): truncated signed distances of the scene's grid, fused over its frames.

    Each scene's grid is cut into slabs of SLAB voxels, which are dealt out and then exploded, so a large grid is many tasks; the cameras
    meet the slabs, not the voxels. A voxel takes one pixel of each camera; sums are partial
    aggregates. The sum starts at ``trunc`` with weight 0, as the fusion rule has it; unseen voxels are
    trunc and grey.
    """
    nx, ny, nz = dims
    step = [(b - a) / (n - 1) for a, b, n in zip(lower, upper, dims)]
    at = [F.lit(a) + F.col(c) * F.lit(s) for a, c, s in zip(lower, ("ix", "iy", "iz"), step)]
    slabs = cameras.select("scene").distinct().withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit((nx * ny * nz - 1) // SLAB))))

    def voxels(rows: DataFrame, *kept: str) -> DataFrame:
        last = F.least((F.col("slab") + 1) * SLAB, F.lit(nx * ny * nz)) - 1
        spread = rows.repartition("scene", "slab").withColumn("id", F.explode(F.sequence(F.col("slab") * SLAB, last)))
        return spread.select("scene", *kept, F.floor(F.col("id") / (ny * nz)).alias("ix"), (F.floor(F.col("id") / nz) % ny).alias("iy"), (F.col("id") % nz).cast("long").alias("iz"))

    cells = voxels(slabs)
    views = [c for c in cameras.columns if c != "scene"]
    a, b, c = G.to_camera(*at)
    deep = F.when(c > 0, c).otherwise(F.lit(1.0))
    seen = voxels(slabs.join(cameras, "scene"), *views).select("scene", "ix", "iy", "iz", "frame", (F.col("fx") * a / deep + F.col("cx")).alias("pu"), (F.col("fy") * b / deep + F.col("cy")).alias("pv"), c.alias("pz"))
    hit = seen.filter((F.col("pz") > 0) & F.rint("pu").between(0, width - 1) & F.rint("pv").between(0, height - 1)).withColumns({"u": F.rint("pu").cast("long"), "v": F.rint("pv").cast("long")})
    joined = hit.join(pixels.select("frame", "u", "v", "depth", "conf", "r", "g", "b"), ["frame", "u", "v"])
    sdf = F.col("depth") - F.col("pz")
    ok = joined.filter((F.col("depth") > 0) & (sdf > -trunc) & (F.col("conf") >= bar)).withColumn("s", F.least(F.greatest(sdf, F.lit(-trunc)), F.lit(trunc)))
    sums = ok.groupBy("scene", "ix", "iy", "iz").agg(F.sum("conf").alias("w"), F.sum(F.col("conf") * F.col("s")).alias("ws"), *[F.sum(F.col("conf") * F.col(k)).alias(f"w{k}") for k in "rgb"])
    full = cells.join(sums, ["scene", "ix", "iy", "iz"], "left")
    w = F.coalesce(F.col("w"), F.lit(0.0))
    fused = lambda x, other: F.when(w > 0, x / F.col("w")).otherwise(F.lit(other))
    return full.select("scene", "ix", "iy", "iz", w.alias("w"), fused(F.col("ws") + trunc, trunc).alias("tsdf"), *[fused(F.col(f"w{k}") / 255.0, 0.5).alias(k) for k in "rgb"])


def zero_crossings(volume: DataFrame) -> DataFrame:
    """(scene, ix, iy, iz, axis, t): grid edges where the distance changes sign, with the linear crossing point in [0, 1].

    These are the surface's vertices on grid edges; faces are left to mesh tools.
    """
    out = None
    for axis in ("ix", "iy", "iz"):
        rest = [c for c in ("ix", "iy", "iz") if c != axis]
        nxt = F.lead("tsdf").over(Window.partitionBy("scene", *rest).orderBy(axis))
        a = F.col("tsdf")
        part = volume.withColumn("nxt", nxt).filter((a < 0) != (F.col("nxt") < 0)).select("scene", "ix", "iy", "iz", F.lit(axis).alias("axis"), (a / (a - F.col("nxt"))).alias("t"))
        out = part if out is None else out.unionAll(part)
    return out


def smooth_depth(pixels: DataFrame, radius: int = 4, color: float = 0.03, space: float = 9.0, tile: int = 64) -> DataFrame:
    """(frame, u, v, depth): edge-keeping smoothing of each frame's depth over a disc of neighbours.

    Depth differences are relative to the frame's range. Neighbours outside the image don't count. A frame is cut into square
    tiles, which spread over tasks; only pixels within the radius of a tile's edge are copied, to the tiles they reach. Rows come sorted by tile
    and are smoothed in numpy, some tiles at a time. Pixels that occur twice are pooled; one without depth is no neighbour.
    """
    disc = [(a, b, (a * a + b * b) / (2 * space * space)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    side, by = tile + 2 * radius, ["frame", "tile_u", "tile_v"]

    def begins(t: pa.Table) -> np.ndarray:
        """Rows of another tile than the row before."""
        return 1 + np.flatnonzero(np.logical_or.reduce([pc.not_equal(t[c][1:], t[c][:-1]).to_numpy() for c in by]))

    def smooth(t: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        x, y = (t[c].to_numpy().astype(np.int64) - t[f"from_{c}"].to_numpy() - t[f"tile_{c}"].to_numpy() * tile + radius for c in "uv")
        place = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(t)))
        cell, cells = (place * side + x) * side + y, len(starts) * side * side
        depth, span, known = t["depth"].to_numpy(), t["span"].to_numpy(), t["depth"].is_valid().to_numpy()
        core = (np.minimum(x, y) >= radius) & (np.maximum(x, y) < radius + tile)
        others = depth[known][np.argsort(cell[known], kind="stable")]
        held = np.bincount(cell[known], minlength=cells)
        first = np.cumsum(held) - held
        at, own, span = cell[core & known], depth[core & known], span[core & known]
        top, weight = np.zeros(len(at)), np.zeros(len(at))
        with np.errstate(invalid="ignore", over="ignore"):
            for a, b, far in disc:
                near = at + a * side + b
                for k in range(held[near].max(initial=0)):
                    has = np.flatnonzero(held[near] > k)
                    other = others[first[near[has]] + k]
                    gap = (other - own[has]) / span[has] / color
                    w = np.exp(-far - gap * gap / 2)
                    top[has] += w * other
                    weight[has] += w
            seen, row = np.unique(cell[core], return_index=True)
            none = np.bincount(at, minlength=cells)[seen] == 0
            mean = np.bincount(at, top, minlength=cells)[seen] / np.where(none, 1.0, np.bincount(at, weight, minlength=cells)[seen])
        out = t.select(["frame", "u", "v"]).take(np.flatnonzero(core)[row]).append_column("depth", pa.array(mean, mask=none))
        return out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], begins(t)])
            for k in range(0, len(starts), TILES):
                low, high = starts[k], starts[k + TILES] if k + TILES < len(starts) else len(t)
                yield from smooth(t.slice(low, high - low), starts[k : k + TILES] - low)

        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t, old = (t, 0) if kept is None else (pa.concat_tables([kept, t]), max(len(kept) - 1, 0))
            last = begins(t.slice(old))[-1:]
            if len(last):
                yield from done(t.slice(0, old + last[0]))
                t = t.slice(old + last[0])
            kept = t
        if kept is not None and len(kept):
            yield from done(kept)

    placed = pixels.select("frame", "u", "v", F.col("depth").cast("double").alias("depth")).filter("u is not null and v is not null")
    span = F.greatest(F.max("depth") - F.min("depth"), F.lit(1e-9)).cast("double").alias("span")
    frames = pixels.groupBy("frame").agg(span, *[f(c).cast("long").alias(n + c) for c in "uv" for f, n in ((F.min, "from_"), (F.max, "to_"))])
    within = lambda c, x: F.floor(F.least(F.greatest(x - F.col(f"from_{c}"), F.lit(0)), F.col(f"to_{c}") - F.col(f"from_{c}")) / tile)
    tiles = lambda c: F.explode(F.sequence(within(c, F.col(c) - radius), within(c, F.col(c) + radius))).alias(f"tile_{c}")
    rows = placed.join(frames, "frame").select("*", tiles("u")).select("*", tiles("v")).drop("to_u", "to_v")
    kinds = ", ".join(f"{c} {dict(pixels.dtypes)[c]}" for c in ("frame", "u", "v"))
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"{kinds}, depth double")


def point_cloud(lifted: DataFrame, group: list[str], percent: float, drop_black: bool = False, drop_white: bool = False) -> DataFrame:
    """Lifted pixels (wx, wy, wz, r, g, b, conf) to show: confidence at least the group's percentile, without near-black or near-white background."""
    bars = quantiles(lifted, group, {"q": (F.col("conf"), (percent / 100.0,))}).select(*group, F.col("q")[0].alias("bar"))
    rows = lifted.join(bars, group).filter((F.col("conf") >= F.col("bar")) & (F.col("conf") > 1e-5))
    if drop_black:
        rows = rows.filter(F.col("r") + F.col("g") + F.col("b") >= 16)
    if drop_white:
        rows = rows.filter(~((F.col("r") > 240) & (F.col("g") > 240) & (F.col("b") > 240)))
    return rows.drop("bar")


def padded_crops(boxes: DataFrame, width: int, height: int, pad: float = 0.12) -> DataFrame:
    """Boxes x1 .. y2 widened by a share of their size and cut to the image, as whole pixels; boxes that leave nothing give no row."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    clip = lambda x, top: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(top)).cast("long")
    out = boxes.withColumns({"cx1": clip(F.col("x1") - pad * w, width), "cy1": clip(F.col("y1") - pad * h, height), "cx2": clip(F.col("x2") + pad * w + 1, width), "cy2": clip(F.col("y2") + pad * h + 1, height)})
    return out.filter("cx2 > cx1 and cy2 > cy1")
