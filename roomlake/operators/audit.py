"""Geometry audit of instances: reflections, unsupported objects, stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm
from ..functions.labels import FLOOR_STANDING, PLANAR, has_word


def reflector_containment(mask_pixels: DataFrame, reflectors: DataFrame) -> DataFrame:
    """(det_id, ratio, labels): largest share of a mask inside a reflector's mask of its frame; labels of those with half or more.

    Both: frame, det_id (or refl_id and label), u, v.
    """
    size = mask_pixels.groupBy("det_id").agg(F.count(F.lit(1)).alias("n"))
    hit = mask_pixels.join(reflectors, ["frame", "u", "v"]).filter("det_id <> refl_id").groupBy("det_id", "refl_id", "label").agg(F.count(F.lit(1)).alias("k"))
    share = size.join(hit, "det_id", "left").withColumn("ratio", F.coalesce(F.col("k"), F.lit(0)) / F.greatest("n", F.lit(1)))
    return share.groupBy("det_id").agg(F.max("ratio").alias("ratio"), F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("ratio") >= 0.5, F.col("label"))))).alias("labels"))


def exclude_mask(refs: DataFrame, mask_pixels: DataFrame, openings: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(frame, u, v): pixels of the instances' masks (not of openings), grown by one in a 3 x 3 square, inside the image."""
    held = mask_pixels.join(refs, "det_id", "left_semi").join(openings, "det_id", "left_anti")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    grown = held.withColumn("m", F.explode(steps)).select("frame", (F.col("u") + F.col("m.a")).alias("u"), (F.col("v") + F.col("m.b")).alias("v"))
    return grown.filter(F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1)).distinct()


def stability(obs_bounds: DataFrame) -> DataFrame:
    """(inst_id, centre, extent): how steady an instance's boxes are over its observations with at least 10 points, 0 to 1."""
    rows = obs_bounds.filter(F.col("n_raw") >= 10)
    e = {c: F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-6)) for c in "xyz"}
    rows = rows.select("inst_id", *[e[c].alias(f"e{c}") for c in "xyz"], *[F.col(f"c_{c}").alias(f"c{c}") for c in "xyz"])
    ref = rows.groupBy("inst_id").agg(*[F.median(f"e{c}").alias(f"re{c}") for c in "xyz"], *[F.median(f"c{c}").alias(f"rc{c}") for c in "xyz"])
    j = rows.join(ref, "inst_id").withColumn("drift", norm(*[F.col(f"c{c}") - F.col(f"rc{c}") for c in "xyz"])).withColumn("D", F.greatest(norm(*[F.col(f"re{c}") for c in "xyz"]), F.lit(1e-6)))
    gaps = F.array(*[F.abs(F.col(f"e{c}") - F.col(f"re{c}")) / F.greatest(F.col(f"re{c}"), F.lit(1e-6)) for c in "xyz"])
    centre = j.groupBy("inst_id").agg(F.exp(-F.median("drift") / (0.20 * F.first("D"))).alias("centre"))
    extent = j.select("inst_id", F.explode(gaps).alias("g")).groupBy("inst_id").agg(F.exp(-F.median("g") / 0.35).alias("extent"))
    return centre.join(extent, "inst_id")


def planarity(points: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """(keys, planarity, normal_y): flatness of each cloud and the vertical part of its normal; covariance by aggregate, 3 x 3 eigen in Arrow batches."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    cov = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(a + b) for a, b in pairs]).filter(F.col("n") >= least)
    names = [a + b for a, b in pairs]

    def run(frames):
        for f in frames:
            m = np.empty((len(f), 3, 3))
            for (a, b), name in zip(pairs, names):
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = f[name]
            values, vectors = np.linalg.eigh(m)
            out = f[keys].copy()
            out["planarity"] = np.clip(1 - np.maximum(values[:, 0], 0) / np.maximum(values[:, 2], 1e-9) / 0.08, 0, 1)
            out["normal_y"] = np.abs(vectors[:, 1, 0])
            yield out

    types = dict(cov.dtypes)
    return cov.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", planarity double, normal_y double")


def evidence(seen: DataFrame, overlap: DataFrame, steady: DataFrame, flat: DataFrame, reflected: DataFrame | None = None, agreement: DataFrame | None = None) -> DataFrame:
    """What audit needs, one row an instance of ``seen`` (inst_id, label, frames, floor_gap, ...), joined from its sources.

    overlap: median_pair_overlap; steady: stability; flat: planarity by inst_id; reflected: inst_id, hits, inside (from
    reflector_ratios); agreement: reprojection_agreement. What an instance lacks counts as 0, but an unknown agreement stays null.
    """
    rows = seen.join(overlap, "inst_id", "left").join(steady, "inst_id", "left").join(flat, "inst_id", "left")
    rows = rows.join(reflected, "inst_id", "left") if reflected is not None else rows.withColumns({"hits": F.lit(0).cast("long"), "inside": F.lit(0.0)})
    rows = rows.join(agreement.withColumnRenamed("agreement", "reprojection"), "inst_id", "left") if agreement is not None else rows.withColumn("reprojection", F.lit(None).cast("double"))
    return rows.fillna(0.0, ["overlap", "centre", "extent", "planarity", "normal_y", "inside"]).fillna(0, ["hits"])


def reflector_ratios(contained: DataFrame, members: DataFrame) -> DataFrame:
    """(inst_id, hits, inside): frames in which an instance's mask is 0.70 or more inside a reflector; median of its ratios of 0.50 or more.

    contained: det_id, ratio (reflector_containment); members: inst_id, det_id, frame.
    """
    rows = members.join(contained, "det_id")
    hits = F.countDistinct(F.when(F.col("ratio") >= 0.70, F.col("frame")))
    return rows.groupBy("inst_id").agg(hits.alias("hits"), F.coalesce(F.median(F.when(F.col("ratio") >= 0.50, F.col("ratio"))), F.lit(0.0)).alias("inside"))


def audit(evidence: DataFrame, places: int = 3) -> DataFrame:
    """Evidence with geometry, reflection and status.

    evidence: inst_id, label, frames, hits (frames with inside ratio 0.70 or more), inside (median of ratios of 0.50 or more), overlap, reprojection
    (null if unknown), centre, extent, planarity, normal_y, floor_gap, room_height. Order of tests: reflection, unsupported, uncertain, accepted.
    """
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    c = F.col
    vertical = (c("planarity") >= 0.75) & (F.abs("normal_y") <= 0.45)
    rows = evidence.withColumn("category_conflict", ~has_word(c("label"), PLANAR) & vertical)
    known = c("reprojection").isNotNull()
    rows = rows.withColumn("geometry", clip(F.when(known, 0.30 * c("overlap") + 0.30 * c("reprojection") + 0.20 * c("centre") + 0.20 * c("extent")).otherwise(0.50 * c("overlap") + 0.25 * c("centre") + 0.25 * c("extent"))))
    views = (c("frames") >= 2) & (c("overlap") < 0.15) & (F.coalesce(c("reprojection") < 0.25, F.lit(False)) | (c("centre") < 0.50))
    rows = rows.withColumn("conflict", c("category_conflict") | views)
    rows = rows.withColumn("reflection", F.when(c("inside") > 0, clip(0.55 * c("inside") + 0.25 * c("conflict").cast("double") + 0.20 * (1 - c("overlap")))).otherwise(0.0))
    mirrored = (c("frames") >= 2) & (c("hits") >= 2) & (c("inside") >= 0.70) & c("conflict") & (c("reflection") >= 0.65)
    gap = F.when(has_word(c("label"), FLOOR_STANDING), F.greatest("floor_gap", F.lit(0.0)) / F.greatest("room_height", F.lit(1e-6))).otherwise(0.0)
    status = F.when(mirrored, "rejected_reflection").when((c("frames") <= 3) & (gap >= 0.30), "rejected_unsupported").when((c("inside") >= 0.50) | (c("frames") < 2), "uncertain").otherwise("accepted")
    return rows.select("inst_id", F.round("geometry", places).alias("geometry"), F.round("reflection", places).alias("reflection"), "conflict", status.alias("status"))


def split_by_status(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) instances of an audit."""
    bad = F.col("status").startswith("rejected")
    return audited.filter(~bad), audited.filter(bad)


def median_pair_overlap(support: DataFrame, members: DataFrame) -> DataFrame:
    """(inst_id, overlap): median mutual overlap over an instance's observation pairs of different frames."""
    a = members.select(F.col("obs_id").alias("earlier"), "inst_id", F.col("frame").alias("fa"))
    b = members.select(F.col("obs_id").alias("later"), F.col("inst_id").alias("ib"), F.col("frame").alias("fb"))
    rows = support.join(a, "earlier").join(b, "later").filter("inst_id = ib and fa <> fb")
    return rows.groupBy("inst_id").agg(F.median("support_mean").alias("overlap"))


