"""Label review: suggestions and decisions that come from outside the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import canonical_label, clean_label

REJECT_AT, RELABEL_AT = 0.85, 0.70


def suggest_labels(suggestions: DataFrame, sampled_frames: int, least: float = 0.65, single_view: float = 0.85, most: int = 10) -> DataFrame:
    """(batch, label, confidence, frames_seen, place): the best supported canonical labels of each batch.

    A suggestion counts if it is major, its label is known and it is supported: one frame sampled, seen twice,
    very confident, or an opening. Ties in (confidence, frames) go to the label that was suggested first.
    """
    frames = F.least(F.greatest(F.col("frames_seen"), F.lit(0)), F.lit(max(sampled_frames, 1)))
    rows = suggestions.filter("major").withColumns({
        "label": canonical_label(F.col("label")), "confidence": F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)), "frames_seen": frames,
    }).filter("label is not null")
    supported = F.lit(sampled_frames <= 1) | (F.col("frames_seen") >= 2) | (F.col("confidence") >= single_view) | F.col("label").isin("door", "window")
    good = rows.filter((F.col("confidence") >= least) & supported)
    best = good.groupBy("batch", "label").agg(F.max(F.struct("confidence", "frames_seen")).alias("m"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("m.confidence"), F.desc("m.frames_seen"), "first"))
    return best.withColumn("place", place.cast("long")).filter(F.col("place") <= max(most, 1)).select("batch", "label", "m.confidence", "m.frames_seen", "place")


def apply_decisions(instances: DataFrame, decisions: DataFrame) -> DataFrame:
    """Instances with status and label after review: the first valid decision of an instance counts.

    reject needs confidence REJECT_AT; relabel needs RELABEL_AT, a clean label and a change. Label wins its canonical name if it has one.
    """
    named = F.coalesce(canonical_label(F.col("new_label")), clean_label(F.col("new_label")))
    valid = decisions.withColumn("new_label", named).filter(F.col("action").isin("keep", "reject") | ((F.col("action") == "relabel") & F.col("new_label").isNotNull()))
    first = valid.withColumn("rn", F.row_number().over(Window.partitionBy("inst_id").orderBy("ord"))).filter("rn = 1").select("inst_id", "action", "new_label", "confidence")
    joined = instances.join(first, "inst_id", "left")
    sure = F.coalesce(F.col("confidence"), F.lit(0.0))
    relabel = (F.col("action") == "relabel") & (sure >= RELABEL_AT) & (F.col("new_label") != F.col("label"))
    status = F.when((F.col("action") == "reject") & (sure >= REJECT_AT), "rejected").when(relabel, "relabelled").otherwise("kept")
    return joined.select("inst_id", F.col("label").alias("original_label"), F.when(status == "relabelled", F.col("new_label")).otherwise(F.col("label")).alias("label"), status.alias("status"))


def propagate_labels(children: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Observations or detections with their instance's reviewed label; those of rejected instances go."""
    names = reviewed.filter("status <> 'rejected'").select("inst_id", F.col("label").alias("_label"))
    return children.join(names, "inst_id").withColumn("label", F.col("_label")).drop("_label")


def review_batches(instances: DataFrame, most: int = 24, size: int = 12) -> DataFrame:
    """(scene, inst_id, batch): the ``most`` best seen instances of a scene in batches of ``size``."""
    rn = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("frames_seen"), F.desc("score"), "inst_id"))
    return instances.withColumn("rn", rn).filter(F.col("rn") <= most).select("scene", "inst_id", F.floor((F.col("rn") - 1) / size).alias("batch"))
