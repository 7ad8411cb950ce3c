"""The scene document as a table of objects: edits, asset garbage, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LABEL, SCALE_RANGE, MAX_MODEL_BYTES = 100, (0.01, 100.0), 100 * 1024 * 1024


def valid_name(name: Column) -> Column:
    """Whether a scene or object name can't leave its folder."""
    return ~(name.contains("/") | name.contains("\\") | name.contains(".."))


def valid_label(label: Column) -> Column:
    text = F.trim(label)
    return (F.length(text) > 0) & (F.length(text) <= MAX_LABEL) & ~text.rlike(r"[\x00-\x1f]")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_model(content: Column) -> Column:
    """Whether bytes look like a binary model of an accepted size."""
    return (F.octet_length(content) <= MAX_MODEL_BYTES) & (F.substring(content, 1, 4) == F.lit(b"glTF"))


def merge_layout(objects: DataFrame, updates: DataFrame) -> DataFrame:
    """Objects after layout updates, with ``updated``.

    Of updates for one object the last counts; updates of unknown objects are ignored; position and yaw are required and finite,
    the scale keeps its stored value or 1 and must be in range. One bad label, or one bad update of a matched object, rejects all of
    its scene's updates, as one request is a scene's. updates: ord, obj_id, label, px, py, pz, yaw, editor_scale.
    """
    last = updates.withColumn("rn", F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("ord")))).filter("rn = 1")
    u = last.select("obj_id", F.lit(True).alias("hit"), *[F.col(c).alias(f"u_{c}") for c in ("label", "px", "py", "pz", "yaw", "editor_scale")])
    rows = objects.join(u, "obj_id", "left")
    scale = F.coalesce("u_editor_scale", "editor_scale", F.lit(1.0))
    good = finite(F.col("u_px")) & finite(F.col("u_py")) & finite(F.col("u_pz")) & finite(F.col("u_yaw")) & scale.between(*SCALE_RANGE) & (F.col("u_label").isNull() | valid_label(F.col("u_label")))
    refused = F.coalesce(F.max(F.col("hit") & ~F.coalesce(good, F.lit(False))).over(Window.partitionBy("scene")), F.lit(False))
    rows = rows.withColumn("go", F.coalesce(F.col("hit"), F.lit(False)) & ~refused)
    pick = lambda new, old: F.when(F.col("go"), new).otherwise(old)
    return rows.select(
        "scene", "obj_id", pick(F.coalesce(F.trim("u_label"), "label"), F.col("label")).alias("label"), *[pick(F.round(f"u_{c}", 4), F.col(c)).alias(c) for c in ("px", "py", "pz")],
        pick(F.round("u_yaw", 5), F.col("yaw")).alias("yaw"), pick(F.round(scale, 5), F.col("editor_scale")).alias("editor_scale"), "glb", F.col("go").alias("updated"),
    )


def delete_objects(objects: DataFrame, deleted: DataFrame) -> DataFrame:
    """Objects that stay."""
    return objects.join(deleted, ["scene", "obj_id"], "left_anti")


def asset_garbage(objects: DataFrame, deleted: DataFrame) -> DataFrame:
    """(scene, path): assets of deleted objects that no object of the scene still uses: their model and its custom and generated variants."""
    gone = objects.join(deleted, ["scene", "obj_id"], "left_semi")
    name = F.col("obj_id").cast("string")
    own = F.array(F.col("glb"), *[F.concat(F.lit("objects/"), name, F.lit(s)) for s in (".glb", "_custom.glb", "_trellis.glb")])
    paths = gone.select("scene", F.explode(F.array_compact(own)).alias("path")).filter(F.col("path").startswith("objects/") & ~F.col("path").contains("..")).distinct()
    used = delete_objects(objects, deleted).select("scene", F.col("glb").alias("path")).filter("path is not null").distinct()
    return paths.join(used, ["scene", "path"], "left_anti")


def add_objects(objects: DataFrame, models: DataFrame) -> DataFrame:
    """Objects plus one for each uploaded model (scene, obj_id, label, glb, lo_ and hi_ xyz): at the origin, with its own size and a bottom-centre offset."""
    fresh = models.filter(valid_label(F.col("label"))).select(
        "scene", "obj_id", F.trim("label").alias("label"), *[F.lit(0.0).alias(c) for c in ("px", "py", "pz", "yaw")], F.lit(1.0).alias("editor_scale"), "glb",
    )
    return objects.unionByName(fresh)


def replace_models(objects: DataFrame, fits: DataFrame, suffix: str = "_custom", source: str = "custom-upload") -> DataFrame:
    """Objects with new models: glb is the object's own file, source is set, and a shared asset is let go.

    A generated model (``suffix`` "_trellis") is a replacement whose scale starts anew.
    """
    named = F.concat(F.lit("objects/"), F.col("obj_id").cast("string"), F.lit(f"{suffix}.glb"))
    hit = fits.select("scene", "obj_id", F.lit(True).alias("hit")).distinct()
    rows = objects.join(hit, ["scene", "obj_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rows.withColumns({"glb": F.when(F.col("hit"), named).otherwise(F.col("glb")), "source": F.when(F.col("hit"), F.lit(source)), "editor_scale": F.when(F.col("hit"), F.lit(1.0)).otherwise(F.col("editor_scale"))}).drop("hit")


def scene_documents(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """(scene, document): one JSON text a scene, objects in id order."""
    entry = F.struct("obj_id", "label", F.array("px", "py", "pz").alias("position"), "yaw", "glb")
    lists = objects.groupBy("scene").agg(F.sort_array(F.collect_list(entry)).alias("objects"))
    room = F.struct((F.col("xmax") - F.col("xmin")).alias("width"), (F.col("zmax") - F.col("zmin")).alias("depth"), "height")
    return lists.join(rooms, "scene").select("scene", F.to_json(F.struct(F.col("scene").cast("string").alias("name"), room.alias("room"), "objects")).alias("document"))


def write_scene_documents(documents: DataFrame, path: str) -> None:
    """Replace the documents at ``path``; Spark's commit makes the new version visible at once."""
    documents.select("document").write.mode("overwrite").text(path)


def scene_summary(objects: DataFrame) -> DataFrame:
    """(scene, n_objects, n_reused, n_labels): counts for the document's summary."""
    return objects.groupBy("scene").agg(F.count(F.lit(1)).alias("n_objects"), (F.count("glb") - F.countDistinct("glb")).alias("n_reused"), F.countDistinct("label").alias("n_labels"))
