"""Scene builds from the command line: spark-submit roomlake/cli.py POINTS OBSERVATIONS OUT.

POINTS and OBSERVATIONS are Parquet tables as of plans.scene.assemble_scene. OUT gets objects, rejected, rooms and summary as Parquet and
documents as JSON text, one line a scene; what stood there is replaced.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F

from roomlake.operators import scene_objects
from roomlake.plans.hooks import SceneHooks
from roomlake.plans.scene import assemble_scene
from roomlake.session import build_session


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Objects of scans, from observations and their points")
    parser.add_argument("points", help="Parquet: scene, obs_id, frame, pid, x, y, z")
    parser.add_argument("observations", help="Parquet: scene, obs_id, ord, frame, label, score, x1, y1, x2, y2")
    parser.add_argument("out", help="folder of the results")
    parser.add_argument("--name", type=int, default=None, help="only this scene")
    parser.add_argument("--tolerance", type=float, default=0.12, help="height above the floor up to which an object stands on it")
    parser.add_argument("--reuse-duplicates", action="store_true", help="objects of one label and size share an asset")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = build_session("scene build")
    points, observations = spark.read.parquet(args.points), spark.read.parquet(args.observations)
    if args.name is not None:
        points, observations = points.filter(F.col("scene") == args.name), observations.filter(F.col("scene") == args.name)
    hooks = SceneHooks(progress=lambda share, name: print(f"{share:4.0%} {name}", file=sys.stderr))
    got = assemble_scene(points, observations, hooks, args.tolerance)
    if not args.reuse_duplicates:
        got["objects"] = got["objects"].withColumns({"rep": F.col("inst_id"), "glb": F.concat(F.lit("objects/"), F.col("inst_id"), F.lit(".glb"))})
    for name, df in got.items():
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    objects, rooms = (spark.read.parquet(f"{args.out}/{n}") for n in ("objects", "rooms"))
    documents = scene_objects.scene_documents(objects.withColumn("obj_id", F.col("inst_id")), rooms)
    scene_objects.write_scene_documents(documents, f"{args.out}/documents")
    for row in spark.read.parquet(f"{args.out}/summary").orderBy("scene").limit(20).collect():
        print(row.asDict())


if __name__ == "__main__":
    main()
