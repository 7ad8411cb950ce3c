"""Binary models and the command line."""

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from roomlake import cli
from roomlake.operators import assets
from roomlake.sources import glb

CUBE = np.array([[k >> 2 & 1, k >> 1 & 1, k & 1] for k in range(8)], float)
SIDES = np.array([[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]])


def edited(content, change):
    spec, blob = glb._chunks(content)
    change(spec)
    text = json.dumps(spec).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), glb.JSON_CHUNK) + text + struct.pack("<II", len(blob), glb.BIN_CHUNK) + blob
    return struct.pack("<III", glb.MAGIC, 2, 12 + len(body)) + body


def test_round_trip_and_nodes():
    made = glb.build(CUBE, SIDES, np.full((8, 4), 200))
    vertices, faces = glb.parse(made)
    assert np.allclose(vertices, CUBE) and (faces == SIDES).all()

    def nest(spec):
        spec["nodes"] = [{"children": [1], "translation": [10, 0, 0]}, {"mesh": 0, "scale": [2, 1, 1], "rotation": [0, 2**-0.5, 0, 2**-0.5]}, {"mesh": 0}]

    moved, _ = glb.parse(edited(made, nest))
    # scaled along x, turned a quarter about +Y (x to -z, z to x), then moved
    assert np.allclose(moved, np.column_stack([CUBE[:, 2] + 10, CUBE[:, 1], -2 * CUBE[:, 0]]), atol=1e-6)
    plain, order = glb.parse(edited(glb.build(CUBE[SIDES.ravel()], np.arange(36)), lambda s: s["meshes"][0]["primitives"][0].pop("indices")))
    assert len(plain) == 36 and (order.ravel() == np.arange(36)).all()


def test_what_cannot_be_read():
    made = glb.build(CUBE, SIDES)
    circle = edited(made, lambda s: s["nodes"][0].update(children=[0]))
    short = edited(made, lambda s: s["accessors"][1].update(count=9999))
    lines = edited(made, lambda s: s["meshes"][0]["primitives"][0].update(mode=1))
    for content in (b"", b"glTF", made[:40], b"x" * 200, circle, short, lines, edited(made, lambda s: s.pop("meshes"))):
        assert glb.parse(content) is None


def test_tables_of_models(spark):
    files = spark.createDataFrame([(1, bytearray(glb.build(CUBE * [2, 4, 8], SIDES))), (2, bytearray(b"junk")), (3, None)], "mesh_id long, content binary")
    vertices, faces = glb.model_vertices(files), glb.model_faces(files)
    assert vertices.count() == 8 and faces.count() == 12
    sizes = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "mesh_id long, w double, h double, d double")
    local = assets.local_mesh(vertices, sizes)
    (box,) = local.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    assert tuple(box) == (-0.5, 0.5, 0.0, 2.0, -1.5, 1.5)
    (back,) = glb.model_files(local.withColumns({c: F.lit(90) for c in "rgb"}), faces).collect()
    again, order = glb.parse(bytes(back.content))
    assert back.mesh_id == 1 and np.allclose(np.ptp(again, axis=0), [1, 2, 3]) and (order == SIDES).all()
    assert glb.model_files(local, faces.limit(0)).count() == 0


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(6)
    points, obs = [], []
    for scene in (4, 5):
        for f in range(3):
            n = scene * 10 + f
            obs.append((scene, n, n, f, "chair", 0.9, 0.0, 0.0, 50.0, 50.0))
            points += [(scene, n, f, n * 1000 + k, *map(float, p)) for k, p in enumerate(rng.uniform((0, 0, 0), (0.5, 0.9, 0.5), (150, 3)))]
    spark.createDataFrame(points, "scene long, obs_id long, frame long, pid long, x double, y double, z double").write.parquet(f"{tmp_path}/points")
    spark.createDataFrame(obs, "scene long, obs_id long, ord long, frame long, label string, score double, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{tmp_path}/obs")
    cli.main([f"{tmp_path}/points", f"{tmp_path}/obs", f"{tmp_path}/out", "--name", "5"])
    (doc,) = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/documents").collect()]
    assert doc["name"] == "5" and [o["label"] for o in doc["objects"]] == ["chair"]
    assert cli.arguments(["a", "b", "c"]).reuse_duplicates is False
