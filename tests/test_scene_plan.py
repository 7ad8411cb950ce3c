"""The whole scene plan, its hooks, placements, and functions without SQL of their own."""

import json
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlake.operators import assets, placements, projection, quantiles, sampling, scene_objects
from roomlake.plans import hooks, scene
from roomlake.registry import all_queries
from roomlake.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scan(spark):
    """(points, observations) of three chairs, two racks, a ghost and a chair that floats; every object is seen in four frames but the last in two."""
    rng = np.random.default_rng(1)
    things = [("chair", (0.0, 0.0, 0.0), 0.8, range(4)), ("chair", (3.0, 0.0, 0.0), 0.8, range(4)), ("chair", (0.0, 0.0, 4.0), 0.8, range(4)), ("server rack", (5.0, 0.0, 3.0), 2.0, range(4)), ("server rack", (3.0, 0.0, 6.0), 2.0, range(4)), ("chair", (6.0, 1.2, 0.0), 0.6, range(2)), ("table", (8.0, 0.0, 8.0), 0.5, range(1))]
    points, obs, n = [], [], 0
    for k, (label, at, height, frames) in enumerate(things):
        for f in frames:
            score = 0.3 if label == "table" else 0.6 + 0.05 * f
            obs.append((0, n, n, f, label, score, 100.0 * k, 0.0, 100.0 * k + 80, 60.0))
            for x, y, z in rng.uniform((-0.3, 0, -0.3), (0.3, height, 0.3), (160, 3)) + at:
                points.append((0, n, f, len(points), float(x), float(y), float(z)))
            n += 1
    for x, z in rng.uniform((-0.5, -0.5), (8.5, 8.5), (400, 2)):  # the floor, of no object
        points.append((0, 900, 0, len(points), float(x), 0.0, float(z)))
    return (
        spark.createDataFrame(points, "scene long, obs_id long, frame long, pid long, x double, y double, z double"),
        spark.createDataFrame(obs, "scene long, obs_id long, ord long, frame long, label string, score double, x1 double, y1 double, x2 double, y2 double"),
    )


def test_whole_scene(spark, scan):
    seen = []
    got = scene.assemble_scene(*scan, hooks.SceneHooks(progress=lambda share, name: seen.append(name)))
    objects = got["objects"].collect()
    assert sorted(r.label for r in objects) == ["chair"] * 3 + ["server rack"] * 2
    assert all(abs(r.h - {"chair": 0.8, "server rack": 2.0}[r.label]) < 0.1 and abs(r.w - 0.6) < 0.1 and r.py == pytest.approx(0, abs=0.02) for r in objects)
    assert [r.status for r in got["rejected"].collect()] == ["rejected_unsupported"]
    (room,), (summary,) = got["rooms"].collect(), got["summary"].collect()
    assert room.xmin < 0.5 and room.zmax > 5 and (summary.n_objects, summary.n_rejected, summary.n_labels) == (5, 1, 2)
    assert seen == ["observations", "tracks", "review", "audit", "placement", "objects", "done"]


def test_review_generation_and_their_failures(spark, scan):
    def decide(voted):
        racks = voted.filter("label = 'server rack'").select("inst_id", F.lit("reject").alias("action"), F.lit(None).cast("string").alias("new_label"), F.lit(0.95).alias("confidence"), F.lit(0).alias("ord"))
        return racks.unionAll(voted.filter("label = 'chair'").select("inst_id", F.lit("relabel"), F.lit("couch seat"), F.lit(0.9), F.lit(0)))

    made = lambda objects: objects.select("inst_id", F.lit("made.glb").alias("glb"))
    got = scene.assemble_scene(*scan, hooks.SceneHooks(review=decide, generate=made))["objects"].collect()
    assert {(r.label, r.glb) for r in got} == {("couch seat", "made.glb")}

    def broken(df):
        return df.withColumn("inst_id", F.raise_error(F.lit("no service")).cast("long"))

    def aborted():
        raise RuntimeError("no listener")

    hooks.set_object_generator(broken)
    try:
        kept = scene.assemble_scene(*scan, hooks.SceneHooks(review=broken, progress=lambda *_: aborted()))["objects"].collect()
    finally:
        hooks.set_object_generator(None)
    assert sorted(r.label for r in kept) == ["chair"] * 3 + ["server rack"] * 2 and all(r.glb == f"objects/{r.rep}.glb" for r in kept)
    with pytest.raises(hooks.BuildAborted):
        scene.assemble_scene(*scan, hooks.SceneHooks(abort=lambda: True))


def test_nothing_seen(spark, scan):
    got = scene.assemble_scene(scan[0].limit(0), scan[1].limit(0))
    assert got["objects"].count() == got["summary"].count() == 0


PLACED = "scene long, inst_id long, rank long, px double, py double, pz double, yaw double, w double, h double, d double"


def test_placed_duplicates_rules(spark):
    rows = [
        (0, 1, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.6), (0, 2, 1, 0.05, 0.0, 0.0, math.pi / 2, 0.6, 1.0, 1.0),  # a quarter turn off, else the same
        (0, 3, 2, 0.0, 0.0, 0.0, 0.0, 0.2, 0.2, 0.2),  # small, inside
        (0, 4, 3, 5.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.6), (0, 5, 4, 5.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.6),  # seen apart
        (0, 6, 5, 9.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 7, 6, 9.4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0),  # held by 0.6: clouds decide
        (1, 8, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.6),  # another scene
    ]
    boxes = placements.placement_boxes(spark.createDataFrame(rows, PLACED))
    found = placements.placed_candidates(boxes, spark.createDataFrame([(5, 4)], "a long, b long"), "scene")
    assert [tuple(r) for r in placements.needs_support(found).collect()] == [(6, 7)]
    pairs = lambda *s: sorted((r.earlier, r.later) for r in placements.placed_duplicates(found, spark.createDataFrame(list(s), "earlier long, later long, support_max double, support_mean double"), "scene").collect())
    assert pairs() == [(1, 2)] and pairs((6, 7, 0.5, 0.2)) == [(1, 2), (6, 7)]


def test_cluster_observations_by_the_rule(spark):
    """The registered query against the rule, one observation at a time."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s")).collect()
    groups = {}
    for r in rows:
        obs = r.l_orderkey * 10 + r.l_linenumber
        groups.setdefault((r.l_orderkey // 20, ["monitor", "table", "chair"][r.p % 3]), []).append((obs, r.l_linenumber, r.s % 6, (20 + r.p % 80) / 100, (r.l_orderkey % 20, r.l_linenumber / 20, 0.0), obs % 300))
    want = {}
    for members in groups.values():
        items = sorted(members, key=lambda o: (-o[3], o[1]))
        used = set()
        for i, seed in enumerate(items):
            if seed[0] in used:
                continue
            used.add(seed[0])
            cluster = [seed]
            far = lambda o: math.dist(o[4], seed[4])
            for o in sorted((o for o in items[i + 1 :] if o[0] not in used), key=far):
                apart = lambda m: max(0, 60 - abs(m[5] - o[5])) / (120 - max(0, 60 - abs(m[5] - o[5]))) <= 0.15
                if far(o) < 0.6 and not any(m[2] == o[2] and apart(m) for m in cluster):
                    used.add(o[0])
                    cluster.append(o)
            frames = len({m[2] for m in cluster})
            for m in cluster:
                want[m[0]] = (seed[0], frames, frames >= 2 or max(x[3] for x in cluster) >= 0.45)
    got = {r.obs_id: (r.cluster, r.frames_seen, r.kept) for r in all_queries()["cluster_observations"](spark, SF).collect()}
    ties = {k for k in want if want[k] != got[k]}
    assert set(got) == set(want) and not ties


def test_scene_transform():
    turn = np.array([[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]])
    m = projection.scene_transform(turn, np.array([1.0, 2.0, 3.0]))
    seen = np.linalg.inv(np.vstack([np.column_stack([turn, [1.0, 2.0, 3.0]]), [0, 0, 0, 1]])) @ np.diag([1, -1, -1, 1])
    assert np.allclose(m, seen) and np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))


def test_level_rotation_finds_the_tilt(spark):
    rng, tilt, rows = np.random.default_rng(2), math.radians(7), []
    turn = np.array([[1, 0, 0], [0, math.cos(tilt), -math.sin(tilt)], [0, math.sin(tilt), math.cos(tilt)]])
    for k, p in enumerate(np.concatenate([rng.uniform((-3, 0, -3), (3, 0.01, 3), (3000, 3)), rng.uniform((-3, 0, -3), (3, 2.5, 3), (2000, 3))]) @ turn.T):
        rows.append((0, k, *map(float, p)))
    ups = spark.createDataFrame([(0, 0.0, 1.0, 0.0, True)], "scene long, ux double, uy double, uz double, trusted boolean")
    (r,) = assets.level_rotations(spark.createDataFrame(rows, "scene long, pid long, x double, y double, z double"), ups).collect()
    got = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(got @ turn @ [0, 1, 0], [0, 1, 0], atol=0.01) and np.allclose(got @ got.T, np.eye(3))


def test_wide_samples_equal_narrow_ones(spark):
    # one scene holds nine tenths of the rows, with uneven keys
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("scene"), (F.col("id") * F.col("id") - 7).alias("pid"))
    show = lambda x: sorted((r.scene, r.pid) for r in x.collect())
    for sample, k in ((sampling.linspace_sample, 37), (sampling.stride_sample, 100)):
        assert show(sample(df, ["scene"], ["pid"], k, wide=True)) == show(sample(df, ["scene"], ["pid"], k))


def test_quantiles_equal_the_aggregate(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(k % 10 > 0), float(v), float(round(v)) if k % 4 else None) for k, v in enumerate(np.concatenate([rng.normal(size=900), rng.exponential(50, 300), np.full(500, 7.0)]))] + [(2, 5.0, None), (3, float("nan"), None)]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(5)
    share = (0.0, 0.02, 0.5, 0.513, 0.98, 1.0)
    want = {r.g: (r.x, r.y) for r in df.filter("g < 3").groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, share))).alias(c) for c in "xy"]).collect()}
    for bins in (4096, 3, 1):
        monkeypatch.setattr(quantiles, "BINS", bins)
        got = {r.g: (r.x, r.y) for r in quantiles.quantiles(df, ["g"], {c: (F.col(c), share) for c in "xy"}).collect()}
        assert set(got) == set(want)
        for g in want:
            for a, b in zip(got[g], want[g]):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12))


def _most_rows(plan) -> int:
    """The most rows that a node of an executed plan made."""
    kind, made = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return max([made.get().value() if made.isDefined() else 0, *map(_most_rows, below)])


def test_smooth_depth_copies_few_pixels(spark):
    pixels = spark.range(8 * 500).selectExpr("id div 500 as frame", "id % 25 as u", "id div 25 % 20 as v", "(id * 97 % 2500) / 1000D as depth")
    smooth = projection.smooth_depth(pixels)
    assert len(smooth.collect()) == 4000
    assert _most_rows(smooth._jdf.queryExecution().executedPlan()) <= 2 * 4000


@pytest.mark.parametrize("tile, batch, tiles", [(64, 10_000, 32), (5, 10_000, 3), (3, 7, 2)])
def test_smooth_depth_by_the_rule(spark, monkeypatch, tile, batch, tiles):
    """Tiles and batches of any size against every pair: holes, pixels that occur twice, pixels without depth or place."""
    rng, rows = np.random.default_rng(6), []
    for frame, (low, wide, high) in {"a": (-7, 23, 17), "b": (100, 9, 30), "c": (0, 1, 1)}.items():
        for u in range(low, low + wide):
            for v in range(3, 3 + high):
                for _ in range(rng.choice([0, 1, 1, 1, 3]) if wide > 1 else 1):
                    rows.append((frame, u, v, None if rng.random() < 0.1 else float(rng.uniform(0.5, 3))))
    rows += [("a", 500, 500, 9.0), ("b", 0, 3, None), ("b", None, 3, 20.0), ("d", 1, 1, None)]
    want = {}
    for frame in "abcd":
        mine = [r[1:] for r in rows if r[0] == frame and r[1] is not None]
        known = np.array([r for r in mine if r[2] is not None], float).reshape(-1, 3)
        span = max(np.ptp([r[3] for r in rows if r[0] == frame and r[3] is not None] or [0.0]), 1e-9)
        for u, v in {r[:2] for r in mine}:
            top = weight = 0.0
            for own in known[(known[:, 0] == u) & (known[:, 1] == v), 2]:
                far = (known[:, 0] - u) ** 2 + (known[:, 1] - v) ** 2
                w = np.where(far <= 16, np.exp(-far / 162 - ((known[:, 2] - own) / span / 0.3) ** 2 / 2), 0)
                top, weight = top + (w * known[:, 2]).sum(), weight + w.sum()
            want[frame, u, v] = top / weight if weight else None
    monkeypatch.setattr(projection, "TILES", tiles, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        pixels = spark.createDataFrame(rows, "frame string, u int, v int, depth double").repartition(5)
        got = [((r.frame, r.u, r.v), r.depth) for r in projection.smooth_depth(pixels, color=0.3, tile=tile).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and dict(got).keys() == want.keys()
    assert all((d is None) == (want[k] is None) and (d is None or d == pytest.approx(want[k], abs=1e-9)) for k, d in got)


def test_names_models_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("scan 1", bytearray(b"glTF1234")), ("../x", bytearray(b"glT")), ("a/b", None), ("a\\b", bytearray(b"xglTF"))], "name string, body binary")
    assert [tuple(r) for r in df.select(scene_objects.valid_name(F.col("name")), F.coalesce(scene_objects.valid_model(F.col("body")), F.lit(False))).collect()] == [(True, True), (False, False), (False, False), (False, False)]
    for n in (5, 2):  # the second writing replaces the first
        docs = all_queries()["scene_json"](spark, SF).limit(n)
        scene_objects.write_scene_documents(docs, f"{tmp_path}/scenes")
        back = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/scenes").collect()]
        assert len(back) == min(n, all_queries()["scene_json"](spark, SF).count()) and all({"name", "room", "objects"} == set(d) for d in back)


def test_cancel_job_stops_its_work(spark):
    ended = []

    def work():
        spark.sparkContext.addJobTag("job-7")
        try:
            spark.range(0, 1 << 40, 1, 4).selectExpr("sum(sqrt(id))").collect()
        except Exception as error:
            ended.append(error)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        jobs.cancel_job(spark, "7")
        if ended:
            break
    t.join(30)
    assert ended
