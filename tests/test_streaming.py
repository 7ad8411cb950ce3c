"""Streams give what tables give."""

import datetime as dt

from pyspark.sql import functions as F

from roomlake.streaming import jobs

SCHEMA = "event_id long, ts timestamp, job_id long, state string, frac double"


def events(spark, path, n):
    start = dt.datetime(2024, 1, 1)
    states = ["queued", "running", "running", "complete", "running", "cancel", "running"]
    rows = [(k, start + dt.timedelta(minutes=7 * k), k % 5, states[(k * 3 + k // 5) % 7], (k % 11) / 10) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def run(spark, df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_latest_state_of_a_stream(spark, tmp_path):
    table = events(spark, str(tmp_path / "e"), 80)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = run(spark, jobs.latest_job_state(stream), "latest_jobs", "complete", str(tmp_path / "c1"))
    key = lambda r: r.job_id
    assert sorted(got.collect(), key=key) == sorted(jobs.latest_job_state(table).collect(), key=key)


def test_windows_of_a_stream(spark, tmp_path):
    table = events(spark, str(tmp_path / "e"), 80)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    got = run(spark, jobs.windowed_progress(stream), "job_windows", "complete", str(tmp_path / "c2"))
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.windowed_progress(table).collect()))


def test_cancel_sticks(spark, tmp_path):
    table = events(spark, str(tmp_path / "e"), 60).coalesce(1)
    table.orderBy("ts").write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "one")).withWatermark("ts", "1 day")
    got = run(spark, jobs.job_transitions(stream), "job_steps", "append", str(tmp_path / "c3")).collect()
    assert len(got) == 60
    first = {r.job_id: r.at for r in table.filter(F.col("state") == "cancel").groupBy("job_id").agg(F.min("event_id").alias("at")).collect()}
    for r in got:
        assert r.aborted == (r.job_id in first and r.event_id >= first[r.job_id])
