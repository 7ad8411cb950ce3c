"""Session settings and materialising."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "roomlake", **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC and adaptive execution; further settings by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.ansi.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir; where none is set, in a temporary folder, on a local master only."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
