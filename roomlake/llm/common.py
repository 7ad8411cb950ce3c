"""Shared helpers: materialising small tables, gapless numbering, word rules."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that separate words.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Rows in a batch that Python workers get; whole texts are long, and a worker holds a batch several times.
BATCH_ROWS = 1000
#: At most this many offsets (16 MB or so) are broadcast when rows are numbered.
MAX_BROADCAST_OFFSETS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a lower setting stays.

    Plans read the setting when they run, so it holds for the session from here on.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; where it is unset, a temporary folder, on a local master only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new temporary folder if the master is local; else an error, as executors couldn't read it."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or tempfile.mkdtemp(prefix="checkpoint-")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (columns are told apart without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_fold(key: Column | str) -> Column:
    """crc32 of the key as text, modulo 3: the fold that decides what a classifier may learn from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def uniform_hash(*parts: Column) -> Column:
    """Uniform double in (0, 1) from an MD5 of the parts; DuckDB's md5 gives the same value."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Add ``out``: the row's rank from 0 in its group, gapless, without any group in one task.

    Rows are range-partitioned by (groups, order) with sampled splitters, so a large group spans
    many tasks. Each row's place in its partition is stored in a checkpoint; the table of
    (partition, group) counts has at most partitions + groups rows and is summed to offsets; up to
    MAX_BROADCAST_OFFSETS of them are broadcast, more are joined by (partition, group), a key that no
    large group shares. ``df`` must be cheap to read twice (the splitters are sampled).
    Ties in ``order`` get distinct ranks in an arbitrary, but fixed, order.
    """
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = checkpointed(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    # groups may be null: join on a null-safe text form
    tag = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups]) if groups else F.lit("")
    counts = placed.groupBy("_part", tag.alias("_tag")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by _tag order by _part rows between unbounded preceding and 1 preceding), 0)")
    starts = checkpointed(counts.select("_part", "_tag", (before - F.col("_first")).alias("_shift")))
    return (
        placed.withColumn("_tag", tag).join(F.broadcast(starts) if starts.count() <= MAX_BROADCAST_OFFSETS else starts, ["_part", "_tag"])
        .withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_part", "_at", "_tag", "_shift")
    )
