"""A training corpus from raw documents, stage by stage; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from roomlake.llm import exact_dedup, mixing, near_dedup, packing, quality_cnn
from roomlake.llm.common import shared_folder
from roomlake.llm.queries import quality_model, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the model learns from the labelled rows of ``docs``."""
    return quality_cnn.keep_quality(docs, quality_model(spark, docs, sf_dir)).select(COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to flattened weights, in a global shuffle."""
    return mixing.poisson_mix(docs, seed=17).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their place in sequences of at most 2048 tokens."""
    placed = packing.pack_documents(docs, tokenizer_path())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written and read again. ``folder`` names a shared place for it: a stage whose output is complete there
    is not run again, so a run that failed goes on where it stopped; the outputs stay. Without it they go to a new
    folder under spark.checkpoint.dir (a temporary one on a local master only) and each is deleted once the next is written. The last stage's result stands in checkpoints.
    """
    base = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        if not _exists(spark, f"{base}/{k}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if not folder and k:
            _delete(spark, f"{base}/{k - 1}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    if not folder:
        _delete(spark, base)
    return out


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def _delete(spark: SparkSession, name: str) -> None:
    files, path = _path(spark, name)
    files.delete(path, True)


#: A network decides in the first stage and a tokenizer cuts in the last, which SQL can't say; tests/llm compares
#: every stage with brute force on its own input, and the whole with the stages.
ORACLE_SQL = None
