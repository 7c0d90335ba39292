"""Cleans, mixes and packs a corpus: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paycadence.llm import mixing, neardup, packing, pii, quality
from paycadence.llm.common import checkpoint_dir, table, texts
from paycadence.llm.queries import vocabulary

THRESHOLD = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at least THRESHOLD; it learns from this stage's own input."""
    model = quality.train(texts(docs), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "text", "__score").filter(f"__score >= {THRESHOLD}").drop("__score")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows."""
    model = pii.train(texts(docs))
    return docs.withColumn("text", pii.masked(model, F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows in the order of the Pfair mix: files, and rows in each, follow the schedule."""
    return mixing.mix(docs).repartitionByRange("__position").sortWithinPartitions("__position").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and their place in it.

    Ranges of the mix's order are packed one by one. Rows that are in no files have no order and are packed by hash.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        return packing.pack(docs, vocabulary())
    return packing.pack_in_order(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mix", mixed_sources),
    ("pack", packed),
]

#: Trained scores, signatures and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the checkpoint folder, read again: the next stage sees its files in order."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
