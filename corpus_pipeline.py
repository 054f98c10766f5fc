"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import minhash, packing, quality, secret_scan, substrings
from weftgraph.llm.components import forget, remove, shared_folder
from weftgraph.llm.queries import table, vocabulary

#: SQL cannot express the stages; tests hold each against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where the documents have it, follows what the text has become."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject.

    Null and empty texts are scored as empty; repeated rows are judged alike; no
    labels: all stay.  All columns come through, one called score too.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.scorer(docs, model, into=name).where(F.col(name) >= 0.5).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies, the one of least id; null and blank texts all stay."""
    return minhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; all documents stay, those without text as they are."""
    return _counted(substrings.clean(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; all documents stay, null texts as null."""
    return _counted(secret_scan.mask_column(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids; a null text is packed as an empty one."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored in the shared folder and read again.

    What a stage leaves behind, and its input, are deleted once its result is
    stored; the last result stays, since the returned DataFrame reads it.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with forget(spark):
            stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
