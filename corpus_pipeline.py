"""A training-data pipeline over ``documents``: reject bad texts, drop near duplicates and benchmark passages, mix the
sources, and deal the rest into shards. Each stage's result is written down and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.llm import decontaminate, mixing, quality, sharding, simhash
from dataprobe.llm.queries import MIX_DEFAULT, MIX_WEIGHTS, held_out, table
from dataprobe.session import materialize

SHARDS = 24


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score_quality(docs, quality.train(docs, labels), threshold=0.7)
    return scored.where("predicted = 1").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have their target weights, in random order."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, seed=42, default=MIX_DEFAULT).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and the place in it where they are to be written."""
    return sharding.shard_documents(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written down."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, name.lower().replace(" ", "-"))
    return docs
