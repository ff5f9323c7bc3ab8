"""A decision tree pipeline with categorical features found by their number of values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorIndexer, VectorIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.sets import hash_draw

__all__ = ["TreeReport", "accuracy_table", "fit_indexer", "labelled_vectors", "split_by_hash", "train_tree",
           "vector_to_array"]

MAX_CATEGORIES = 4


def labelled_vectors(df: DataFrame, label: str, features: str, ident: str | None = None) -> DataFrame:
    """``(label, features)`` from a number column and an array column, with ``id`` if asked for."""
    ids = [F.col(ident).alias("id")] if ident else []
    return df.select(
        *ids, F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(features).cast("array<double>")).alias("features"))


def fit_indexer(data: DataFrame, max_categories: int = MAX_CATEGORIES) -> VectorIndexerModel:
    """Features with few distinct values become categorical ones."""
    return VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=max_categories,
                         handleInvalid="keep").fit(data)


def split_by_hash(data: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts by a seeded hash of ``key``: unlike a random draw per row the parts stay the
    same when a lost task is run again."""
    draw = hash_draw(key, seed) < int(share * (1 << 32))
    return data.where(draw), data.where(~draw)


@dataclass(frozen=True)
class TreeReport:
    model: PipelineModel
    predictions: DataFrame
    accuracy: float

    @property
    def test_error(self) -> float:
        return 1.0 - self.accuracy

    @property
    def tree(self) -> str:
        return self.model.stages[1].toDebugString


def train_tree(train: DataFrame, test: DataFrame, indexed_over: DataFrame | None = None, seed: int = 7) -> TreeReport:
    """Index, fit and test a tree. The indexer may be fitted over more data than the tree."""
    indexer = fit_indexer(indexed_over if indexed_over is not None else train)
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="indexed", seed=seed)
    model = Pipeline(stages=[indexer, tree]).fit(train)
    predictions = model.transform(test)
    accuracy = MulticlassClassificationEvaluator(
        labelCol="label", predictionCol="prediction", metricName="accuracy").evaluate(predictions)
    return TreeReport(model, predictions, accuracy)


def accuracy_table(predictions: DataFrame) -> DataFrame:
    """One row: share of right predictions and the test error."""
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return predictions.agg(right.alias("accuracy"), (1 - right).alias("test_error"))
