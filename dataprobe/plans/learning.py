"""The tree pipeline over the labelled embeddings."""

from pyspark.sql import functions as F

from dataprobe.operators import learn
from dataprobe.plans.registry import query, table


def _data(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return learn.labelled_vectors(embeddings, "label", "embedding", "vec_id")


def _parts(spark, folder):
    return learn.split_by_hash(_data(spark, folder), "id", 0.7, seed=11)


@query("ml_vector_index", """
WITH cells AS (SELECT unnest(range(len(embedding))) AS feature, unnest(embedding) AS value FROM embeddings),
     kinds AS (SELECT feature, count(DISTINCT value) <= 4 AS categorical FROM cells GROUP BY feature)
SELECT vec_id AS id, label::DOUBLE AS label, feature, categorical FROM embeddings, kinds""")
def ml_vector_index(spark, folder):
    """Each vector's features, and which of them were found to be categorical."""
    data = _data(spark, folder)
    model = learn.fit_indexer(data)
    kinds = F.array(*[F.lit(i in model.categoryMaps) for i in range(model.numFeatures)])
    return model.transform(data).select(
        "id", "label", F.posexplode(learn.vector_to_array("indexed")).alias("position", "value")).select(
        "id", "label", F.col("position").cast("long").alias("feature"), kinds[F.col("position")].alias("categorical"))


@query("ml_split", """SELECT vec_id AS id, CASE WHEN ('0x' || substr(sha256('11|' || vec_id), 1, 8))::BIGINT
  < floor(0.7 * 4294967296) THEN 'train' ELSE 'test' END AS part FROM embeddings""")
def ml_split(spark, folder):
    train, test = _parts(spark, folder)
    return train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


@query("ml_tree")
def ml_tree(spark, folder):
    train, test = _parts(spark, folder)
    return learn.train_tree(train, test, _data(spark, folder)).predictions.select("id", "label", "prediction")


@query("ml_accuracy")
def ml_accuracy(spark, folder):
    train, test = _parts(spark, folder)
    predictions = learn.train_tree(train, test, _data(spark, folder)).predictions
    return learn.accuracy_table(predictions)
