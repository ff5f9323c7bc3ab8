import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bad = spark.range(300, 340).select(
        F.col("id").alias("doc_id"), F.concat_ws(" | ", *[F.concat(F.lit("BUY!! "), F.col("id") + k) for k in range(30)]).alias("text"),
        F.lit("en").alias("lang"), F.lit("s1").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.where("doc_id IS NOT NULL").unionByName(bad).write.parquet(f"{path}/documents.parquet")
    ids = spark.range(0, 60).select("id", F.lit(1).alias("q")).union(bad.select("doc_id", F.lit(0)))
    ids.toDF("doc_id", "quality").withColumn("toxic", F.lit(0)).write.parquet(f"{path}/labels.parquet")
    text = docs.where("doc_id < 60 AND length(text) - length(replace(text, ' ', '')) > 40").orderBy("doc_id").first()["text"]
    item = " ".join(text.split()[3:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
        seen[name] = docs.collect()
        if number < 4:
            assert docs.columns == COLUMNS
    good = {r.doc_id for r in seen["quality classifier"]}
    assert not good & set(range(300, 340)) and len(good & set(range(60))) >= 55
    unlike = [r.doc_id for r in seen["SimHash near-dedup"]]
    texts = {(r.doc_id, r.text) for r in seen["SimHash near-dedup"]}
    assert len(texts) == len({t for _, t in texts})
    assert set(unlike) <= good
    clean = {r.doc_id for r in seen["benchmark decontamination"]}
    assert clean < set(unlike)
    last = seen["sharding"]
    assert {r.doc_id for r in last} <= clean and len(last) == len(seen["mixing sources to target weights"])
    assert {"size", "shard", "slot"} <= set(docs.columns)
    final = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.shard) for r in final.collect()) == sorted((r.doc_id, r.shard) for r in last)


def test_stages_over_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
