import random

import numpy as np
import pyarrow as pa
import pytest

from dataprobe.llm import quality


def test_features_of_small_texts():
    texts = ["", None, "A b! 12 | $$\nA b! 12 | $$", "é é É", "word", "\n\n \t", "x" * 100_000]
    x = quality.text_features(pa.array(texts))
    assert x.shape == (7, len(quality.FEATURES)) and np.isfinite(x).all()
    assert not x[0].any() and not x[1].any()
    f = dict(zip(quality.FEATURES, x[2]))
    assert f["log_words"] == np.log1p(10) and f["repeated_lines"] == .5 and f["distinct_words"] == .5
    assert f["upper"] == .5 and f["exclamations"] == 2 / 25 and f["bars"] == 2 / 25 and f["digits"] == 4 / 25
    assert f["no_letter"] == .6 and f["all_upper"] == .2
    alone = np.vstack([quality.text_features(pa.array([t])) for t in texts])
    assert np.allclose(alone, x)


def test_model_learns_shapes_and_a_pair():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (6000, 4))
    logit = 4 * np.abs(x[:, 0]) - 2 + 5 * (x[:, 1] > 0) * (x[:, 2] > 0) - 1
    y = (r.uniform(size=6000) < 1 / (1 + np.exp(-3 * logit))).astype(float)
    model = quality.fit(x[:5000], y[:5000])
    assert ((model.score(x[5000:]) > .5) == y[5000:]).mean() > .9
    assert any(set(p) == {1, 2} for p in model.pairs)
    again = quality.fit(x[:5000], y[:5000])
    assert (again.score(x) == model.score(x)).all()


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_no_rows_or_one_class(y):
    model = quality.fit(np.zeros((len(y), 3)), np.array(y))
    assert np.allclose(model.score(np.ones((2, 3))), (sum(y) + 1) / (len(y) + 2))


def noisy(r, good):
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(20, 80))]
    return " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows = [(i, noisy(r, i % 4 != 0), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (5, "twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (900, None), (901, 1), (3, 0)], "doc_id long, quality int")
    return docs, labels


def test_training_and_scores(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels.where("doc_id < 300 OR doc_id IS NULL"), rounds=40, pair_rounds=5)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= s.score <= 1 and s.predicted == int(s.score >= .7) for s in out)
    late = [s for s in out if s.doc_id is not None and 300 <= s.doc_id < 400]
    assert all(s.predicted == int(s.doc_id % 4 != 0) for s in late)
    small = quality.train(docs, labels, max_rows=50, rounds=5, pair_rounds=1)
    assert isinstance(small, quality.AdditiveModel)


def test_held_out_labels_are_never_used(spark, tmp_path, labelled):
    """The scores of the query do not change when all held-out labels are turned round."""
    import zlib

    from pyspark.sql import functions as F

    from dataprobe.llm.queries import QUERIES, held_out

    docs, labels = labelled
    rows = [{}, {}]
    for k, table in enumerate([labels, labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))]):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        table.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        found = QUERIES["op4_quality"](spark, f"{tmp_path}/{k}").collect()
        rows[k] = sorted((tuple(r) for r in found), key=repr)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert rows[0] == rows[1]


def test_empty_and_clashing(empty, clashing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(empty, labels)
    assert quality.score_quality(empty, model).count() == 0
    out = quality.score_quality(clashing, model)
    assert len(out.columns) == len(clashing.columns) and dict(out.dtypes)["score"] == "double"
