import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, size, seed=1):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(size)] for _ in range(3)]
    return [[sum(r.gauss(0, 1 / (k + 1)) * b[i] for k, b in enumerate(base)) + r.gauss(0, .05) + .3 for i in range(size)] for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(i, v, i % 3) for i, v in enumerate(vectors(300, 8))]
    found += [(400 + i, found[i % 5][1], None) for i in range(60)]      # a large group of copies
    found += [found[3], (None, found[4][1], 1), (500, None, 1), (501, [1.0] * 7 + [float("nan")], 1), (502, [float("inf")] * 8, 1),
              (503, [None] + [0.5] * 7, 1), (504, [], 1), (505, [-0.0] * 8, 1)]
    return found


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector) and len(vector) > 0


def exact(vector, scale=256):
    return tuple(math.floor(scale * float(np.float32(c))) for c in vector)


def check(found, rows, components=4):
    """Against numpy and Python's whole numbers, for vectors of one length."""
    good = [(i, exact(v)) for i, v, _ in rows if usable(v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    matrix = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(matrix.T @ matrix / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for r in found:
        out.setdefault(r.vec_id, []).append(r)
    assert len(found) == components * len(good)
    signs = {}
    for vec_id, x in good:
        mine = {r.component: r for r in out[vec_id]}
        assert sorted(mine) == list(range(1, components + 1))
        for k, r in mine.items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            wanted = float((np.array(x) - np.array(sums) / n) @ vectors[:, k - 1] / math.sqrt(values[k - 1]))
            if abs(wanted) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(wanted * r.whitened))
            assert abs(abs(wanted) - abs(r.whitened)) < 1e-6
            assert abs(r.explained - values[k - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_against_numpy(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "embedding", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), rows)


def test_each_length_has_its_own_fit(spark, rows):
    other = [(1000 + i, v, 0) for i, v in enumerate(vectors(50, 3, seed=2))]
    df = spark.createDataFrame(rows + other, SCHEMA).repartition(4)
    found = whitening.whiten(df).collect()
    check([r for r in found if (r.vec_id or 0) < 1000], rows)
    check([r for r in found if (r.vec_id or 0) >= 1000], other, components=3)


def test_small_variance_around_a_large_mean_is_not_lost(spark):
    """Squares of uncentred doubles would cancel here; and sums beyond 64 bits stay exact."""
    rows = [(i, [2.0 ** 40 + (i % 7) * 2.0 ** 17, (i % 5) * 0.5, 2.0 ** 40 - (i % 3) * 2.0 ** 17], 0) for i in range(105)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=3).collect()
    fit = sorted({exact(v) for _, v, _ in rows})
    sums = [sum(c) for c in zip(*fit)]
    big = max(sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums)) for x in fit)
    assert big > whitening.MOST and any(r.deviation is None for r in found)
    assert all(r.identity_error < 1e-6 for r in found)


def test_constant_vectors_single_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], SCHEMA)
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(same).collect()} == {
        (1, 1, 0, None, None), (2, 1, 0, None, None)}
    flat = spark.createDataFrame([(i, [float(i), 2.0], 0) for i in range(4)], SCHEMA)
    assert {(r.component, r.whitened is None) for r in whitening.whiten(flat).collect()} == {(1, False), (2, True)}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).collect() == []


def test_clashing_names(spark, rows):
    df = spark.createDataFrame(rows[:40], SCHEMA).select("*", *[F.lit("old").alias(c) for c in ("row", "x", "d", "N", "found", "Whitened", "place")])
    out = whitening.whiten(df)
    assert {"row", "x", "d", "found", "place", "n", "whitened"} <= set(out.columns) and "N" not in out.columns
    check(out.collect(), rows[:40])


def test_limbs_and_saturation():
    big = 3 * (1 << 100) + 5
    limbs = whitening._limbs(np.array([big, -big, 7], dtype=object))
    assert [(int(h) << 60) + int(w) for h, w in zip(limbs["high"].to_pylist(), limbs["low"].to_pylist())] == [big, -big, 7]
    import pyarrow as pa
    assert whitening.whole_numbers(pa.array([[1e300, -1e300, 0.5]]), 256).to_pylist() == [[whitening.MOST, whitening.LEAST, 128]]


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(table.select("vec_id", "embedding")).collect(), [(r.vec_id, r.embedding, 0) for r in table.collect()])
