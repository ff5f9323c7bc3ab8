import random
import uuid
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe import session
from dataprobe.operators import uniqueness


def brute(rows, names):
    found = []
    for size in range(1, len(names) + 1):
        for c in combinations(range(len(names)), size):
            if any(set(f) <= set(c) for f in found):
                continue
            if len({tuple(r[i] for i in c) for r in rows}) == len(rows):
                found.append(c)
    return [tuple(names[i] for i in c) for c in found]


@pytest.mark.parametrize("rows, expected", [
    ([(1, 1), (1, 2), (2, 1)], [("x", "y")]),
    ([(1, 1), (2, 1)], [("x",)]),
    ([(None, None), (None, None)], []),
    ([(None, 1), (1, 1)], [("x",)]),
])
def test_golden(spark, rows, expected):
    assert uniqueness.discover_uccs(spark.createDataFrame(rows, "x int, y int")) == expected


@pytest.mark.parametrize("slice_rows", [1_000_000, 10])
def test_against_brute_force(spark, slice_rows):
    rng = random.Random(5)
    names = list("abcde")
    rows = [tuple(rng.choice([None, *range(4)]) for _ in names) for _ in range(40)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    assert sorted(uniqueness.discover_uccs(df, slice_rows=slice_rows)) == sorted(brute(rows, names))


def test_max_size_and_check(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1)], "a int, b int, c int")
    assert uniqueness.discover_uccs(df, 2) == []
    assert uniqueness.discover_uccs(df) == [("a", "b", "c")]
    assert uniqueness.is_unique(df, ["a", "b", "c"]).first()[0] is True
    assert uniqueness.is_unique(df, ["a", "b"]).first()[0] is False


def test_outcomes():
    got = dict(uniqueness.outcomes(["a", "b", "c"], [("a",), ("b", "c")], 2))
    assert got == {("a",): "MINIMAL", ("b",): "EXTENDABLE", ("c",): "EXTENDABLE", ("a", "b"): "FALSE",
                   ("a", "c"): "FALSE", ("b", "c"): "MINIMAL"}


def test_full_lattice_of_the_widest_table(spark):
    """All 2,047 column sets of a given table, one by one, against the search."""
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    frame = table.toPandas()
    codes = [frame[c].factorize(use_na_sentinel=False)[0].astype("int64") for c in frame.columns]
    found, unique = [], set()
    for size in range(1, len(codes) + 1):
        for columns in combinations(range(len(codes)), size):
            if any(u <= set(columns) for u in unique):
                continue
            key = codes[columns[0]]
            for k in columns[1:]:
                key = (key * (codes[k].max() + 1) + codes[k])
                key = np.unique(key, return_inverse=True)[1].astype("int64")
            if len(np.unique(key)) == len(frame):
                unique.add(frozenset(columns))
                found.append(tuple(frame.columns[k] for k in columns))
    assert uniqueness.discover_uccs(table, slice_rows=500) == found and len(found) > 20


def test_slices_and_stripped_parents(spark, monkeypatch):
    """Many slices, and parents that leave few rows: the sets stay the same."""
    monkeypatch.setattr(uniqueness, "TEST_ROWS", 100)
    rng = random.Random(12)
    rows = list({(rng.randrange(900), rng.randrange(40), rng.randrange(30), rng.choice([None, 1, 2]), rng.randrange(6)) for _ in range(1500)})
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    seen = []
    strip = uniqueness._strip
    monkeypatch.setattr(uniqueness, "_strip", lambda r, sets, *rest: (seen.extend(sets), strip(r, sets, *rest))[1])
    assert uniqueness.discover_uccs(df, slice_rows=200) == brute(rows, list("abcde"))
    assert seen


def test_rows_are_written_as_they_are(spark, tmp_path, monkeypatch):
    """What is written down takes the space of the values, not that of two hashes for each."""
    monkeypatch.setattr(session, "scratch_path", lambda _, label: f"file://{tmp_path}/{label}-{uuid.uuid4().hex}")
    df = spark.range(20_000).selectExpr("id", *[f"id % {k} AS c{k}" for k in range(2, 12)])
    assert uniqueness.discover_uccs(df, 1) == [("id",)]
    size = sum(f.stat().st_size for f in tmp_path.rglob("encoded-*/*.parquet"))
    assert 0 < size < 30 * 20_000


@pytest.mark.parametrize("suspects", [1024, 0])
def test_all_rows_by_packed_hashes(spark, monkeypatch, suspects):
    """Many blocks and buckets, repeats that only whole tables show, and more repeats than are listed."""
    for name, value in (("TEST_ROWS", 50), ("BLOCK_ROWS", 100), ("BUCKET_ROWS", 60), ("SUSPECTS", suspects)):
        monkeypatch.setattr(uniqueness, name, value)
    rng = random.Random(3)
    rows = [(i, i % 700 if i > 3 else None, i // 700, rng.randrange(3), rng.randrange(200)) for i in range(1400)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    assert uniqueness.discover_uccs(df, slice_rows=100) == brute(rows, list("abcde"))
    encoded = uniqueness._encoded(df, list("abcde"))
    (values, complete), (none, all_) = uniqueness._repeats(encoded, [frozenset([4]), frozenset([0])], {}, 5, 1400, 1400)
    assert complete and all_ and len(none) == 0
    assert len(values) == sum(n > 1 for n in np.bincount([r[4] for r in rows]))


def test_slices_are_picked_from_blocks(spark):
    """No row is made for each set to find those of a slice: whole clusters of each set, and about its share of the rows."""
    df = spark.range(20_000).selectExpr("id AS a", "id % 5000 AS b", "id % 3 AS c", "IF(id % 2 = 0, NULL, id % 1000) AS d")
    encoded = uniqueness._encoded(df, list("abcd"))
    sets = [frozenset(c) for n in (1, 2, 3) for c in combinations(range(4), n)]
    sliced = uniqueness._clusters(encoded, sets, 10)
    assert "Generate" not in sliced._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in sliced.collect()}
    whole = {tuple(r) for r in uniqueness._clusters(encoded, sets).collect()}
    assert found <= whole
    picked = {r[:3] for r in found}
    assert found == {r for r in whole if r[:3] in picked}
    assert all(1_000 < sum(r[0] == i for r in found) < 3_000 for i, c in enumerate(sets) if 0 in c)


def test_listed_values_are_found():
    rng = np.random.default_rng(4)
    for n in (0, 1, 700, 300_000):
        listed = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        values = np.concatenate([listed[::3], rng.integers(0, 1 << 40, 5_000, dtype=np.uint64), listed[:5] + np.uint64(1 << 30)])
        assert np.array_equal(uniqueness._among(values, listed), np.isin(values, listed))


def test_values_of_all_types(spark):
    """Values are told apart as grouping does: one zero, one NaN, null as a value of its own."""
    df = spark.sql("""SELECT * FROM VALUES
        (0.0D, 0.0F, 1L, true, DATE'2020-01-01', TIMESTAMP'2020-01-01 00:00:00.000001', 1.10BD, 'x', array(1)),
        (-0.0D, -0.0F, NULL, false, NULL, TIMESTAMP'2020-01-01 00:00:00.000002', 1.1BD, '', NULL),
        (double('NaN'), float('NaN'), 0L, NULL, DATE'1969-12-31', NULL, NULL, NULL, array(1)),
        (-double('NaN'), NULL, -1L, true, DATE'2020-01-01', TIMESTAMP'1960-01-01', 2BD, 'x', array()),
        (NULL, 0.1F, 9223372036854775807L, NULL, DATE'2020-01-02', TIMESTAMP'2020-01-01 00:00:00.000001', 2BD, 'X', array(2))
        AS t(a, b, c, d, e, f, g, h, i)""").repartition(2)
    df = df.withColumn("j", df.b * 0 + 0.25).withColumn("k", (df.c % 100).cast("smallint"))
    sets = [frozenset([k]) for k in range(len(df.columns))]
    found = uniqueness._clusters(uniqueness._encoded(df, df.columns), sets).groupBy("i").agg(
        F.count_distinct("h1", "h2").alias("n"), F.count("*").alias("rows")).collect()
    assert {df.columns[r.i]: r.n for r in found} == {c: df.groupBy(c).count().count() for c in df.columns}
    assert all(r.rows == 5 for r in found)
