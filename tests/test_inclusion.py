import random

from pyspark.sql import functions as F

from dataprobe.operators import inclusion


def brute(tables):
    """All pairs by Python sets of text cells; tables as {name: {column: [values]}}."""
    cells = {f"{t}.{c}": {str(v) for v in values if v is not None}
             for t, columns in tables.items() for c, values in columns.items()}
    return sorted((a, b) for a, x in cells.items() for b, y in cells.items() if a != b and x and x <= y)


def frame(spark, columns, kind="int"):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} {kind}" for c in columns))


def test_golden_cases(spark, rows):
    toy = frame(spark, {"Name": [1, 3, 5], "Age": [2, 4, 6]})
    assert rows(inclusion.discover_inds({"toy": toy})) == []
    one = {"a": frame(spark, {"k": [1, 2]}), "b": frame(spark, {"k": [1, 2, 3]}), "c": frame(spark, {"v": [9]})}
    assert rows(inclusion.discover_inds(one)) == [("a.k", "b.k")]
    both = {"a": frame(spark, {"k": [1, None]}), "b": frame(spark, {"k": [1]})}
    assert rows(inclusion.discover_inds(both)) == [("a.k", "b.k"), ("b.k", "a.k")]


def test_values_compare_as_text_of_their_type(spark, rows):
    tables = {"a": frame(spark, {"k": [5]}), "b": frame(spark, {"k": [5.0]}, "double"),
              "c": frame(spark, {"k": ["5"]}, "string"), "d": frame(spark, {"k": [5]}, "bigint")}
    found = rows(inclusion.discover_inds(tables))
    assert ("a.k", "c.k") in found and ("a.k", "d.k") in found
    assert not any("b.k" in pair for pair in found)


def test_empty_columns_never_appear(spark, rows):
    tables = {"a": frame(spark, {"k": [None, None], "v": [1, 2]}), "b": frame(spark, {"k": [1, 2]})}
    assert rows(inclusion.discover_inds(tables)) == [("a.v", "b.k"), ("b.k", "a.v")]


def test_more_columns_than_one_word_of_bits(spark, rows):
    rng = random.Random(1)
    columns = {f"c{i}": [rng.choice([None, *range(6 + i % 5)]) for _ in range(12)] for i in range(140)}
    tables = {"t": dict(list(columns.items())[:70]), "u": dict(list(columns.items())[70:])}
    found = rows(inclusion.discover_inds({n: frame(spark, c) for n, c in tables.items()}))
    assert found == brute(tables)


def test_long_texts_are_compared_whole(spark, rows):
    long, almost = "x" * 5000 + "a", "x" * 5000 + "b"
    tables = {"a": frame(spark, {"k": [long, "y"]}, "string"), "b": frame(spark, {"k": [long, "y", "z"]}, "string"),
              "c": frame(spark, {"k": [almost, "y", "z"]}, "string")}
    assert rows(inclusion.discover_inds(tables)) == [("a.k", "b.k")]


def test_transitive(spark, rows):
    rng = random.Random(3)
    columns = {f"c{i}": [rng.randrange(1 + i) for _ in range(30)] for i in range(8)}
    pairs = set(rows(inclusion.discover_inds({"t": frame(spark, columns)})))
    assert pairs == set(brute({"t": columns}))
    assert all((a, d) in pairs for a, b in pairs for c, d in pairs if b == c and a != d)


def test_report(spark, rows):
    inds = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "c")], "dep string, ref string")
    assert rows(inclusion.ind_report(inds)) == [("a", "a < b, c"), ("b", "b < c")]


def test_hot_value_is_combined_before_the_shuffle(spark, rows):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    tables = {"a": hot, "b": spark.range(20_001).select(F.col("id").alias("k"))}
    assert rows(inclusion.discover_inds(tables)) == [("a.k", "b.k")]
    plan = inclusion.discover_inds(tables)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan
