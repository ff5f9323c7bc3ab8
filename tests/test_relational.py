import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions import text as tx
from dataprobe.operators import joins, relational
from dataprobe.session import run_sql, run_timed


def staff(spark):
    data = [("Ann", 30, 10.0, "X"), ("Bob", 97, 20.0, "X"), ("Cid", 99, 20.0, "X"), ("Dan", 96, 5.0, "Y"), (None, 50, None, "Y")]
    return spark.createDataFrame(data, "name string, age int, salary double, company string")


def test_projections(spark, rows):
    df = spark.range(3)
    assert [r[0] for r in df.select(tx.prefixed("This is a number: ", F.col("id"))).collect()] == [
        "This is a number: 0", "This is a number: 1", "This is a number: 2"]
    assert rows(relational.with_constants(df, ["id"], a="nonce", b=3.1415, c=True))[0] == (0, "nonce", 3.1415, True)
    assert relational.rename_all(staff(spark), "a", "b", "c", "d").columns == ["a", "b", "c", "d"]
    cast = relational.cast_to(df, T.StructType([T.StructField("id", T.StringType())]))
    assert rows(cast) == [("0",), ("1",), ("2",)]


def test_membership_predicates_and_nulls(spark, rows):
    names = relational.keep_not_in(staff(spark), "name", ["Ann", "Bob"]).select("name")
    assert rows(names) == [("Cid",), ("Dan",), (None,)]
    assert relational.keep_in(staff(spark), "name", ["Ann", "Zoe"]).count() == 1
    listed = spark.createDataFrame([("Ann",), ("Bob",), ("Bob",)], "name string")
    assert rows(joins.keep_listed(staff(spark), listed, "name").select("name")) == [("Ann",), ("Bob",)]
    assert rows(joins.drop_listed(staff(spark), listed, "name").select("name")) == [("Cid",), ("Dan",), (None,)]


def test_sql_and_timer(spark, rows):
    old = run_sql(spark, "SELECT name FROM staff WHERE age > 95 ORDER BY salary DESC, name", staff=staff(spark))
    assert [r[0] for r in old.collect()] == ["Bob", "Cid", "Dan"]
    assert not spark.catalog.tableExists("staff")
    assert run_timed(old) > 0


def test_aggregates(spark, rows):
    df = staff(spark)
    assert rows(relational.top_per_group(df, "company", "salary", "name")) == [("X", "Bob", 20.0), ("Y", "Dan", 5.0)]
    assert rows(relational.longest_per_key(spark.createDataFrame([(1, "bb"), (1, "aa"), (1, "c")], "k int, s string"), "k", "s")) == [(1, "aa")]
    assert rows(relational.max_or_zero(df.where("age > 1000"), "age", "n")) == [(0,)]
    assert rows(relational.count_if_all(df, x=F.col("company") == "X", old=F.col("age") > 95)) == [(3, 3)]
    numbers = spark.createDataFrame([(7,), (2,), (10,), (2,), (None,)], "n int")
    assert rows(relational.joined_values(numbers, [], "n", ";", "text")) == [("2;2;7;10",)]
    assert rows(relational.joined_values(numbers, [], "n", ";", "text", distinct=True)) == [("2;7;10",)]
    none = spark.createDataFrame([("p", "b", None), ("p", "a", None), ("q", "c", None), ("q", "d", 1.0)], "g string, l string, m double")
    assert rows(relational.top_per_group(none, "g", "m", "l")) == [("p", "a", None), ("q", "d", 1.0)]
    assert rows(relational.top_k(df, "salary", "name", 2).select("name")) == [("Bob",), ("Cid",)]


def test_observed_counts(spark):
    df, seen = relational.observe_counts(staff(spark), x=F.col("company") == "X", y=F.col("company") == "Y")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"x": 3, "y": 2}


def test_array_operators(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "k int, s array<string>")
    rest = relational.explode_rest(df, "s")
    assert rows(rest) == [(1, "a", ["b", "c"]), (1, "b", ["a", "c"]), (1, "c", ["a", "b"])]
    assert rows(relational.keep_nonempty(df, "s").select("k")) == [(1,)]


def test_set_intersection_over_many_items(spark):
    domain = [f"i{n:03d}" for n in range(150)]
    df = spark.createDataFrame([
        (1, domain), (1, domain[60:70]), (1, domain[5:140]), (2, []), (3, ["a", "9"]), (3, ["9", "b", "9", None]), (4, ["a"]),
        (4, None), (None, ["x", "y"]), (None, ["y", "z"])], "k int, s array<string>")
    got = {r["k"]: r["s"] for r in relational.set_intersection_per_key(df, "k", "s").collect()}
    assert got == {1: domain[60:70], 2: [], 3: ["9"], 4: [], None: ["y"]}


def test_fill_nulls_fills_text_only(spark):
    df = spark.range(5).withColumns({"loaded_on": F.current_date(), "loaded_at": F.current_timestamp(),
                                     "remark": F.lit(None).cast("string")})
    first = df.na.fill("(none)", ["loaded_on", "loaded_at", "remark"]).first()
    assert first["remark"] == "(none)" and first["loaded_on"] is not None


def test_theta_self_join(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, k string")
    assert rows(joins.others_with_same_key(df, "k", "id")) == [(1, "a", 2, 3), (2, "a", 2, 1), (3, "a", 2, 1)]


def test_pairs_of_structs(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 9), (4, "b", 1)], "id int, k string, t int")
    pairs = joins.pair_with_latest(df, "k", ["t"], "id", ["id", "t"]).select("a.id", F.col("b.id").alias("other"))
    assert rows(pairs) == [(1, 3), (2, 3)]


def test_broadcast_needs_a_checked_size(spark):
    small, large = (joins.broadcast_if_small(spark.range(n), 10) for n in (10, 11))
    wide = joins.broadcast_if_small(spark.range(3).withColumn("s", F.repeat(F.lit("x"), F.lit(1000))), 10, 2_000)
    base = spark.range(100)
    assert "SortMergeJoin" in base.join(wide, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in base.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in base.join(large, "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_rows, hot_rows", [(None, 10), (5, 10), (5, 10_000)])
def test_lookup_join_with_a_hot_key(spark, rows, monkeypatch, how, max_rows, hot_rows):
    """A third of the rows hold one key, some none; every way gives what a plain join gives."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 100).cast("long")
    left = spark.range(600).select("id", key.alias("k"))
    right = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    expected = rows(left.join(right, "k", how))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", max_rows or 1_000)
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    got = joins.lookup_join(left, right, ["k"], how)
    assert rows(got) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (max_rows == 5)
    if max_rows == 5 and hot_rows == 10:
        assert "BroadcastHashJoin" in plan


def test_membership(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,), (3,)], "k int")
    right = spark.createDataFrame([(3,), (3,), (None,), (5,)], "k int")
    assert rows(joins.with_membership(left, right, "k")) == [(1, False), (2, False), (3, True), (3, True), (None, False)]


def test_digests(spark, rows):
    df = spark.createDataFrame([("abc",), ("é",)], "s string").select(tx.sha256_hex(F.col("s")))
    assert df.first()[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    cands = spark.createDataFrame([(1, "x"), (2, "y")], "id int, d string")
    wanted = spark.createDataFrame([("x",), ("x",), ("z",)], "d string")
    assert rows(joins.match_digests(cands, wanted, "d")) == [("x", 1)]
    assert math.isclose(relational.with_constants(cands, [], v=1.5).first()[0], 1.5)
