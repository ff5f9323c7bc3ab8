"""Set algebra: customers with a filled order (a) against customers with an open one (b)."""

from pyspark.sql import functions as F

from dataprobe.operators import sets
from dataprobe.plans.registry import query, table

A_SQL = "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'"
B_SQL = "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O'"
WITH = f"WITH a AS ({A_SQL}), b AS ({B_SQL}), p AS (SELECT DISTINCT c_custkey AS probe FROM customer) "


def _customers(spark, folder, status):
    return table(spark, folder, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"))


def _probes(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("probe"))


def _two_sets(name, operator, sql):
    @query(name, WITH + sql)
    def run(spark, folder):
        return operator(_customers(spark, folder, "F"), _customers(spark, folder, "O"))


_two_sets("set_and", sets.set_and, "SELECT id FROM a INTERSECT SELECT id FROM b")
_two_sets("set_or", sets.set_or, "SELECT id FROM a UNION SELECT id FROM b")
_two_sets("set_xor", sets.set_xor,
          "(SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)")
_two_sets("set_and_not", sets.set_and_not, "SELECT id FROM a EXCEPT SELECT id FROM b")
_two_sets("set_intersects", sets.intersects, "SELECT EXISTS (SELECT 1 FROM a JOIN b ON a.id = b.id) AS intersects")
_two_sets("set_equals", sets.set_equals, """SELECT NOT EXISTS (SELECT id FROM a EXCEPT SELECT id FROM b)
  AND NOT EXISTS (SELECT id FROM b EXCEPT SELECT id FROM a) AS equal""")


@query("bitmap_count_distinct", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def bitmap_count_distinct(spark, folder):
    keys = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    return sets.bitmap_cardinality(sets.to_bitmaps(keys))


@query("bitmap_merge", WITH + """SELECT (SELECT count(*) FROM a JOIN b ON a.id = b.id) AS n_and,
  (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS n_or""")
def bitmap_merge(spark, folder):
    a, b = (sets.to_bitmaps(_customers(spark, folder, status)) for status in "FO")
    both = sets.bitmap_cardinality(sets.bitmap_and(a, b)).select(F.lit("and").alias("side"), "n")
    either = sets.bitmap_cardinality(sets.bitmap_or(a, b)).select(F.lit("or").alias("side"), "n")
    return both.unionByName(either).agg(
        F.max(F.when(F.col("side") == "and", F.col("n"))).alias("n_and"),
        F.max(F.when(F.col("side") == "or", F.col("n"))).alias("n_or"))


@query("set_next", WITH + """SELECT probe,
  coalesce((SELECT min(id) FROM a WHERE id >= probe), -1) AS next_set FROM p""")
def set_next(spark, folder):
    return sets.next_set(_probes(spark, folder), _customers(spark, folder, "F"))


@query("set_prev", WITH + """SELECT probe,
  coalesce((SELECT max(id) FROM a WHERE id <= probe), -1) AS previous_set FROM p""")
def set_prev(spark, folder):
    return sets.previous_set(_probes(spark, folder), _customers(spark, folder, "F"))


GAPS = """, g AS (SELECT x FROM generate_series(-1, (SELECT 2 + greatest(max(a.id), (SELECT max(probe) FROM p)) FROM a)) s(x)
  WHERE x NOT IN (SELECT id FROM a)) """


@query("set_next_gap", WITH.rstrip() + GAPS + "SELECT probe, (SELECT min(x) FROM g WHERE x >= probe) AS next_gap FROM p")
def set_next_gap(spark, folder):
    return sets.next_gap(_probes(spark, folder), _customers(spark, folder, "F"))


@query("set_prev_gap", WITH.rstrip() + GAPS +
       "SELECT probe, coalesce((SELECT max(x) FROM g WHERE x <= probe), -1) AS previous_gap FROM p")
def set_prev_gap(spark, folder):
    return sets.previous_gap(_probes(spark, folder), _customers(spark, folder, "F"))


@query("set_fill_range", f"""
WITH a AS ({A_SQL}), filled AS (SELECT id FROM a UNION SELECT x FROM generate_series(10, 59) g(x)),
     cleared AS (SELECT id FROM filled WHERE id < 20 OR id >= 30),
     r AS (SELECT x AS id FROM generate_series(50, 69) g(x))
(SELECT id FROM cleared EXCEPT SELECT id FROM r) UNION ALL (SELECT id FROM r EXCEPT SELECT id FROM cleared)""")
def set_fill_range(spark, folder):
    filled = sets.fill_range(_customers(spark, folder, "F"), 10, 60)
    return sets.flip_range(sets.clear_range(filled, 20, 30), 50, 70)


@query("set_logical_length", WITH + "SELECT coalesce(max(id) + 1, 0) AS length FROM a")
def set_logical_length(spark, folder):
    return sets.logical_length(_customers(spark, folder, "F"))


@query("set_random", """SELECT o_orderkey AS id FROM orders
  WHERE ('0x' || substr(sha256('42|' || o_orderkey), 1, 8))::BIGINT < 1073741824""")
def set_random(spark, folder):
    return sets.random_set(table(spark, folder, "orders"), "o_orderkey", 0.25, seed=42)
