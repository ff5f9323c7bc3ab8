"""Projections, predicates, aggregates, joins and top-k over the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions import text as tx
from dataprobe.functions.numbers import is_prime
from dataprobe.operators import inclusion, joins, relational
from dataprobe.plans.registry import query, table
from dataprobe.session import run_sql


@query("project_concat", "SELECT c_custkey, 'customer no. ' || c_custkey AS label FROM customer")
def project_concat(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", tx.prefixed("customer no. ", F.col("c_custkey")).alias("label"))


@query("project_literals",
       "SELECT c_custkey, 'checked' AS tag, 0.25::DOUBLE AS ratio, true AS flag FROM customer")
def project_literals(spark, folder):
    return relational.with_constants(
        table(spark, folder, "customer"), ["c_custkey"], tag="checked", ratio=0.25, flag=True)


@query("project_arith", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 0.5::DOUBLE AS y FROM lineitem")
def project_arith(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2 + 0.5).alias("y"))


@query("with_columns", """SELECT c_custkey, (now() AT TIME ZONE 'UTC')::DATE AS loaded_on, true AS past, NULL::VARCHAR AS remark
FROM customer""")
def with_columns(spark, folder):
    return table(spark, folder, "customer").select("c_custkey").withColumns({
        "loaded_on": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("date"),
        "past": F.current_timestamp() > F.lit("2020-01-01").cast("timestamp"),
        "remark": F.lit(None).cast("string")})


@query("select_alias", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS salary FROM customer")
def select_alias(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("salary"))


@query("rename_all", """SELECT p_partkey AS id, p_name AS name, p_brand AS password, p_type AS gene FROM part""")
def rename_all(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return relational.rename_all(part, "id", "name", "password", "gene")


@query("cast_schema", """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::INTEGER AS o_custkey,
       o_orderdate::DATE AS o_orderdate FROM orders""")
def cast_schema(spark, folder):
    schema = T.StructType([
        T.StructField("o_orderkey", T.StringType()), T.StructField("o_custkey", T.IntegerType()),
        T.StructField("o_orderdate", T.DateType())])
    return relational.cast_to(table(spark, folder, "orders"), schema)


@query("struct_field", """SELECT c_custkey, c_name || ' buys' AS sentence,
       'customer ' || c_name || ' of nation ' || c_nationkey AS title FROM customer""")
def struct_field(spark, folder):
    person = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("p")
    return table(spark, folder, "customer").select("c_custkey", person).select(
        "c_custkey", F.concat("p.name", F.lit(" buys")).alias("sentence"),
        F.format_string("customer %s of nation %d", "p.name", "p.nation").alias("title"))


@query("filter_contains", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '1')")
def filter_contains(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_name").where(F.col("c_name").contains("1"))


@query("sql_filter", "SELECT c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9500")
def sql_filter(spark, folder):
    return run_sql(spark, "SELECT c_name, c_acctbal, c_mktsegment FROM buyers WHERE c_acctbal > 9500",
                   buyers=table(spark, folder, "customer"))


SEGMENTS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]


@query("filter_in",
       "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def filter_in(spark, folder):
    return relational.keep_in(
        table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS)


@query("filter_not_in", """SELECT c_custkey, c_mktsegment FROM customer
       WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def filter_not_in(spark, folder):
    return relational.keep_not_in(
        table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS)


@query("filter_broadcast_semi", """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def filter_broadcast_semi(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_listed(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey")


@query("filter_broadcast_anti", """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def filter_broadcast_anti(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.drop_listed(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey")


@query("unpivot_cells", """
SELECT c_custkey::VARCHAR AS value, 'c_custkey' AS attribute FROM customer
UNION ALL SELECT c_name, 'c_name' FROM customer
UNION ALL SELECT c_nationkey::VARCHAR, 'c_nationkey' FROM customer
UNION ALL SELECT c_acctbal::VARCHAR, 'c_acctbal' FROM customer
UNION ALL SELECT c_mktsegment, 'c_mktsegment' FROM customer""")
def unpivot_cells(spark, folder):
    customer = table(spark, folder, "customer")
    return inclusion.unpivot_cells(customer, customer.columns, customer.columns, T.StringType())


@query("union_all", """
SELECT c_nationkey AS nationkey, 'customer' AS side FROM customer
UNION ALL SELECT s_nationkey, 'supplier' FROM supplier
UNION ALL SELECT n_nationkey, 'nation' FROM nation""")
def union_all(spark, folder):
    columns = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}
    return relational.union_all([
        table(spark, folder, name).select(F.col(c).alias("nationkey"), F.lit(name).alias("side"))
        for name, c in columns.items()])


@query("explode_rest", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
     e AS (SELECT p_partkey, words, unnest(words) AS element FROM w)
SELECT p_partkey, element, array_to_string(list_filter(words, lambda x: x <> element), ',') AS rest FROM e""")
def explode_rest(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return relational.explode_rest(part, "words").withColumn("rest", F.array_join("rest", ","))


@query("filter_nonempty", """
WITH w AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'hot')) AS words FROM part)
SELECT p_partkey, array_to_string(words, ',') AS words FROM w WHERE len(words) > 0""")
def filter_nonempty(spark, folder):
    wanted = F.array(F.lit("red"), F.lit("hot"))
    part = table(spark, folder, "part").select(
        "p_partkey", F.array_intersect(F.split("p_name", " "), wanted).alias("words"))
    return relational.keep_nonempty(part, "words").withColumn("words", F.array_join("words", ","))


@query("filter_prime", """
WITH bound AS (SELECT coalesce(max(o_orderkey), 0) AS top FROM orders),
     divisors AS (SELECT d FROM bound, generate_series(2, cast(ceil(sqrt(top)) AS BIGINT) + 1) g(d))
SELECT o_orderkey, o_totalprice FROM orders o WHERE o_orderkey > 1
  AND NOT EXISTS (SELECT 1 FROM divisors WHERE d * d <= o.o_orderkey AND o.o_orderkey % d = 0)""")
def filter_prime(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").where(is_prime("o_orderkey"))


# --- joins ---------------------------------------------------------------------------------


@query("join_theta_self", """
WITH e AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)
SELECT o_orderkey, o.o_custkey, n - 1 AS partners, CASE WHEN o_orderkey = lo THEN hi ELSE lo END AS partner
FROM orders o JOIN e ON o.o_custkey = e.o_custkey
WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey <> o.o_orderkey)""")
def join_theta_self(spark, folder):
    return joins.others_with_same_key(table(spark, folder, "orders"), "o_custkey", "o_orderkey")


@query("join_with_structs", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT a.o_orderkey AS a_orderkey, a.o_totalprice AS a_totalprice, b.o_orderkey AS b_orderkey, b.o_totalprice AS b_totalprice
FROM orders a JOIN r b ON a.o_custkey = b.o_custkey AND b.k = 1 AND a.o_orderkey <> b.o_orderkey""")
def join_with_structs(spark, folder):
    pairs = joins.pair_with_latest(
        table(spark, folder, "orders"), "o_custkey", ["o_orderdate"], "o_orderkey", ["o_orderkey", "o_totalprice"])
    return pairs.select(
        F.col("a.o_orderkey").alias("a_orderkey"), F.col("a.o_totalprice").alias("a_totalprice"),
        F.col("b.o_orderkey").alias("b_orderkey"), F.col("b.o_totalprice").alias("b_totalprice"))


@query("join_digest", """
SELECT p_partkey, sha256(p_partkey::VARCHAR) AS digest FROM part
WHERE p_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def join_digest(spark, folder):
    candidates = table(spark, folder, "part").select(
        "p_partkey", tx.sha256_hex(F.col("p_partkey")).alias("digest"))
    wanted = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").distinct().select(
        tx.sha256_hex(F.col("l_suppkey")).alias("digest"))
    return joins.match_digests(candidates, wanted, "digest").select("p_partkey", "digest")


@query("bloom_semi_join", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)""")
def bloom_semi_join(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    small = table(spark, folder, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return joins.keep_listed(lines, small, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("bloom_contains", """
SELECT l_orderkey, l_linenumber, l_partkey,
       coalesce(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7), false) AS maybe FROM lineitem""")
def bloom_contains(spark, folder):
    """Membership, exact: Spark makes its own Bloom filters where they help."""
    small = table(spark, folder, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.with_membership(lines, small, "l_partkey", "maybe").select(
        "l_orderkey", "l_linenumber", "l_partkey", "maybe")


# --- aggregates ----------------------------------------------------------------------------


@query("agg_string_join", """
SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand""")
def agg_string_join(spark, folder):
    return relational.joined_values(table(spark, folder, "part"), ["p_brand"], "p_type", ",", "types")


@query("top_per_group", """
SELECT c_mktsegment, c_name, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer) WHERE k = 1""")
def top_per_group(spark, folder):
    return relational.top_per_group(
        table(spark, folder, "customer"), "c_mktsegment", "c_acctbal", "c_name").orderBy(F.desc("c_acctbal"))


@query("agg_collect_set", """
WITH cells AS (
  SELECT DISTINCT c_custkey::VARCHAR AS text, 'customer.c_custkey' AS a FROM customer
  UNION SELECT c_nationkey::VARCHAR, 'customer.c_nationkey' FROM customer
  UNION SELECT s_suppkey::VARCHAR, 'supplier.s_suppkey' FROM supplier
  UNION SELECT s_nationkey::VARCHAR, 'supplier.s_nationkey' FROM supplier
  UNION SELECT n_nationkey::VARCHAR, 'nation.n_nationkey' FROM nation
  UNION SELECT n_name, 'nation.n_name' FROM nation
  UNION SELECT n_regionkey::VARCHAR, 'nation.n_regionkey' FROM nation)
SELECT text, string_agg(a, ', ' ORDER BY a) AS attributes FROM cells WHERE text IS NOT NULL GROUP BY text""")
def agg_collect_set(spark, folder):
    return inclusion.attribute_sets({
        "customer": table(spark, folder, "customer").select("c_custkey", "c_nationkey"),
        "supplier": table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"),
        "nation": table(spark, folder, "nation"),
    }).select("text", F.array_join("attributes", ", ").alias("attributes"))


@query("agg_set_intersection", """
WITH w AS (SELECT string_split(p_name, ' ')[1] AS word, p_name FROM part),
     l AS (SELECT DISTINCT unnest(string_split(p_name, '')) AS letter FROM part),
     t AS (SELECT word, letter, count(*) AS n, count(*) FILTER (contains(p_name, letter)) AS held FROM w, l GROUP BY 1, 2)
SELECT word, coalesce(string_agg(letter, '' ORDER BY letter) FILTER (n = held), '') AS letters FROM t GROUP BY word""")
def agg_set_intersection(spark, folder):
    part = table(spark, folder, "part").select(
        F.split("p_name", " ")[0].alias("word"), F.array_distinct(F.split("p_name", "")).alias("letters"))
    return relational.set_intersection_per_key(part, "word", "letters").select(
        "word", F.array_join("letters", "").alias("letters"))


@query("agg_longest", """
SELECT p_brand, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS k FROM part) WHERE k = 1""")
def agg_longest(spark, folder):
    return relational.longest_per_key(table(spark, folder, "part"), "p_brand", "p_name")


@query("agg_count_if", """
SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
       count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer""")
def agg_count_if(spark, folder):
    return relational.count_if_all(
        table(spark, folder, "customer"), building=F.col("c_mktsegment") == "BUILDING",
        machinery=F.col("c_mktsegment") == "MACHINERY")


@query("agg_distinct", "SELECT DISTINCT user_id FROM events")
def agg_distinct(spark, folder):
    batch = table(spark, folder, "events").select("user_id")
    return batch.unionByName(batch.where("user_id > 50")).dropDuplicates(["user_id"])


@query("agg_max_default", """
SELECT 'all' AS label, coalesce(max(o_orderkey), 0) AS n FROM orders
UNION ALL SELECT 'none', coalesce(max(o_orderkey), 0) FROM orders WHERE o_totalprice < 0""")
def agg_max_default(spark, folder):
    orders = table(spark, folder, "orders")
    return relational.union_all([
        relational.max_or_zero(orders, "o_orderkey", "n").select(F.lit("all").alias("label"), "n"),
        relational.max_or_zero(orders.where("o_totalprice < 0"), "o_orderkey", "n").select(
            F.lit("none").alias("label"), "n")])


@query("agg_sorted_join", """
SELECT string_agg(l_linenumber, ';' ORDER BY l_linenumber) AS numbers FROM (SELECT DISTINCT l_linenumber FROM lineitem)""")
def agg_sorted_join(spark, folder):
    return relational.joined_values(table(spark, folder, "lineitem"), [], "l_linenumber", ";", "numbers", distinct=True)


# --- sorts, limits -------------------------------------------------------------------------


@query("sort_values", "SELECT 'order no. ' || o_orderkey AS label FROM orders WHERE contains(o_orderkey::VARCHAR, '1')")
def sort_values(spark, folder):
    return table(spark, folder, "orders").select(
        tx.prefixed("order no. ", F.col("o_orderkey")).alias("label")
    ).where(F.col("label").contains("1")).orderBy("label")


@query("topk_salary", """
SELECT c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_name LIMIT 10""")
def topk_salary(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 5000")
    return relational.top_k(rich.select("c_name", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_name", 10)


@query("take_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def take_n(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


# --- scalar functions ----------------------------------------------------------------------


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.sha256_hex(F.col("text")).alias("digest"))


@query("fn_lcs", """
WITH f AS (SELECT p_partkey, p_name AS a, lower(p_brand) AS b FROM part),
     s AS (SELECT p_partkey, a[i:j] AS piece, b FROM f, generate_series(1, (SELECT max(length(p_name)) FROM part)) g(i),
                generate_series(1, (SELECT max(length(p_name)) FROM part)) h(j)
           WHERE i <= j AND j <= length(a)),
     r AS (SELECT p_partkey, piece, row_number() OVER (PARTITION BY p_partkey ORDER BY length(piece) DESC, piece) AS k
           FROM s WHERE contains(b, piece))
SELECT f.p_partkey, coalesce(piece, '') AS piece FROM f LEFT JOIN r ON f.p_partkey = r.p_partkey AND k = 1""")
def fn_lcs(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", tx.longest_common_substring("p_name", F.lower("p_brand")).alias("piece"))


@query("fn_remove_chars", "SELECT p_partkey, translate(p_name, 'aeiou', '') AS bare FROM part")
def fn_remove_chars(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", tx.remove_characters(F.col("p_name"), "aeiou").alias("bare"))


@query("fn_array_set", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(w, lambda x: x <> 'red'), ',') AS without_red,
       array_to_string(list_filter(w, lambda x: x IN ('hot', 'ring')), ',') AS in_both FROM w""")
def fn_array_set(spark, folder):
    words = F.split("p_name", " ")
    both = F.array_intersect(words, F.array(F.lit("hot"), F.lit("ring")))
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(F.array_remove(words, "red"), ",").alias("without_red"),
        F.array_join(both, ",").alias("in_both"))


@query("fn_now", """SELECT o_orderkey, (now() AT TIME ZONE 'UTC')::DATE AS today,
       o_orderdate < (now() AT TIME ZONE 'UTC') AS passed FROM orders""")
def fn_now(spark, folder):
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return table(spark, folder, "orders").select(
        "o_orderkey", now.cast("date").alias("today"),
        (F.unix_date(F.col("o_orderdate").cast("date")) < F.unix_date(now.cast("date"))).alias("passed"))


@query("fn_date_add", "SELECT o_orderkey, o_orderdate::DATE + 7 AS next_week FROM orders")
def fn_date_add(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 7).alias("next_week"))


@query("fn_nulls", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '(none)') AS status,
       o_orderstatus = 'P' AS was_null, (o_orderdate + INTERVAL 7 DAY)::DATE AS next_week FROM orders""")
def fn_nulls(spark, folder):
    holes = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("status"))
    # only the text column is filled; a text does not fit the date column
    filled = holes.withColumn("was_null", F.col("status").isNull()).na.fill("(none)", ["day", "status"])
    return filled.select("o_orderkey", "status", "was_null",
                         F.date_add("day", 7).alias("next_week"))
