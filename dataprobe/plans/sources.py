"""Readers and sinks: tables are written out in another format and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.operators import learn, relational
from dataprobe.plans.registry import query, table
from dataprobe.session import scratch_path
from dataprobe.sources import readers, records, sinks


@query("scan_parquet", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def scan_parquet(spark, folder):
    return table(spark, folder, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_extendedprice")


@query("scan_csv_header", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_header(spark, folder):
    path = scratch_path(spark, "customers")
    table(spark, folder, "customer").write.csv(path, header=True)
    df = readers.read_csv(spark, readers.CsvSpec(path, infer=True))
    return df.select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("scan_csv_noheader", "SELECT p_partkey::VARCHAR AS part, p_name AS label, p_brand AS brand, p_type AS kind FROM part")
def scan_csv_noheader(spark, folder):
    path = scratch_path(spark, "parts")
    table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type").write.csv(path)
    return readers.read_csv(spark, readers.CsvSpec(path, header=False), ["part", "label", "brand", "kind"])


# The tables of the folder and their columns.
FOLDER = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
          "supplier": ["s_suppkey", "s_name", "s_nationkey"]}


@query("scan_csv_dir", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {t} GROUP BY 3"
    for t, columns in FOLDER.items() for c in columns))
def scan_csv_dir(spark, folder):
    """A folder of several different tables, one plain file each; the values of every column of each."""
    path = scratch_path(spark, "tables")
    for name, columns in FOLDER.items():
        sinks.write_csv_file(table(spark, folder, name).select(*columns), f"{path}/{name}.csv", sep=";")
    cells = []
    for name, df in readers.read_csv_folder(spark, path).items():
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]))
        cells.append(df.select(F.lit(name).alias("table_name"), pairs.alias("x")).select("table_name", "x.*"))
    return relational.union_all(cells).groupBy("table_name", "column_name", "value").agg(F.count("*").alias("n"))


@query("scan_csv_descriptor", """SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders""")
def scan_csv_descriptor(spark, folder):
    path = scratch_path(spark, "described")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    orders.write.csv(path, header=True, sep="|", quote="'", encoding="UTF-8", nullValue="")
    return readers.read_csv(spark, readers.CsvSpec(
        path, schema=orders.schema, separator="|", quote="'", trim_leading_space=True, skip_bad_lines=True))


@query("scan_csv_multi_line", "SELECT doc_id, text, lang, source FROM documents")
def scan_csv_multi_line(spark, folder):
    """Texts with line breaks and quotes, each file read by many tasks."""
    path = scratch_path(spark, "records")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    docs.write.csv(path, header=True, quoteAll=True, nullValue="", emptyValue="")
    found = records.read_csv_records(spark, readers.CsvSpec(path, schema=docs.schema))
    return found


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(spark, folder):
    path = scratch_path(spark, "json")
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    events.write.json(path)
    return readers.read_json(spark, path, events.schema)


@query("scan_text", "SELECT p_partkey || ' ' || p_name AS value FROM part")
def scan_text(spark, folder):
    path = scratch_path(spark, "text")
    sinks.write_lines(table(spark, folder, "part").select(F.concat_ws(" ", "p_partkey", "p_name").alias("value")),
                      "value", path)
    return readers.read_text(spark, path)


@query("scan_libsvm", """
SELECT label::DOUBLE AS label, (i - 1)::INTEGER AS place, count(*) AS n, min(embedding[i])::DOUBLE AS least, max(embedding[i])::DOUBLE AS most
FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY 1, 2""")
def scan_libsvm(spark, folder):
    """The values of each feature, by label."""
    path = scratch_path(spark, "libsvm")
    vectors = learn.labelled_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    vectors.write.format("libsvm").save(path)
    values = readers.read_libsvm(spark, path).select("label", F.posexplode(learn.vector_to_array("features")).alias("place", "value"))
    return values.groupBy("label", "place").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("inline_rows", """
WITH segments(segment, grade) AS (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('HOUSEHOLD', 3))
SELECT segment, grade, count(*) AS customers FROM customer JOIN segments ON c_mktsegment = segment GROUP BY 1, 2""")
def inline_rows(spark, folder):
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("grade", T.IntegerType())])
    segments = readers.inline_rows(spark, [("BUILDING", 1), ("MACHINERY", 2), ("HOUSEHOLD", 3)], schema)
    customers = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("customers"))
    return customers.join(F.broadcast(segments), "segment").select("segment", "grade", "customers")


@query("collect_append", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def collect_append(spark, folder):
    path = scratch_path(spark, "log")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O"):
        sinks.append_rows(orders.where(F.col("o_orderstatus") == status), path)
    return spark.read.schema(orders.schema).parquet(path)
