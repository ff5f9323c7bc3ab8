"""Candidate generation, the audit of hashed tokens, prime search and versioned writes."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions import text as tx
from dataprobe.operators import audit, generate, relational, versions
from dataprobe.plans.registry import query, table
from dataprobe.session import materialize, scratch_path
from dataprobe.sources.readers import CsvSpec, number_range, read_csv

# The character sets: the distinct letters of each distinct word of the part names.
CHARSETS_SQL = """
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS base FROM part),
letters AS (SELECT DISTINCT base, unnest(string_split(base, '')) AS c FROM words),
sets AS (SELECT base, string_agg(c, '' ORDER BY c) AS charset FROM letters WHERE c <> '' GROUP BY base)"""
RANKED_SQL = f"""
{CHARSETS_SQL},
grow AS (
  SELECT base, charset, '' AS word FROM sets
  UNION ALL
  SELECT g.base, g.charset, g.word || l.c FROM grow g JOIN letters l ON g.base = l.base
  WHERE NOT contains(g.word, l.c)),
ranked AS (SELECT base, word, row_number() OVER (PARTITION BY base ORDER BY word) - 1 AS rank
           FROM grow WHERE length(word) = length(charset))"""


def _charsets(spark, folder):
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("base")).distinct()
    return words.where("base <> ''").select("base", tx.distinct_letters(F.col("base")).alias("charset"))


@query("gen_permutations", f"WITH RECURSIVE {RANKED_SQL} SELECT base, word, rank FROM ranked")
def gen_permutations(spark, folder):
    return generate.permutations(_charsets(spark, folder), "charset").select("base", "word", "rank")


@query("permutation_at", f"""
WITH RECURSIVE {RANKED_SQL}, ends AS (SELECT base, max(rank) + 1 AS rank FROM ranked GROUP BY base)
SELECT base, rank, word FROM ranked UNION ALL SELECT base, rank, NULL FROM ends""")
def permutation_at(spark, folder):
    """Every rank of every set, and the first one that is too great."""
    ranks = _charsets(spark, folder).withColumn(
        "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.factorial(F.length("charset")))))
    return ranks.select("base", "rank", tx.permutation_at(F.col("charset"), F.col("rank")).alias("word"))


@query("gen_words", f"""
WITH {CHARSETS_SQL}, l AS (SELECT * FROM letters WHERE c <> '')
SELECT base, c AS word FROM l
UNION ALL SELECT x.base, x.c || y.c FROM l x JOIN l y ON x.base = y.base
UNION ALL SELECT x.base, x.c || y.c || z.c FROM l x JOIN l y ON x.base = y.base JOIN l z ON x.base = z.base""")
def gen_words(spark, folder):
    """All words of one to three letters."""
    charsets = _charsets(spark, folder).withColumn("length", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])))
    return generate.words(charsets, "charset", "length").select("base", "word")


# Audit records made from the customers. The character set is ABCDEF; a secret of four letters uses exactly two
# of them, picked by the key; the other four have one hint each, a rotation of the letters without them.
# Every tenth token belongs to a text outside the domain. The expressions are valid in both dialects.
FIRST = "CAST(c_custkey % 6 AS INT)"
SECOND = "CAST((c_custkey + 1 + ((c_custkey - c_custkey % 6) / 6) % 5) % 6 AS INT)"
PATTERN = "CAST(((c_custkey - c_custkey % 30) / 30) % 14 AS INT) + 1"
LETTER = "substring('ABCDEF', {} + 1, 1)"
REST = "replace('ABCDEF', missing, '')"
ROTATED = (f"concat(substring({REST}, CAST(c_custkey % 5 AS INT) + 1, 5), "
           f"substring({REST}, 1, CAST(c_custkey % 5 AS INT)))")
SECRET = ("CASE WHEN c_custkey % 10 = 9 THEN concat('outside ', CAST(c_custkey AS STRING)) ELSE concat("
          + ", ".join(f"CASE WHEN pattern & {1 << b} > 0 THEN one ELSE two END" for b in range(4)) + ") END")

RECORDS_SQL = f"""
base AS (SELECT c_custkey, {LETTER.format(FIRST)} AS one, {LETTER.format(SECOND)} AS two, {PATTERN} AS pattern FROM customer),
secrets AS (SELECT c_custkey AS id, one, two, {SECRET} AS secret FROM base),
hints AS (SELECT c_custkey, missing, sha256({ROTATED}) AS hint
          FROM base, unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS t(missing) WHERE missing <> one AND missing <> two)"""


def _records(spark, folder):
    """``(id, token, charset, length, hints)``."""
    base = table(spark, folder, "customer").selectExpr(
        "c_custkey", f"{LETTER.format(FIRST)} AS one", f"{LETTER.format(SECOND)} AS two", f"{PATTERN} AS pattern")
    others = "filter(split('ABCDEF', ''), missing -> missing <> one AND missing <> two)"
    return base.selectExpr(
        "c_custkey AS id", f"sha2({SECRET}, 256) AS token", "'ABCDEF' AS charset", "4 AS length",
        f"transform({others}, missing -> sha2({ROTATED}, 256)) AS hints")


@query("resolve_hints", f"WITH {RECORDS_SQL} SELECT DISTINCT 'ABCDEF' AS charset, hint, missing FROM hints")
def resolve_hints(spark, folder):
    return audit.resolve_hints(_records(spark, folder))


@query("join_hints", f"""WITH {RECORDS_SQL}
SELECT id, sha256(secret) AS token, 4 AS length, least(one, two) || greatest(one, two) AS reduced FROM secrets""")
def join_hints(spark, folder):
    records = _records(spark, folder)
    return audit.reduce_charsets(records, materialize(audit.resolve_hints(records), "hints"))


TOKENS_SQL = f"""WITH {RECORDS_SQL}
SELECT id, sha256(secret) AS token, CASE WHEN id % 10 <> 9 THEN secret END AS value, id % 10 <> 9 AS resolved FROM secrets"""


@query("resolve_tokens", TOKENS_SQL)
def resolve_tokens(spark, folder):
    return audit.resolve_tokens(_records(spark, folder))


@query("audit_outcomes", f"""WITH {RECORDS_SQL}
SELECT id, sha256(secret) AS token, CASE WHEN id % 7 <> 3 AND id % 10 <> 9 THEN secret END AS value,
       CASE WHEN id % 7 = 3 THEN 'too large' WHEN id % 10 = 9 THEN 'unresolved' ELSE 'resolved' END AS outcome FROM secrets""")
def audit_outcomes(spark, folder):
    """Every seventh record claims a length of 40 characters, beyond any budget."""
    records = _records(spark, folder).withColumn("length", F.when(F.col("id") % 7 == 3, 40).otherwise(F.col("length")))
    return audit.audit_tokens(records)


@query("resolve_tokens_csv", TOKENS_SQL)
def resolve_tokens_csv(spark, folder):
    """The same audit from a described CSV file: id, name, characters, length, token, hints, by position."""
    records = _records(spark, folder).select(
        "id", F.concat(F.lit("name; "), "id").alias("name"), "charset", "length", "token",
        *[F.get("hints", F.lit(i)).alias(f"hint{i + 1}") for i in range(4)])
    path = scratch_path(spark, "records")
    records.write.option("header", "true").option("sep", ";").csv(path)
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in records.schema.fields])
    return audit.resolve_tokens(audit.records_from_positions(
        read_csv(spark, CsvSpec(path, separator=";", schema=kinds))))


@query("resolve_against", """
SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS token, c_custkey::VARCHAR AS value, c_custkey IS NOT NULL AS resolved
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def resolve_against(spark, folder):
    """Which pseudonyms of customers could be undone by whoever knows the customers in credit?"""
    records = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), tx.sha256_hex(F.col("o_custkey")).alias("token"))
    domain = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("value"))
    return audit.resolve_against(records, domain)


def _key_range(spark, folder):
    """Smallest and greatest order key; two numbers."""
    ends = table(spark, folder, "orders").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).first()
    return (0, -1) if ends["low"] is None else (ends["low"], ends["high"])


@query("range_source", "SELECT n FROM generate_series((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM orders)) g(n)")
def range_source(spark, folder):
    return number_range(spark, *_key_range(spark, folder))


PRIMES_SQL = """WITH numbers AS (SELECT n FROM generate_series({low}, (SELECT {high} FROM orders)) g(n)),
divisors AS (SELECT d FROM (SELECT max(n) AS top FROM numbers), generate_series(2, cast(ceil(sqrt(top)) AS BIGINT) + 1) g(d)),
primes AS (SELECT n FROM numbers WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM divisors WHERE d * d <= n AND n % d = 0))"""


@query("prime_range", PRIMES_SQL.format(low="(SELECT min(o_orderkey) FROM orders)", high="max(o_orderkey)")
       + " SELECT n FROM primes")
def prime_range(spark, folder):
    return generate.primes(spark, *_key_range(spark, folder))


@query("prime_union", PRIMES_SQL.format(low="0", high="2 * max(o_orderkey)")
       + " SELECT count(*) AS n_distinct, coalesce(max(n), 0) AS max_value FROM primes")
def prime_union(spark, folder):
    """Two overlapping searches; each prime counts once."""
    _, high = _key_range(spark, folder)
    both = relational.union_all([generate.primes(spark, 0, high), generate.primes(spark, high // 2, 2 * high)])
    return both.dropDuplicates(["n"]).agg(
        F.count("*").alias("n_distinct"), F.coalesce(F.max("n"), F.lit(0)).alias("max_value"))


# Versioned writes: the events of a user are writes to one key, versioned by the hour.
HOUR_SQL = "cast(floor(epoch(ts) / 3600) AS BIGINT)"
LWW_SQL = f"""
SELECT user_id, event_type, counter, event_id FROM (
  SELECT user_id, event_type, event_id, {HOUR_SQL} AS counter,
         row_number() OVER (PARTITION BY user_id ORDER BY {HOUR_SQL} DESC, event_id DESC) AS k FROM events) WHERE k = 1"""


def versioned_events(events):
    # hours since 1970 from the calendar fields, which no session time zone can shift
    hour = (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).cast("long")
    return events.select("user_id", "event_type", hour.alias("counter"), "event_id")


@query("lww_merge", LWW_SQL)
def lww_merge(spark, folder):
    writes = versioned_events(table(spark, folder, "events"))
    return versions.lww_merge(writes, "user_id", "event_type", "counter", "event_id")


@query("lww_read", f"SELECT * FROM ({LWW_SQL}) WHERE user_id = 42")
def lww_read(spark, folder):
    writes = versioned_events(table(spark, folder, "events"))
    return versions.lww_read(writes, 42, "user_id", "event_type", "counter", "event_id")


FOLD_SQL = """
WITH RECURSIVE w AS (
  SELECT {key} AS key, event_id AS seq, event_id % 5 AS leader,
         CASE WHEN event_id % 17 <> 3 THEN cast(floor(value) AS BIGINT) % 40 + event_id // {slower} END AS counter,
         row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS k FROM events),
fold AS (
  SELECT key, k, seq, leader, counter, counter IS NOT NULL AS accepted, counter + 1 AS stored,
         CASE WHEN counter IS NOT NULL THEN leader END AS holder FROM w WHERE k = 1
  UNION ALL
  SELECT key, k, seq, leader, counter, take, CASE WHEN take THEN counter + 1 ELSE stored END,
         CASE WHEN take THEN leader ELSE holder END
  FROM (SELECT w.*, f.stored, f.holder, w.counter IS NOT NULL AND (f.stored IS NULL OR w.counter > f.stored
          OR (w.counter = f.stored AND w.leader > f.holder)) AS take
        FROM fold f JOIN w ON w.key = f.key AND w.k = f.k + 1))
SELECT key, seq, leader, counter, accepted, stored FROM fold"""


def fold_writes(spark, folder, key, slower):
    counter = F.floor("value").cast("long") % 40 + F.expr(f"event_id div {slower}")
    return table(spark, folder, "events").select(
        F.col(key).alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("leader"),
        F.when(F.col("event_id") % 17 != 3, counter).alias("counter"))


@query("lamport_fold", FOLD_SQL.format(key="user_id", slower=1_000_000_000))
def lamport_fold(spark, folder):
    """Many short histories, with writes that lack a counter."""
    return versions.lamport_fold(fold_writes(spark, folder, "user_id", 1_000_000_000))


@query("lamport_fold_long", FOLD_SQL.format(key="event_type", slower=100))
def lamport_fold_long(spark, folder):
    """A few long histories, in blocks of 1,000 writes."""
    return versions.lamport_fold(fold_writes(spark, folder, "event_type", 100), block_rows=1_000)
