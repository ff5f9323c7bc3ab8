"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.llm import decontaminate, merkle, mixing, pages, passages, ppm, quality, sharding, simhash, tokens, urls, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules of the url query, by host, path and verdict (fixed values).
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


@query("op5_url_filter", r"""
    WITH parts AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(
            substr(url, strpos(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest
        FROM pages),
    hosts AS (
        SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
        FROM parts),
    rules (rule_host, rule_path, rule_verdict) AS (VALUES
        ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    hits AS (
        SELECT h.page_id, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (
            PARTITION BY h.page_id ORDER BY length(string_split(rule_host, '.')) DESC, length(rule_path) DESC) AS place
        FROM hosts h JOIN rules ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host))
            AND starts_with(h.path, rule_path))
    SELECT h.page_id, h.host, h.path, x.rule, coalesce(x.rule_verdict, 'allow') AS verdict
    FROM hosts h LEFT JOIN hits x ON x.page_id = h.page_id AND x.place = 1""")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


_PASSAGE_SQL = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    windows AS (
        SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM docs, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
    firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
    removed AS (
        SELECT DISTINCT rid, i + k AS j FROM windows JOIN firsts USING (g), unnest(range(13)) t(k) WHERE doc_id > least),
    words AS (SELECT rid, j, w[j] AS word FROM docs, unnest(range(1, len(w) + 1)) t(j)),
    kept AS (
        SELECT rid, string_agg(word, ' ' ORDER BY j) AS body
        FROM words ANTI JOIN removed USING (rid, j) GROUP BY rid),
    counts AS (SELECT rid, count(*) AS n FROM removed GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (rid) LEFT JOIN counts USING (rid)"""


@query("op1_passage_dedup", _PASSAGE_SQL)
def op1_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = passages.remove_repeated_passages(table(spark, folder, "documents").select("doc_id", "text"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_LEAK_SQL = r"""
    WITH texts AS (
        SELECT DISTINCT item_id AS id, 'item' AS kind, text FROM benchmark
        UNION ALL SELECT doc_id, 'doc', text FROM documents),
    listed AS (
        SELECT row_number() OVER () AS rid, id, kind, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
        FROM texts),
    shingles AS (
        SELECT DISTINCT rid, id, kind, array_to_string(w[i:i + 4], ' ') AS s
        FROM listed, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
    items AS (SELECT rid, id, s, count(*) OVER (PARTITION BY rid) AS n FROM shingles WHERE kind = 'item'),
    shared AS (
        SELECT d.rid, d.id AS doc_id, i.rid AS irid, i.id AS item_id, any_value(i.n) AS n_item, count(*) AS n_shared
        FROM shingles d JOIN items i ON d.kind = 'doc' AND d.s = i.s GROUP BY ALL)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM shared WHERE n_shared * 10 >= n_item * 8"""


@query("op2_decontaminate", _LEAK_SQL)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # The text is reduced to its fingerprint first, so that it isn't moved or read again.
    coded = simhash.with_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
    return simhash.components_of(coded.select("row.doc_id", "fp"))


#: Labels whose ids have this remainder are held out: no model sees them.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def quality_model(spark: SparkSession, folder: str) -> quality.AdditiveModel:
    """The quality model, from the labels that aren't held out."""
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    return quality.train(table(spark, folder, "documents"), labels)


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(spark, folder), threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op7_main_text")
def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


_VECTOR_SQL = """
    WITH RECURSIVE vectors AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors WHERE list_dot_product(v, v) > 0),
    links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b
        ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
    reached (a, b) AS (SELECT vec_id, vec_id FROM units UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
    names AS (SELECT a, min(b) AS component FROM reached GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
           coalesce(vec_id = coalesce(component, vec_id), false) AS kept
    FROM embeddings LEFT JOIN names ON names.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


@query("op8_vector_dedup", _VECTOR_SQL)
def op8_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"), threshold=0.9)
    return found.select("vec_id", "n_links", "component_id", "kept")


#: Three sources get weights of their own, src0 (which may hold a third of all rows) among them; each other one, those without
#: a name too, has the default.
MIX_WEIGHTS, MIX_DEFAULT = {"src0": 6.0, "src1": 3.0, "src2": 2.0}, 1.0

_MIX_SQL = """
    WITH RECURSIVE docs AS (
        SELECT *, coalesce(source, '') AS mixed FROM documents),
    weights AS (
        SELECT mixed, CASE mixed WHEN 'src0' THEN 6.0 WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
        FROM (SELECT DISTINCT mixed FROM docs)),
    sizes AS (
        SELECT mixed, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, any_value(weight) AS weight
        FROM docs JOIN weights USING (mixed) GROUP BY mixed HAVING sum(strlen(coalesce(text, ''))) > 0),
    rates AS (
        SELECT mixed, weight * (sum(bytes) OVER ())::BIGINT / (sum(weight) OVER ()) / bytes AS rate FROM sizes),
    steps (mixed, rate, k, p, c) AS (
        SELECT mixed, rate, 0, exp(-rate), exp(-rate) FROM rates
        UNION ALL
        SELECT mixed, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < 72),
    drawn AS (
        SELECT d.*, (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5)
            / 4503599627370496.0 AS u FROM docs d),
    counted AS (
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rid, count(*) AS n_copies
        FROM (SELECT *, row_number() OVER () AS rid FROM drawn) d JOIN steps s ON s.mixed = d.mixed AND s.c < d.u
        GROUP BY ALL)
    SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, n_copies::INT AS n_copies,
           md5('order 42|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no) AS order_key
    FROM counted, unnest(range(n_copies)) t(copy_no)"""


@query("op9_source_mix", _MIX_SQL)
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), MIX_WEIGHTS, seed=42, default=MIX_DEFAULT)


_SHARD_SQL = r"""
    WITH RECURSIVE steps (i, k, v) AS (
        SELECT i, 0, i::BIGINT FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS c FROM steps WHERE k = 8),
    docs AS (
        SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 8 AS size,
               ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k1,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k2 FROM documents),
    units AS (SELECT k1, k2, sum(size) AS bytes FROM docs GROUP BY k1, k2),
    placed AS (
        SELECT k1, k2, sum(bytes) OVER (ORDER BY k1, k2) - bytes AS unit_at, sum(bytes) OVER (PARTITION BY k1) AS copies,
               sum(bytes) OVER () AS total FROM units),
    shards AS (
        SELECT k1, k2, ((CASE WHEN copies <= floor(total::DOUBLE / 24 * 0.01) THEN min(unit_at) OVER (PARTITION BY k1)
            ELSE unit_at END) * 24 // total)::INT AS shard FROM placed)
    SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])))::BIGINT AS text_crc32,
           'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, NULL::INT AS grown_shard
    FROM docs JOIN shards USING (k1, k2), crc"""


@query("op10_shards", _SHARD_SQL)
def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"), shards=24)
    return out.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


#: Texts whose ids have this remainder are held out: the language model doesn't learn from them.
LM_FOLDS, LM_HELD_OUT = 7, 2


@query("op11_lm_scores")
def op11_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # A row without an id isn't held out.
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % LM_FOLDS == LM_HELD_OUT, F.lit(False))
    scored = ppm.score_texts(docs.withColumn("held_out", out), train=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"), components=4, scale=256)
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


_LEAF_SQL = " || ".join(_field_sql(name) for name in ("doc_id", "source", "lang", "n_chars", "{text}"))

_MERKLE_SQL = rf"""
    WITH RECURSIVE steps (i, k, v) AS (
        SELECT i, 0, i::BIGINT FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS c FROM steps WHERE k = 8),
    hashed AS (
        SELECT row_number() OVER () AS rid, doc_id, source, sha256({_LEAF_SQL.replace("{text}", "text")}) AS leaf,
               CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                   lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])) & 1 = 1
               THEN sha256({_LEAF_SQL.replace("{text}", "replace(text, chr(10), '')")}) END AS changed
        FROM documents, crc),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n FROM hashed),
    nodes (source, level, pos, n, digest) AS (
        SELECT source, 0, pos, n, leaf FROM leaves
        UNION ALL
        SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n),
    subroots AS (
        SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM nodes WHERE n = 1),
    tops (level, pos, n, digest) AS (
        SELECT 0, pos, n, subroot FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
    ranks AS (SELECT level, (3 ** level)::BIGINT AS step FROM range(30) t(level)),
    lower AS (
        SELECT rid, r.level, l.pos // step % 3 AS slot,
               coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> l.pos // step), '') AS siblings
        FROM leaves l JOIN ranks r ON step < l.n
        JOIN nodes s ON s.source IS NOT DISTINCT FROM l.source AND s.level = r.level AND s.pos // 3 = l.pos // step // 3
        GROUP BY ALL),
    upper AS (
        SELECT b.source, r.level, b.pos // step % 3 AS slot,
               coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> b.pos // step), '') AS siblings
        FROM subroots b JOIN ranks r ON step < b.n JOIN tops s ON s.level = r.level AND s.pos // 3 = b.pos // step // 3
        GROUP BY ALL),
    path AS (
        SELECT rid, slot, siblings, row_number() OVER (PARTITION BY rid ORDER BY part, level) AS k
        FROM (SELECT rid, 0 AS part, level, slot, siblings FROM lower
              UNION ALL SELECT rid, 1, level, slot, siblings FROM leaves l JOIN upper u ON u.source IS NOT DISTINCT FROM l.source)),
    folds (rid, k, digest) AS (
        SELECT rid, 0::BIGINT, coalesce(changed, leaf) FROM leaves
        UNION ALL
        SELECT f.rid, p.k, sha256(substr(siblings, 1, 64 * slot) || digest || substr(siblings, 64 * slot + 1))
        FROM folds f JOIN path p ON p.rid = f.rid AND p.k = f.k + 1),
    folded AS (SELECT rid, arg_max(digest, k) AS folded_root FROM folds GROUP BY rid),
    proofs AS (SELECT rid, string_agg(siblings, '' ORDER BY k) AS proof FROM path GROUP BY rid)
    SELECT doc_id, leaf, subroot, digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
           folded_root = digest AS verified
    FROM leaves l JOIN subroots b ON b.source IS NOT DISTINCT FROM l.source JOIN folded USING (rid) LEFT JOIN proofs USING (rid),
         (SELECT digest FROM tops WHERE n = 1)"""


@query("op13_merkle_manifest", _MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def leaf(text: Column) -> Column:
        return merkle.content_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    found = merkle.manifest(docs, "source", "doc_id", leaf(F.col("text")), doc_id=F.col("doc_id"), tampered=tampered)
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("row.tampered", "leaf"), F.col("path")))
    return found.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
