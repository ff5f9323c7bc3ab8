"""Re-identification audit of hashed columns.

Given records with a hashed token, the character set and length of the clear
text and some hashed hints, find out which tokens could be reversed: how well
a pseudonymised column of one's own withstands enumeration.
A hint is the digest of a permutation of the character set without one character; it says
that this character does not occur in the clear text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.text import sha256_hex
from dataprobe.operators.generate import MAX_CHARSET, domain_size, permutations, words, words_in_ranges
from dataprobe.operators.joins import broadcast_if_small, lookup_join
from dataprobe.session import materialize

#: Candidates that a record may need at most.
BUDGET = 10_000_000_000


def records_from_positions(df: DataFrame) -> DataFrame:
    """Records from a table in file order: id, name, character set, length, token, then any number of hints."""
    columns = df.columns
    return df.select(
        F.col(columns[0]).alias("id"), F.col(columns[4]).alias("token"), F.col(columns[2]).alias("charset"),
        F.col(columns[3]).cast("int").alias("length"),
        F.array_compact(F.array(*[F.col(c) for c in columns[5:]])).cast("array<string>").alias("hints"))


def resolve_hints(records: DataFrame, charset: str = "charset", hints: str = "hints") -> DataFrame:
    """``(charset, hint, missing)`` for every distinct hint that can be explained.

    Candidates are made once per distinct character set, however many records use it.
    """
    wanted = materialize(
        records.select(F.col(charset).alias("charset"), F.explode(hints).alias("hint")).distinct(), "wanted")
    charsets = wanted.select("charset").distinct()
    # Longer sets cannot be enumerated: their hints stay without an explanation.
    without_one = charsets.select(
        "charset", F.explode(F.array_distinct(F.split("charset", ""))).alias("missing")
    ).withColumn("rest", F.expr("replace(charset, missing, '')")).where(F.length("rest") <= MAX_CHARSET)
    candidates = permutations(without_one, "rest").select(
        "charset", "missing", sha256_hex(F.col("word")).alias("hint"))
    return candidates.join(broadcast_if_small(wanted), ["charset", "hint"], "left_semi")


def reduce_charsets(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records with ``reduced``, the distinct characters that no resolved hint excludes.

    What is gathered per record are the missing characters, at most as many as its set has; a hint without an
    explanation removes nothing.
    """
    ident = ["id", "token", "charset", "length"]
    gone = (
        lookup_join(records.select(*ident, F.explode_outer("hints").alias("hint")), resolved,
                    ["charset", "hint"], "left")
        .groupBy(*ident).agg(F.collect_set("missing").alias("gone"))
    )
    kept = F.array_except(F.split("charset", ""), F.col("gone"))
    return gone.select("id", "token", "length", F.array_join(kept, "").alias("reduced"))


def resolve_tokens(records: DataFrame) -> DataFrame:
    """``(id, token, value, resolved)``, one row per record.

    ``records`` has ``id, token, charset, length, hints``. Clear texts are enumerated once per
    distinct pair of reduced character set and length.
    """
    resolved = materialize(resolve_hints(records), "hints")
    reduced = materialize(reduce_charsets(records, resolved), "reduced")
    wanted = materialize(reduced.select("reduced", "length", "token").distinct(), "wanted")
    domain = wanted.select("reduced", "length").distinct()
    found = materialize(words(domain, "reduced", "length").withColumn("token", sha256_hex(F.col("word"))).join(
        broadcast_if_small(wanted), ["reduced", "length", "token"]), "words")
    return attach_values(reduced, found.withColumnRenamed("word", "value"), ["reduced", "length", "token"])


def resolve_against(records: DataFrame, domain: DataFrame) -> DataFrame:
    """The same for a domain the caller supplies: ``domain`` is one column ``value``."""
    wanted = materialize(records.select("token").distinct(), "wanted")
    found = materialize(domain.select(F.col("value").cast("string").alias("value")).distinct().withColumn(
        "token", sha256_hex(F.col("value"))).join(broadcast_if_small(wanted), "token", "left_semi"), "words")
    return attach_values(records.select("id", "token"), found, ["token"])


def audit_tokens(records: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(id, token, value, outcome)``, one row per record: ``resolved`` with its clear text, ``unresolved`` if no candidate has its
    token, or ``too large`` if the record needs more than ``budget`` candidates, which are then not made.

    What is counted before anything is made: the permutations of a character set without one character, for each character, if the
    record has hints; and the words of its reduced set. A record that is too large stops nobody else's audit. Words are
    made in ranges of ranks that are spread over the cluster, however few character sets there are.
    """
    letters = F.length("charset")
    work = F.coalesce(letters, F.lit(0)).cast("double") * F.when(letters <= MAX_CHARSET + 1, F.factorial(F.greatest(letters - 1, F.lit(0)))).otherwise(
        F.lit(float("inf")))
    few = F.coalesce(F.size("hints"), F.lit(0)) <= 0
    sized = records.withColumn("_explained", few | F.coalesce(work <= budget, F.lit(True)))
    open_ = sized.where("_explained").drop("_explained")
    resolved = materialize(resolve_hints(open_), "hints")
    reduced = reduce_charsets(open_, resolved)
    size = domain_size(F.col("reduced"), F.col("length"))
    reduced = materialize(reduced.withColumn("fits", F.coalesce(size <= budget, F.lit(False))), "reduced")
    wanted = materialize(reduced.where("fits").select("reduced", "length", "token").distinct(), "wanted")
    domain = wanted.select("reduced", "length").distinct()
    found = materialize(words_in_ranges(domain, "reduced", "length").withColumn("token", sha256_hex(F.col("word"))).join(
        broadcast_if_small(wanted), ["reduced", "length", "token"]), "words").withColumnRenamed("word", "value")
    named = lookup_join(reduced, found, ["reduced", "length", "token"], "left")
    outcome = F.when(~F.col("fits"), "too large").when(F.col("value").isNull(), "unresolved").otherwise("resolved")
    left_out = sized.where("NOT _explained").select("id", "token", F.lit(None).cast("string").alias("value"), F.lit("too large").alias("outcome"))
    return named.select("id", "token", "value", outcome.alias("outcome")).unionByName(left_out)


def attach_values(records: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Left join of each record to its clear text; NULL and ``resolved = false`` without one."""
    return lookup_join(records, found, on, "left").select(
        "id", "token", "value", F.col("value").isNotNull().alias("resolved"))
