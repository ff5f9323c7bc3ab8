"""Candidate generators: permutations, words with repetition, primes of a range.

Permutations and words grow level by level: each ``explode`` appends one character.
After the first levels the prefixes are spread over the cluster, and the rest of
the growth happens inside the tasks, without another shuffle and without a list of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.functions.numbers import is_prime
from dataprobe.session import spread

SPREAD_LEVELS = 4
SEGMENT = 1 << 20
MAX_CHARSET = 20
MAX_BASE = 1 << 24
#: Numbers in a segment and in a block of divisors where √high is above ``MAX_BASE``.
WIDE_SEGMENT, BASE_BLOCK = 1 << 25, 1 << 22


def _longest(df: DataFrame, expression: str) -> int:
    return df.agg(F.expr(f"coalesce(max({expression}), 0)").alias("n")).first()["n"]


def permutations(df: DataFrame, charset: str, low: int = 0, high: int | None = None) -> DataFrame:
    """``df`` with ``rank`` and ``word``: the permutations of each row's ``charset``, in
    lexicographic order of positions, ranks in [low, high) only. At most 20 characters.

    A prefix whose ranks all fall outside the range is dropped as soon as it appears.
    """
    longest = _longest(df, f"length(`{charset}`)")
    if longest > MAX_CHARSET:
        raise ValueError(f"{longest} characters have more permutations than a bigint can number")
    grown = df.where(F.col(charset).isNotNull()).withColumns({
        "rank": F.lit(0).cast("long"), "word": F.lit(""), "_rest": F.col(charset)})
    for level in range(longest):
        if level == min(SPREAD_LEVELS, longest - 1):
            grown = spread(grown, *df.columns, "word")
        left = F.length("_rest")
        positions = F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array(F.lit(0)))
        grown = grown.withColumn("_at", F.explode(positions)).withColumns({
            "word": F.when(F.col("_at") > 0, F.concat("word", F.substring("_rest", F.col("_at"), F.lit(1))))
                     .otherwise(F.col("word")),
            "rank": F.when(F.col("_at") > 0, F.col("rank") + (F.col("_at") - 1) * F.factorial(left - 1))
                     .otherwise(F.col("rank")),
            "_rest": F.when(F.col("_at") > 0, F.concat(
                F.substring("_rest", F.lit(1), F.col("_at") - 1),
                F.substring("_rest", F.col("_at") + 1, left))).otherwise(F.lit("")),
        })
        if high is not None:
            grown = grown.where(F.col("rank") < high)
        if low:
            grown = grown.where(F.col("rank") + F.factorial(F.length("_rest")) > low)
    return grown.select(*df.columns, "rank", "word")


def words(df: DataFrame, charset: str, length: str) -> DataFrame:
    """``df`` with ``word``: all texts of the row's ``length`` over the distinct characters of its ``charset``.
    Rows with a null length or character set, or without characters to use, have none."""
    longest = _longest(df, f"`{length}`")
    letters_of = F.array_distinct(F.split(charset, ""))
    grown = df.where(F.col(length).isNotNull() & ((F.length(charset) > 0) | (F.col(length) == 0))).withColumn(
        "word", F.lit(""))
    for level in range(longest):
        if level == min(SPREAD_LEVELS, longest - 1):
            grown = spread(grown, *df.columns, "word")
        open_ = F.length("word") < F.col(length)
        letters = F.when(open_, letters_of).otherwise(F.array(F.lit("")))
        grown = grown.withColumn("_next", F.explode(letters)).withColumn(
            "word", F.concat("word", "_next")).drop("_next")
    return grown


#: Candidates that are made from one row of the domain.
RANKS = 1 << 18


def words_in_ranges(df: DataFrame, charset: str, length: str, ranks: int = RANKS) -> DataFrame:
    """``words`` by ranks: each row's k^n words are cut into ranges of ``ranks``, the ranges are spread over the cluster, and each task
    writes its words down from their ranks, digit by digit. A row's domain must fit a bigint; see ``domain_size``."""
    letters = F.array_distinct(F.split(charset, ""))
    sized = df.withColumn("_letters", letters).withColumn("_size", domain_size(F.col(charset), F.col(length))).where("_size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(ranks).cast("long"))
    ranges = spread(sized.withColumn("_start", F.explode(starts)), *df.columns, "_start")
    ranked = ranges.withColumn("_rank", F.explode(F.sequence("_start", F.least(F.col("_start") + ranks, F.col("_size")) - 1)))
    digit = "transform(sequence(1, {n}), i -> element_at(_letters, CAST(_rank div CAST(power(size(_letters), {n} - i) AS BIGINT) % size(_letters) AS INT) + 1))"
    word = F.when(F.col(length) == 0, "").otherwise(F.expr(f"array_join({digit.format(n=f'`{length}`')}, '')"))
    return ranked.select(*df.columns, word.alias("word"))


def domain_size(charset: Column, length: Column) -> Column:
    """How many words of ``length`` the distinct characters of ``charset`` give: 0 if one is null or there are no characters to use,
    null beyond 10^15."""
    k = F.size(F.array_distinct(F.split(charset, "")))
    size = F.when(length == 0, F.lit(1.0)).when(F.length(charset) == 0, F.lit(0.0)).otherwise(F.pow(k, length))
    return F.when(charset.isNull() | length.isNull() | (length < 0), F.lit(0).cast("long")).when(size <= 1e15, size.cast("long"))


def primes(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The primes of [low, high], both ends included, as ``n``.

    The range is cut into segments and each task sieves its segments; all it needs are
    the primes up to √high, which it derives itself. Where these are too many (√high above ``MAX_BASE``), the numbers
    are tested one by one instead, with the same result.
    """
    schema = "n bigint"
    low = max(low, 2)
    if high < low:
        return spark.createDataFrame([], schema)
    if isqrt(high) > MAX_BASE:
        return _high_primes(spark, low, high)
    width = max(SEGMENT, isqrt(high))
    count = (high - low) // width + 1
    tasks = min(count, 64 * spark.sparkContext.defaultParallelism)

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        divisors = _primes_up_to(isqrt(high))
        for batch in batches:
            for segment in batch["id"]:
                first = low + int(segment) * width
                last = min(first + width - 1, high)
                alive = np.ones(last - first + 1, dtype=bool)
                for p in divisors[: np.searchsorted(divisors, isqrt(last), "right")].tolist():
                    alive[max(p * p, -(-first // p) * p) - first::p] = False
                yield pd.DataFrame({"n": first + np.flatnonzero(alive)})

    return spark.range(0, count, 1, tasks).mapInPandas(sieve, schema)


def _high_primes(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Where the primes up to √high would not fit in a task: they are made block by block, and each block crosses out its
    multiples in the task's segment before the next one is made. A range that is short beside √high is tested number by number."""
    width = min(WIDE_SEGMENT, high - low + 1)
    if width < isqrt(high) // 16:
        return spark.range(low, high + 1).select(F.col("id").alias("n")).where(is_prime("n"))
    count = (high - low) // width + 1

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment in batch["id"]:
                first = low + int(segment) * width
                last = min(first + width - 1, high)
                alive = np.ones(last - first + 1, dtype=bool)
                for divisors in _prime_blocks(isqrt(last)):
                    _cross_out(alive, first, divisors)
                found = first + np.flatnonzero(alive)
                for at in range(0, len(found), SEGMENT):
                    yield pd.DataFrame({"n": found[at:at + SEGMENT]})

    return spark.range(0, count, 1, min(count, 64 * spark.sparkContext.defaultParallelism)).mapInPandas(sieve, "n bigint")


def _prime_blocks(limit: int) -> Iterator[np.ndarray]:
    """The primes up to ``limit`` in blocks of numbers, each sieved by the primes up to √limit."""
    base = _primes_up_to(isqrt(limit))
    for first in range(0, limit + 1, BASE_BLOCK):
        last = min(first + BASE_BLOCK - 1, limit)
        alive = np.ones(last - first + 1, dtype=bool)
        if first == 0:
            alive[:2] = False
        for p in base[: np.searchsorted(base, isqrt(last), "right")].tolist():
            alive[max(p * p, -(-first // p) * p) - first::p] = False
        yield first + np.flatnonzero(alive)


def _cross_out(alive: np.ndarray, first: int, divisors: np.ndarray) -> None:
    """Cross out the multiples of ``divisors``, none of them a member, in the segment that begins with ``first``."""
    begin = np.maximum(divisors * divisors, -(-first // divisors) * divisors) - first
    inside = begin < len(alive)
    few = inside & (divisors >= len(alive) // 8)        # at most 9 multiples each: all at once
    at, step = begin[few], divisors[few]
    while len(at):
        alive[at] = False
        at = at + step
        step, at = step[at < len(alive)], at[at < len(alive)]
    for p, start in zip(divisors[inside & ~few].tolist(), begin[inside & ~few].tolist()):
        alive[start::p] = False


def _primes_up_to(limit: int) -> np.ndarray:
    alive = np.ones(limit + 1, dtype=bool)
    alive[:2] = False
    for p in range(2, isqrt(limit) + 1):
        if alive[p]:
            alive[p * p::p] = False
    return np.flatnonzero(alive)
