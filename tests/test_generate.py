import math
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe.functions.numbers import LIMIT, is_prime, prime_flags
from dataprobe.functions.text import permutation_at
from dataprobe.operators import generate


def charsets(spark, *sets):
    return spark.createDataFrame([(s,) for s in sets], "charset string")


def test_permutations_in_order(spark):
    got = generate.permutations(charsets(spark, "ABC"), "charset").orderBy("rank").collect()
    assert [(r["rank"], r["word"]) for r in got] == list(enumerate(["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"]))


def test_permutations_of_several_lengths(spark):
    sets = ["ABCDEFG", "XYZ", "Q", "", "ABCDE"]
    got = generate.permutations(charsets(spark, *sets), "charset").collect()
    expected = {(s, i, "".join(p)) for s in sets for i, p in enumerate(permutations(s))}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("low, high", [(0, 1), (100, 350), (5039, 5040), (700, None), (0, 0)])
def test_rank_range(spark, low, high):
    got = generate.permutations(charsets(spark, "ABCDEFG"), "charset", low, high).collect()
    expected = ["".join(p) for p in permutations("ABCDEFG")][low:high]
    assert sorted(r["word"] for r in got) == expected


def test_too_many_characters(spark):
    with pytest.raises(ValueError):
        generate.permutations(charsets(spark, "ABCDEFGHIJKLMNOPQRSTU"), "charset")


def test_permutation_at(spark):
    df = spark.range(-1, 25).select("id", permutation_at(F.lit("ABCD"), F.col("id")).alias("w")).collect()
    words = ["".join(p) for p in permutations("ABCD")]
    assert [r["w"] for r in df] == [None, *words, None]
    last = spark.range(1).select(permutation_at(F.lit("ABCDEFGHIJKLMNOPQRST"), F.lit(math.factorial(20) - 1))).first()[0]
    assert last == "TSRQPONMLKJIHGFEDCBA"


def test_words(spark):
    df = spark.createDataFrame([("AB", 2), ("XYZ", 6), ("Q", 0), ("", 3), ("AB", None), (None, 2)], "charset string, length int")
    got = sorted((r["charset"], r["word"]) for r in generate.words(df, "charset", "length").collect())
    expected = sorted((s, "".join(p)) for s, n in [("AB", 2), ("XYZ", 6), ("Q", 0), ("", 3)] for p in product(s, repeat=n))
    assert got == expected


def test_words_over_distinct_characters(spark):
    df = spark.createDataFrame([("ABA", 2)], "charset string, length int")
    assert sorted(r["word"] for r in generate.words(df, "charset", "length").collect()) == ["AA", "AB", "BA", "BB"]


@pytest.mark.parametrize("low, high, expected", [
    (1, 10, [2, 3, 5, 7]), (5, 11, [5, 7, 11]), (-5, 1, []), (10, 2, []), (2, 2, [2]), (24, 28, [])])
def test_primes(spark, low, high, expected):
    assert sorted(r["n"] for r in generate.primes(spark, low, high).collect()) == expected


def test_primes_of_a_high_range(spark, monkeypatch):
    assert sorted(r["n"] for r in generate.primes(spark, 10**18, 10**18 + 10).collect()) == [10**18 + 3, 10**18 + 9]
    sieved = sorted(r["n"] for r in generate.primes(spark, 9_000, 11_000).collect())
    monkeypatch.setattr(generate, "MAX_BASE", 10)
    assert sorted(r["n"] for r in generate.primes(spark, 9_000, 11_000).collect()) == sieved


def test_prime_counts(spark):
    assert generate.primes(spark, 0, 200_000).count() == 17_984
    high = 10**12 + 3_000_000
    got = generate.primes(spark, 10**12, high).toPandas()["n"].to_numpy()
    assert np.array_equal(np.sort(got), np.flatnonzero(prime_flags(np.arange(10**12, high + 1))) + 10**12)


def test_primality_of_columns(spark):
    small = [n for n in range(-20, 2000)]
    truth = [n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1)) for n in small]
    df = spark.createDataFrame([(n,) for n in small] + [(None,)], "n long")
    assert [r[0] for r in df.select(is_prime("n")).collect()] == [*truth, None]


def test_large_primes_and_pseudoprimes():
    values = np.array([2_147_483_647, 999_999_999_989, 341_550_071_728_321 - 2, 3_215_031_751, 3_474_749_660_383,
                       2_152_302_898_747, 999_999_999_989 * 3, 18_014_398_509 * 2 + 1, 99_999_999_977 ** 1])
    naive = [all(int(n) % d for d in range(2, min(math.isqrt(int(n)), 2_000_000) + 1)) for n in values]
    assert prime_flags(values).tolist()[:2] == [True, True]
    assert prime_flags(values).tolist()[3:6] == [False, False, False]  # strong pseudoprimes to small bases
    assert [bool(f) for f in prime_flags(values)[6:]] == naive[6:]
    assert (values < LIMIT).all()


def test_primality_up_to_the_end_of_the_range(spark, rows):
    """Known primes and composites (fixed values), among them the square of a large prime and the first number out of reach of
    the array arithmetic, a strong pseudoprime to its bases."""
    known = {9_223_372_036_854_775_783: True, 9_223_372_036_854_775_807: False, LIMIT: False, 1_000_000_000_000_000_003: True,
             3_037_000_493 ** 2: False, (1 << 61) - 1: True, LIMIT + 2: False, -LIMIT: False}
    df = spark.createDataFrame([(n,) for n in known], "n long").select("n", is_prime("n"))
    assert dict(rows(df)) == known


@pytest.mark.parametrize("low, high", [(10 ** 15, 10 ** 15 + 3_000_000), (1 << 50, (1 << 50) + 5_000)])
def test_high_primes_by_blocks_of_divisors(spark, monkeypatch, low, high):
    from dataprobe.functions.numbers import prime_flags
    found = [r["n"] for r in generate.primes(spark, low, high).orderBy("n").collect()]
    numbers = np.arange(low, min(high, low + 40_000) + 1)
    assert [n for n in found if n <= numbers[-1]] == numbers[prime_flags(numbers)].tolist()
    plan = generate.primes(spark, low, high)._jdf.queryExecution().executedPlan().toString()
    assert ("MapInPandas" in plan) == (high - low > 10_000)     # short ranges are tested number by number


def test_blocks_of_divisors_give_the_primes(monkeypatch):
    monkeypatch.setattr(generate, "BASE_BLOCK", 97)
    assert np.concatenate(list(generate._prime_blocks(3000))).tolist() == generate._primes_up_to(3000).tolist()
    for first, n in ((2, 500), (10_000, 700), (999_000, 40)):
        alive = np.ones(n, dtype=bool)
        for divisors in generate._prime_blocks(1000):
            generate._cross_out(alive, first, divisors)
        primes = set(generate._primes_up_to(1_000_000).tolist())
        assert (first + np.flatnonzero(alive)).tolist() == [x for x in range(first, first + n) if x in primes]
