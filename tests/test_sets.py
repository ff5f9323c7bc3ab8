import random

import pytest

from dataprobe.operators import sets


@pytest.fixture
def ids(spark):
    return lambda values: spark.createDataFrame([(v,) for v in values], "id long")


def elements(df):
    got = [r["id"] for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_algebra(ids):
    a, b = ids([1, 2, 3, 3]), ids([2, 3, 4, None])
    assert elements(sets.set_and(a, b)) == {2, 3}
    assert elements(sets.set_or(a, b)) == {1, 2, 3, 4}
    assert elements(sets.set_xor(a, b)) == {1, 4}
    assert elements(sets.set_and_not(a, b)) == {1}
    assert sets.intersects(a, b).first()[0] is True
    assert sets.intersects(a, ids([9])).first()[0] is False
    assert sets.set_equals(a, ids([3, 2, 1])).first()[0] is True
    assert sets.set_equals(a, b).first()[0] is False


def test_empty_set(ids):
    empty = ids([])
    assert sets.logical_length(empty).first()[0] == 0
    assert sets.bitmap_cardinality(sets.to_bitmaps(empty)).first()[0] == 0
    assert sets.set_equals(empty, empty).first()[0] is True
    assert sets.intersects(empty, empty).first()[0] is False


def test_laws(ids):
    rng = random.Random(1)
    x, y = ({rng.randrange(200_000) for _ in range(300)} for _ in range(2))
    y |= set(list(x)[:50])
    a, b = ids(sorted(x)), ids(sorted(y))
    assert elements(sets.set_xor(a, b)) == elements(sets.set_and_not(a, b)) | elements(sets.set_and_not(b, a)) == x ^ y
    pa, pb = sets.to_bitmaps(a), sets.to_bitmaps(b)
    assert sets.bitmap_cardinality(pa).first()[0] == len(x)
    assert sets.bitmap_cardinality(sets.bitmap_and(pa, pb)).first()[0] == len(x & y)
    assert sets.bitmap_cardinality(sets.bitmap_or(pa, pb)).first()[0] == len(x | y)


def test_ranges(ids):
    a = ids([1, 5, 9])
    assert elements(sets.fill_range(a, 3, 7)) == {1, 3, 4, 5, 6, 9}
    assert elements(sets.fill_range(a, 3, 3)) == {1, 5, 9}
    assert elements(sets.clear_range(a, 2, 9)) == {1, 9}
    assert elements(sets.flip_range(a, 4, 7)) == {1, 4, 6, 9}
    assert sets.logical_length(a).first()[0] == 10


def ask(operator, probes, a, **how):
    return {r[0]: r[1] for r in operator(probes, a, **how).collect()}


def expected(probes, held, capacity):
    out = {}
    for p in probes:
        after = [i for i in held if i >= p]
        before = [i for i in held if i <= p]
        gap = p
        while gap in held:
            gap += 1
        back = p
        while back in held:
            back -= 1
        out[p] = (min(after, default=-1), max(before, default=-1), gap if gap < capacity else -1,
                  p if p >= capacity else max(back, -1))
    return out


@pytest.mark.parametrize("held, probes, capacity", [
    ([1, 2, 4], [0, 1, 2, 3, 4, 5], 64),
    ([], [0, 7], 64),
    ([0, 1, 2, 63], [0, 2, 62, 63, 64, 70], 64),
    (list(range(65_530, 65_545)) + [200_000, 131_072, 131_071], [0, 65_530, 65_535, 65_536, 65_545, 131_071, 131_073, 199_999, 300_000], 1 << 32),
    ([3_000_000_000, 5], [0, 6, 2_999_999_999, 3_000_000_000, 3_000_000_001], 1 << 32),
    ([1 << 40, 1 << 20], [0, (1 << 20) + 1, (1 << 40) + 1], 1 << 48),
    ([65_535, 1 << 32], [65_535, 65_536, 4_294_901_760, (1 << 32) - 1, 1 << 32], 1 << 40),
])
def test_neighbours(spark, ids, held, probes, capacity):
    asked = spark.createDataFrame([(p,) for p in probes * 2], "probe long")
    a = ids(held * 2)
    wanted = expected(probes, set(held), capacity)
    operators = (sets.next_set, sets.previous_set, sets.next_gap, sets.previous_gap)
    for i, operator in enumerate(operators):
        how = {"capacity": capacity} if i > 1 else {}
        assert ask(operator, asked, a, **how) == {p: w[i] for p, w in wanted.items()}, operator.__name__


def test_random_set_is_stable(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    one, two = elements(sets.random_set(df, "k", 0.3, 7)), elements(sets.random_set(df.repartition(7), "k", 0.3, 7))
    assert one == two and 2_700 < len(one) < 3_300
    assert elements(sets.random_set(df, "k", 0.3, 8)) != one
