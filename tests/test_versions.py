import random

import pytest

from dataprobe.operators import versions
from dataprobe.operators.versions import _block_effect


def loop(writes):
    """Plain replay: (key, seq) -> (accepted, stored)."""
    state, out = {}, {}
    for key, seq, leader, counter in sorted(writes, key=lambda w: w[1]):
        old = state.get(key)
        take = None not in (key, leader, counter) and (old is None or old < (counter, leader))
        if take:
            state[key] = (counter + 1, leader)
        out[key, seq] = (take, state[key][0] if key in state else None)
    return out


def test_last_writer_wins(spark, rows):
    data = [(1, "a", 1, 9), (1, "b", 2, 1), (1, "z", 2, 0), (2, "x", 5, 5)]
    schema = "key int, value string, counter int, identifier int"
    merged = versions.lww_merge(spark.createDataFrame(data, schema), "key", "value", "counter", "identifier")
    assert rows(merged) == [(1, "b", 2, 1), (2, "x", 5, 5)]
    again = versions.lww_merge(spark.createDataFrame(data[::-1] * 2, schema), "key", "value", "counter", "identifier")
    assert rows(again) == rows(merged)
    df = spark.createDataFrame(data, schema)
    assert rows(versions.lww_read(df, 2, "key", "value", "counter", "identifier")) == [(2, "x", 5, 5)]
    assert rows(versions.lww_read(df, 7, "key", "value", "counter", "identifier")) == []


def test_same_leader_same_counter_is_refused(spark, rows):
    df = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 1), (1, 3, 2, 1)], "key int, seq long, leader int, counter int")
    assert rows(versions.lamport_fold(df)) == [(1, 1, 1, 0, True, 1), (1, 2, 1, 1, False, 1), (1, 3, 2, 1, True, 2)]


@pytest.mark.parametrize("long_history, block_rows", [(10_000, 10), (20, 7), (0, 13), (5, 1000)])
def test_fold_against_loop(spark, long_history, block_rows):
    rng = random.Random(long_history + block_rows)
    writes = [(0 if rng.random() < 0.4 else rng.choice([None, *range(1, 30)]), seq * 3, rng.choice([None, *range(12)]),
               rng.choice([None, *range(20)]) if rng.random() < 0.2 else (1 << 60) * (seq % 50 == 7) + rng.randrange(30) + seq // 20)
              for seq in range(600)]
    df = spark.createDataFrame(writes, "key long, seq long, leader long, counter long")
    got = versions.lamport_fold(df, long_history, block_rows).collect()
    assert len(got) == len(writes)
    assert {(r["key"], r["seq"]): (r["accepted"], r["stored"]) for r in got} == loop(writes)
    assert sorted(((r["key"], r["seq"], r["leader"], r["counter"]) for r in got), key=repr) == sorted(writes, key=repr)


@pytest.mark.parametrize("long_history", [1_000, 0])
def test_first_write_without_a_counter(spark, rows, long_history):
    df = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, 3)], "key long, seq long, leader long, counter long")
    assert rows(versions.lamport_fold(df, long_history)) == [(1, 1, 1, None, False, None), (1, 2, 1, 3, True, 4)]


def test_effect_of_a_block_on_every_earlier_state():
    rng = random.Random(4)
    for _ in range(300):
        writes = [(rng.randrange(8), rng.randrange(3)) for _ in range(rng.randrange(1, 12))]
        effect = _block_effect(writes)
        for state in [None, *((c, l) for c in range(10) for l in range(3))]:
            expected = state
            for counter, leader in writes:
                if expected is None or (counter, leader) > expected:
                    expected = (counter + 1, leader)
            got = next(((c, l) for bc, bl, c, l in effect if state is None or state < (bc, bl)), state)
            assert got == expected


def test_effects_of_two_blocks_in_a_row():
    rng = random.Random(8)
    for _ in range(300):
        first, second = ([(rng.randrange(8), rng.randrange(3)) for _ in range(rng.randrange(0, 7))] for _ in range(2))
        both = versions._both(_block_effect(first), _block_effect(second))
        for state in [None, *((c, l) for c in range(10) for l in range(3))]:
            assert versions._after(both, state) == versions._after(_block_effect(second), versions._after(_block_effect(first), state))


def test_many_blocks_are_chained_in_a_tree(spark, monkeypatch):
    """A key over many blocks: no task gets more than a few block summaries, and the log isn't replayed twice."""
    import dataprobe.session as session

    monkeypatch.setattr(versions, "CHAIN", 3)
    monkeypatch.setattr(session, "PLANS", [])
    rng = random.Random(2)
    writes = [(seq % 11 == 0, seq, rng.randrange(9), rng.randrange(40) + seq // 30) for seq in range(900)]
    df = spark.createDataFrame([(int(k), *rest) for k, *rest in writes], "key long, seq long, leader long, counter long")
    got = versions.lamport_fold(df, 20, 40)
    assert sum("FlatMapCoGroupsInArrow" in plan for plan in session.PLANS) >= 3     # levels on the way down
    assert got._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    assert {(r["key"], r["seq"]): (r["accepted"], r["stored"]) for r in got.collect()} == loop(
        [(int(k), *rest) for k, *rest in writes])
