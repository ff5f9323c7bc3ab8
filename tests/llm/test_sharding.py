import hashlib
from collections import Counter, defaultdict

import pytest

from dataprobe.llm import sharding
from dataprobe.llm.sharding import shard_documents


def key(value):
    return int(hashlib.md5(value.encode()).hexdigest()[:15], 16)


def brute(rows, shards, share=0.01):
    """Shard of each (text, id) unit, by the first byte of its text's copies or, for large groups, of the unit."""
    units = Counter()
    for i, t in rows:
        units[(key(t or ""), key("" if i is None else str(i)))] += len((t or "").encode()) + 8
    total, groups = sum(units.values()), Counter()
    for (a, _), n in units.items():
        groups[a] += n
    out, at, group_at, last = {}, 0, 0, None
    for a, b in sorted(units):
        if a != last:
            group_at, last = at, a
        first = group_at if groups[a] <= int(total / shards * share) else at
        out[a, b] = first * shards // total
        at += units[a, b]
    return out


@pytest.mark.parametrize("shards", [1, 3, 24, 200])
def test_against_brute_force(docs, shards):
    out = shard_documents(docs, shards).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], shards)
    slots = defaultdict(list)
    for r in out:
        assert r.shard == want[key(r.text or ""), key("" if r.doc_id is None else str(r.doc_id))]
        assert r.size == len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert len(out) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("cells", [4, 1024])
def test_large_group_of_copies(spark, cells):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    out = shard_documents(df, 12, cells=cells).collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()], 12)
    size = Counter()
    for r in out:
        assert r.shard == want[key(r.text), key(str(r.doc_id))]
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 0.05 * max(size.values())


def test_copies_stay_together(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id % 2500) AS text")
    place = defaultdict(set)
    for r in shard_documents(df, 24, whole_share=0.1).collect():
        place[r.text].add(r.shard)
    assert all(len(s) == 1 for s in place.values())


def test_plan_is_native_and_moves_once(docs):
    plan = shard_documents(docs, 24)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_tables_from_the_driver_are_bounded():
    assert sharding.CELLS + (1 << sharding.DIGIT) < 10_000


def test_empty_and_clashing(empty, clashing):
    assert shard_documents(empty, 5).count() == 0
    out = shard_documents(clashing, 5)
    assert len(out.columns) == len(clashing.columns) and out.count() == 12 and dict(out.dtypes)["shard"] == "int"
    with pytest.raises(ValueError):
        shard_documents(empty, 0)
