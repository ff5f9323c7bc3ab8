import hashlib
import math
from collections import Counter

import pytest

from dataprobe.llm.mixing import mix_sources, source_rates

WEIGHTS = {"s0": 3.0, "s1": 1.0, "s2": 80.0, "": 0.5}


def inverse(u, mean):
    draws = max(1, math.ceil(mean / 16))
    part, total = mean / draws, 0
    for d in range(draws):
        p = c = math.exp(-part)
        k = 0
        while c < u(d + 1) and k < 72:
            k += 1
            p = p * part / k
            c += p
        total += k
    return total


def test_against_brute_force(docs):
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.source or ""] += len((r.text or "").encode())
    total, weights = sum(size.values()), sum(w for s, w in WEIGHTS.items() if size[s])
    rate = {s: WEIGHTS[s] * total / weights / size[s] for s in WEIGHTS if size[s]}
    assert {r.source: r.rate for r in source_rates(docs, WEIGHTS).collect()} == pytest.approx(rate)
    want = Counter()
    for r in rows:
        name = "" if r.doc_id is None else str(r.doc_id)
        u = lambda d, name=name: (int(hashlib.md5(f"9|{name}|{d}".encode()).hexdigest()[:13], 16) + .5) / 2 ** 52
        n = inverse(u, rate.get(r.source or "", 0.0)) if rate.get(r.source or "") else 0
        for c in range(n):
            want[(r.doc_id, r.text, c, n)] += 1
    out = mix_sources(docs, WEIGHTS, seed=9)
    assert Counter((r.doc_id, r.text, r.copy_no, r.n_copies) for r in out.collect()) == want
    assert sorted(out.columns) == sorted([*docs.columns, "copy_no", "n_copies", "order_key"])


def test_large_means_and_shares(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'0123456789' AS text", "if(id < 40, 'few', 'many') AS source")
    out = mix_sources(df, {"few": 1.0, "many": 1.0}).groupBy("source").count().collect()
    count = dict(out)
    assert abs(count["few"] - 2000) < 200 and abs(count["many"] - 2000) < 200     # means 50 and about 0.5


def test_same_rows_again_and_order(docs):
    a, b = ([(r.doc_id, r.copy_no) for r in mix_sources(docs, seed=1).collect()] for _ in range(2))
    assert sorted(a, key=repr) == sorted(b, key=repr)
    assert Counter(a) != Counter((r.doc_id, r.copy_no) for r in mix_sources(docs, seed=2).collect())


def test_plan_is_native(docs):
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_and_clashing(empty, clashing):
    assert mix_sources(empty).count() == 0
    assert mix_sources(clashing.limit(0), {"x": 1.0}).count() == 0
    out = mix_sources(clashing)
    assert len(out.columns) == len(clashing.columns) and dict(out.dtypes)["copy_no"] == "int"
    with pytest.raises(ValueError):
        mix_sources(clashing, {})


def test_sources_without_a_weight_have_the_default(spark):
    df = spark.createDataFrame([(i, "x" * 10, [None, "src0", "web", "other"][i % 4]) for i in range(400)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in source_rates(df, {"src0": 3.0}, default=1.0).collect()}
    assert rates == {"src0": 2.0, "": 2 / 3, "web": 2 / 3, "other": 2 / 3}
    assert {r.source for r in mix_sources(df, {"src0": 3.0}, default=1.0).collect()} == {None, "src0", "web", "other"}
    assert {r.source for r in source_rates(df, {"src0": 3.0}).collect()} == {"src0"}
