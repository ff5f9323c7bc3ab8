import numpy as np
import pytest

from dataprobe.llm import vectors


def brute(rows, threshold=.9):
    if len(sizes := {len(v) for _, v in rows if v}) > 1:        # each length by itself
        return {k: x for n in sizes | {0} for k, x in brute([r for r in rows if len(r[1] or []) == n], threshold).items()}
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids]).reshape(len(ids), -1)
    near = x @ x.T >= threshold
    label = dict(zip(ids, ids))
    for _ in ids:
        for k, i in enumerate(ids):
            label[i] = min(label[j] for j, n in zip(ids, near[k]) if n)
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    return {i: (links.get(i, 0), label.get(i, i)) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 8))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60, 160):
        out.append((i, (base[r.integers(20)] + r.normal(size=8) * r.choice([.02, .2, .5])).tolist()))
    out += [(i, base[3].tolist()) for i in range(160, 200)]           # exact copies
    out += [(200, (base[3] * 7).tolist()), (201, None), (202, [0.0] * 8), (203, [None, *base[1][1:].tolist()]),
            (204, [float("nan"), *base[1][1:].tolist()]), (205, [float("inf")] + [1.0] * 7), (206, [1.0, 2.0]), (207, []),
            (208, [2.0, 4.0]), (209, [2.0, -1.0]), (210, [1.0, 2.0, 0.0]), (211, [1.0, 2.1])]
    return [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in out]


@pytest.mark.parametrize("long_list", [vectors.LONG_LIST, 5])
def test_against_brute_force(spark, rows, long_list):
    """With as many shared pivots as give full recall here, all links are found and none is invented, in cut lists too."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vectors.near_vectors(df, pivots=6, depth=5, shared=2, long_list=long_list).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found) and len(found) == len(rows)


def test_recall_with_the_defaults(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=(400, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = r.uniform(.9005, .96, size=(400, 1))
    both = np.vstack([base, cosine * base + np.sqrt(1 - cosine ** 2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<float>")
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    true = int((unit @ unit.T >= .9).sum()) - len(unit)
    found = sum(r.n_links for r in vectors.near_vectors(df).collect())
    assert .9 * true <= found <= true


def test_null_ids_copies_and_names(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "old"), (5, [1.0, 0.0], "old"), (4, [2.0, 0.0], "old"), (5, [1.0, 0.0], "old")],
                               "vec_id long, embedding array<double>, Kept string")
    out = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert out == [(-1, 0, None, False), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False)]
    assert vectors.near_vectors(df).columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.select("vec_id", "embedding").where("vec_id IS NULL")).count() == 1
