import random
import re

import numpy as np
import xxhash

from dataprobe.llm import simhash

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def fingerprint(text, n=3, seed=42):
    w = words(text)
    grams = [" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, radius=3):
    """``points``: number -> fingerprint."""
    parent = {i: i for i in points}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in points:
        for b in points:
            if a < b and bin(points[a] ^ points[b]).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in points}


def test_documents(docs):
    out = simhash.simhash_components(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.fingerprint == f"{fingerprint(r.text):016x}"
    points = {}
    for r in out:
        if r.doc_id is not None:
            points.setdefault(fingerprint(r.text), r.doc_id)
            points[fingerprint(r.text)] = min(points[fingerprint(r.text)], r.doc_id)
    of = components({i: f for f, i in points.items()})
    for r in out:
        f = fingerprint(r.text)
        assert r.component_id == (of[points[f]] if f in points else None)


def test_tree_finds_all_links():
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(3000)]
    for _ in range(1500):
        f = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 4)):
            f ^= 1 << b
        fps.append(f)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    want = components(dict(enumerate(fps.tolist()))) if len(fps) < 200 else None
    tree = simhash.VantageTree(fps[::10], 16)
    assert tree.leaves > 4
    lives, pairs = np.zeros(len(fps), dtype=int), set()
    by_leaf = {}
    for leaf, rows, home in tree.route(fps, 3):
        by_leaf.setdefault(leaf, {True: [], False: []})[home] += rows.tolist()
        lives[rows] += home
    assert (lives == 1).all()
    forest = simhash.Forest(len(fps))
    for parts in by_leaf.values():
        ids = np.array(parts[True] + parts[False], dtype=np.int64)
        root, near = simhash.local_links(fps[parts[True]], fps[parts[False]], 3)
        forest.link(ids, ids[root])
        assert all(bin(int(fps[a] ^ fps[b])).count("1") <= 3 for a, b in zip(ids, ids[near]))
    close = simhash.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        close.link(np.full(len(j), i), j)
    assert (forest.parent == close.parent).all()
    assert want is None and not pairs


def test_near_duplicates_dropped(docs):
    kept = simhash.drop_near_duplicates(docs).collect()
    rows = docs.collect()
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in rows)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    shingles = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            w = words(r.text)
            shingles[r.doc_id] = {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    def alike(a, b):
        return len(a & b) >= .8 * len(a | b)
    stay = [i for i in ids if i != 7]
    assert not [(a, b) for a in stay for b in stay if a < b and alike(shingles[a], shingles[b])]
    for i in set(shingles) - set(stay):
        assert any(j != i and alike(shingles[i], shingles[j]) for j in shingles)


def test_empty_and_clashing(empty, clashing):
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    out = simhash.simhash_components(clashing)
    assert out.count() == 12 and out.where("fp = 'old FP' and row = 'old row'").count() == 12
    assert simhash.drop_near_duplicates(clashing).columns == clashing.columns


def grams(text, n=5):
    w = words(text)
    return {" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def groups_by_brute_force(texts, least=.8):
    """Smallest id of each group of chains of pairs with a similarity of ``least``."""
    sets, parent = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and (len(x & y) / len(x | y) if x or y else 1.0) >= least:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {find(i) for i in texts}


def test_signatures_find_all_pairs():
    import pyarrow as pa
    r = random.Random(8)
    found = 0
    for least in (.5, .8, .9, 1.0):
        for n in [*range(1, 40), 100, 300]:
            for _ in range(20):
                a = [f"a{r.random()}" for _ in range(n + 4)]
                b = list(a)
                cut, new = r.randint(0, max(1, n // 5)), r.randint(0, max(1, n // 5))
                b = b[:len(b) - cut] + [f"b{r.random()}" for _ in range(new)]
                x, y = grams(" ".join(a)), grams(" ".join(b))
                if len(x & y) / len(x | y) >= least:
                    sig, owner, size = simhash.signatures(pa.array([" ".join(a), " ".join(b)]), least, 5)
                    assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (least, n)
                    assert set(size[owner == 0].tolist()) == {len(x)}
                    found += 1
    assert found > 500


def test_cut_and_extended_copies_dropped(spark):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
    texts = {}
    for k in range(60):
        base = fresh(r.choice([6, 9, 12, 20, 150, 400]))
        n = len(base)
        texts[10 * k] = " ".join(base)
        texts[10 * k + 1] = " ".join(base[:n - int(.17 * n)])
        texts[10 * k + 2] = " ".join(fresh(int(.2 * n)) + base)
        texts[10 * k + 3] = " ".join(base[:n // 2] + fresh(int(.16 * n)) + base[n // 2:])
        texts[10 * k + 4] = " ".join(base[:n - int(.3 * n)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted(groups_by_brute_force(texts))


def test_pairs_behind_a_stand_in_dropped(spark):
    r = random.Random(12)
    lines = [" ".join(f"w{r.randrange(10 ** 9)}" for _ in range(6)) for _ in range(40)]
    texts = {}
    for k in range(12):
        r.shuffle(lines)        # the same distinct words in another order: all fingerprints over words are equal
        own = [w for line in lines for w in line.split()]
        r.shuffle(own)
        texts[k] = " ".join(own)
        texts[20 + k] = " ".join(own[:120] + own[121:122] + own[120:121] + own[122:])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted(groups_by_brute_force(texts)) == list(range(12))


def test_bitmaps_never_rule_out_similar_texts():
    import pyarrow as pa
    r = random.Random(4)
    for least in (.3, .8, .95):
        texts = []
        for k in range(30):
            words = [f"w{r.randrange(10 ** 6)}" for _ in range(r.choice([3, 8, 30, 70, 130, 400]))]
            cut = r.randrange(0, max(1, len(words) // 6))
            texts += [" ".join(words), " ".join(words[cut:]), " ".join(words + [f"n{i}" for i in range(cut)]), " ".join(words[:-cut or None])]
        sets, n = [grams(t) for t in texts], len(texts)
        table = pa.table({"leader": np.zeros(n, dtype=np.int64), "node": np.arange(n), "size": np.array([len(g) for g in sets], dtype=np.int32),
                          "component": np.arange(n), "own": np.zeros(n, dtype=np.int32), "part": np.zeros(n, dtype=np.int32),
                          "other": np.zeros(n, dtype=np.int32), "bits": pa.array(simhash.bitmaps(pa.array(texts), 5)[0], type=pa.binary()),
                          "leaders": pa.array([[0]] * n, type=pa.list_(pa.int64()))})
        found = set(zip(*(c.to_pylist() for c in simhash.possible_pairs(table, least).columns)))
        near = {(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        assert near <= found and len(found) < len(near) + n * n // 10


def test_pairs_grow_with_the_texts_not_with_their_square(spark, monkeypatch):
    """One large group of near copies, and one passage that many unlike texts share, at two sizes."""
    counted = []
    whole = simhash._similar_pairs
    monkeypatch.setattr(simhash, "_similar_pairs", lambda texts, proposed, *rest: (counted.append(proposed.count()), whole(texts, proposed, *rest))[1])
    monkeypatch.setattr(simhash, "LONG_LIST", 40)
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
    base, passage, sizes = fresh(200), fresh(40), []
    for n in (60, 180):
        texts = {}
        for k in range(n):
            at = r.randrange(150)
            texts[k] = " ".join(base[:at] + fresh(3) + base[at + 3:])
            texts[1000 + k] = " ".join(fresh(60) + passage + fresh(30))
        counted.clear()
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        kept = sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect())
        assert kept == sorted(groups_by_brute_force(texts)) and kept[0] == 0 and len(kept) == n + 1
        sizes.append(sum(counted))
    assert sizes[1] < 5 * sizes[0] + 50


def test_bitmaps_of_two_widths():
    """A pair whose texts have bitmaps of different widths, either way round, and no rows at all."""
    import pyarrow as pa
    r = random.Random(1)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(33)]
    texts = [" ".join(base), " ".join(base + [f"n{k}" for k in range(7)])]
    for pair in (texts, texts[::-1]):
        bits, zeros = simhash.bitmaps(pa.array(pair), 5)[0], np.zeros(2, dtype=np.int32)
        table = pa.table({"leader": zeros.astype(np.int64), "node": np.arange(2), "size": np.array([len(grams(t)) for t in pair], dtype=np.int32),
                          "component": np.arange(2), "own": zeros, "part": zeros, "other": zeros, "bits": pa.array(bits, type=pa.binary()),
                          "leaders": pa.array([[0], None], type=pa.list_(pa.int64()))})
        assert len({len(b) for b in bits}) == 2 and simhash.possible_pairs(table, .8).to_pylist() == [{"a": 1, "b": 0}]
        assert simhash.possible_pairs(table.slice(0, 0), .8).num_rows == 0


def test_a_pair_is_named_in_one_list():
    """Texts that meet in several lists are named in the first; texts with too many leaders to carry in each, and no row is lost."""
    import pyarrow as pa
    text = " ".join(f"w{k}" for k in range(40))
    for leaders, wanted in (([[3, 5], [1, 3, 5]], {3: 1, 5: 0}), ([None, [1, 3, 5]], {3: 1, 5: 1})):
        bits, sizes = simhash.bitmaps(pa.array([text, text + " x"]), 5)
        zeros = np.zeros(2, dtype=np.int32)
        for leader, n in wanted.items():
            table = pa.table({"leader": np.full(2, leader), "node": np.arange(2), "size": sizes.astype(np.int32), "component": np.arange(2),
                              "own": zeros, "part": zeros, "other": zeros, "bits": pa.array(bits, type=pa.binary()),
                              "leaders": pa.array(leaders, type=pa.list_(pa.int64()))})
            assert simhash.possible_pairs(table, .8).num_rows == n


def test_only_shared_signatures_are_written(spark, monkeypatch):
    """Signatures that one text has are ruled out where their packets meet, and never written down."""
    plain, written = simhash.materialize, []

    def counted(df, label):
        found = plain(df, label)
        written.append((label, found.count()))
        return found

    monkeypatch.setattr(simhash, "materialize", counted)
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(300)) for _ in range(60)]
    texts.append(" ".join(texts[0].split()[:270]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == list(range(60))
    assert "shared" in dict(written) and max(n for _, n in written) < 1000
