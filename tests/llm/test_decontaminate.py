import re

import pytest

from dataprobe.llm.decontaminate import drop_leaks, find_leaks

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=5):
    w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").translate(LOWER))
    return {" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = [r.text for r in docs.collect() if r.text]
    some = [t.split()[5:30] for t in texts if len(t.split()) > 40]
    rows = [(i, " ".join(w)) for i, w in enumerate(some[:12])]
    for i, w in enumerate(some[:12]):       # changed in places, so that some are above and some below the bound
        w = list(w)
        for k in range(0, len(w), 3 + 2 * i):
            w[k] = "other"
        rows.append((20 + i, ", ".join(w).upper()))
    rows += [(50, None), (51, ""), (52, "!!"), (53, "word"), (54, "word word word word word"), (None, rows[0][1]), rows[0], rows[0],
             (0, rows[1][1]), (55, "is"), (56, "other text for id 7")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("threshold, block", [(0.8, 1 << 20), (0.5, 1 << 20), (1.0, 1 << 20), (0.8, 600)])
def test_against_brute_force(docs, items, threshold, block, rows):
    listed = {(r.item_id, r.text or "") for r in items.collect()}
    want = []
    for r in docs.collect():
        own = shingles(r.text)
        for i, t in listed:
            s = shingles(t)
            if s and len(own & s) >= threshold * len(s) - 1e-9:
                want.append((r.doc_id, i, len(s), len(own & s), len(own & s) / len(s)))
    assert rows(find_leaks(docs, items, threshold=threshold, block_bytes=block)) == sorted(want, key=repr)
    assert want
    if threshold == 0.8:
        bad = {(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect())
               if any(shingles(x) and len(shingles(t) & shingles(x)) >= .8 * len(shingles(x)) for _, x in listed)}
        kept = rows(drop_leaks(docs, items, block_bytes=block))
        assert kept == sorted((tuple(r) for r in docs.collect() if (r.doc_id, r.text) not in bad), key=repr)


def test_empty_and_clashing(docs, empty, clashing, items):
    assert find_leaks(empty, items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert drop_leaks(clashing, items.limit(0)).columns == clashing.columns
    assert set(find_leaks(clashing, items).columns) == {"doc_id", "item_id", "n_item", "n_shared", "containment"}
