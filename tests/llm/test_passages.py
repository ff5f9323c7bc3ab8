import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dataprobe.llm.fmindex import BitVector, FMIndex, WaveletMatrix
from dataprobe.llm.passages import remove_repeated_passages


def brute(rows, width):
    first, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k:k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [13, 5, 2])
def test_against_brute_force(docs, rows, width):
    found = rows(remove_repeated_passages(docs, width=width).select("doc_id", "n_words", "n_removed", "kept"))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_common_sequences_dealt_by_windows(docs, rows, monkeypatch):
    from dataprobe.llm import passages

    monkeypatch.setattr(passages, "COMMON_SHARE", -1.0)
    monkeypatch.setattr(passages, "SAMPLE_DOCS", 10_000)
    found = rows(remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept"))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_empty_and_clashing(empty, clashing):
    assert remove_repeated_passages(empty).count() == 0
    out = remove_repeated_passages(clashing)
    assert out.count() == 12 and len(out.columns) == len(set(out.columns)) == len(clashing.columns)
    assert dict(out.dtypes)["n_words"] == "bigint" and out.where("row = 'old row'").count() == 12


def test_query_hashes_what_is_kept(spark, docs, tmp_path):
    from dataprobe.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest())
            for i, n, g, k in brute([(r.doc_id, r.text) for r in docs.collect()], 13)}
    assert {tuple(r) for r in QUERIES["op1_passage_dedup"](spark, str(tmp_path)).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=300))
def test_ranks(symbols):
    s = np.array(symbols)
    tree = WaveletMatrix(s, 13)
    for c in (0, 5, 12):
        at = np.arange(len(s) + 1)
        assert tree.rank(np.full(len(at), c), at).tolist() == [int((s[:k] == c).sum()) for k in at]
    assert BitVector(s & 1).ones(np.arange(len(s) + 1)).tolist() == [int((s[:k] & 1).sum()) for k in range(len(s) + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=12))
def test_matching_statistics(sequences):
    index = FMIndex(np.concatenate([np.array(s) for s in sequences]), np.array([len(s) for s in sequences]))
    places = [(k, i) for k, s in enumerate(sequences) for i in range(len(s))]
    ends = np.array([index.first[k] + i for k, i in places])
    limit = 4
    ends_ok = np.array([i >= limit - 1 for _, i in places])
    if not ends_ok.any():
        return
    length, low, high = index.matching_statistics(ends[ends_ok], limit)
    kept = [p for p, ok in zip(places, ends_ok) if ok]
    for (k, i), n, lo, hi in zip(kept, length, low, high):
        def count(m):
            g = sequences[k][i - m + 1:i + 1]
            return sum(s[j:j + m] == g for s in sequences for j in range(len(s) - m + 1))
        assert n == max([m for m in range(limit + 1) if m == 0 or count(m) > 1])
        assert n == 0 or hi - lo == count(n)
