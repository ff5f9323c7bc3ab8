import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe.llm import ppm

END = 256
NEW = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


def grams_of(text, order):
    symbols = [*" ".join(words_of(text)).encode(), END]
    padded = [0x20] * order + symbols
    return [(tuple(padded[i:i + order]), padded[i + order]) for i in range(len(symbols))]


class Trie:
    """The same model, symbol by symbol over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.known = order, {}
        self.counts = {order: defaultdict(Counter)}
        for text in texts:
            for context, symbol in grams_of(text, order):
                self.counts[order][context][symbol] += 1
        for length in range(order - 1, -1, -1):
            self.counts[length] = defaultdict(Counter)
            for context, found in self.counts[length + 1].items():
                for symbol in found:
                    self.counts[length][context[1:]][symbol] += 1

    def distribution(self, context):
        """Probability of every symbol in a context."""
        out, left, excluded = {}, 1.0, set()
        for length in range(self.order, -1, -1):
            found = self.counts[length].get(context[self.order - length:])
            if not found:
                continue
            seen = {s: c for s, c in found.items() if s not in excluded}
            total = 2 * sum(seen.values())
            for symbol, count in seen.items():
                out[symbol] = left * (2 * count - 1) / total
            left *= len(seen) / total if seen else 1
            excluded = set(found)
        rest = [s for s in range(257) if s not in excluded]
        return out | {s: left / len(rest) for s in rest}

    def score(self, text):
        for context, _ in grams_of(text, self.order):
            if context not in self.known:
                self.known[context] = self.distribution(context)
        return sum(math.log10(self.known[context][symbol]) for context, symbol in grams_of(text, self.order))


def check(found, rows, train, order):
    """``rows`` by id and text; ids and texts may repeat."""
    learned = [text for i, text in rows if train(i)]
    counts = Counter(t for text in learned for t in [*words_of(text), None])
    total, distinct = sum(counts.values()), len(counts)
    trie, cache = Trie(learned, order), {}
    wanted = []
    for i, text in rows:
        tokens = [*words_of(text), None]
        if text not in cache:
            cache[text] = trie.score(text)
        wanted.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), total,
                       sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens), cache[text]))
    mine = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    assert len(mine) == len(wanted)
    key = (lambda r: (repr(r[0]), r[1], round(r[5], 3)))
    for a, b in zip(sorted(mine, key=key), sorted(wanted, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5, abs=1e-5)


def trains(i):
    return i is not None and i % 7 != 2


@pytest.mark.parametrize("order", [1, 3, 5])
def test_against_a_trie_of_dictionaries(docs, order):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = ppm.score_texts(docs, F.col("doc_id") % 7 != 2, order=order)
    assert found.columns == [c for c in docs.columns if c != "text"] + NEW
    check(found.collect(), rows, trains, order)


def test_many_blocks_and_buckets(docs, monkeypatch, conf):
    """Texts that come in many blocks have the same scores."""
    conf("spark.sql.shuffle.partitions", "7")
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 4000)
    whole = {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in ppm.score_texts(docs, F.col("doc_id") % 7 != 2).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = ppm.score_texts(docs.repartition(13), F.col("doc_id") % 7 != 2).collect()
    check(found, rows, trains, ppm.ORDER)
    assert {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in found} == whole


def test_blocks_are_closed_at_their_size(monkeypatch):
    block = ppm._Block(3)
    import numpy as np
    import pyarrow as pa
    for k in range(40):      # more pieces than are kept apart
        block.add(pa.array([f"word{k % 3} and more"]), np.array([k % 2 == 0]))
    grams = [(np.cumsum(ppm._unpack(keys)), ppm._unpack(counts)) for kind, _, keys, counts in block.requests(2) if kind == ppm.GRAM]
    wanted = Counter()
    for k in range(0, 40, 2):
        wanted.update(grams_of(f"word{k % 3} and more", 3))
    assert sum(c.sum() for _, c in grams) == sum(wanted.values())
    assert sum(len(g) for g, _ in grams) == len(set(wanted)) and all((np.diff(g) > 0).all() for g, _ in grams)


def test_probabilities_add_up_to_one():
    trie = Trie(["the cat sat on the mat", "a cat", ""], 3)
    for context in [(116, 104, 101), (32, 32, 32), (1, 2, 3), (99, 97, 116)]:
        assert sum(trie.distribution(context).values()) == pytest.approx(1)


def test_nothing_to_learn_from(docs, spark, empty):
    assert ppm.score_texts(empty, F.lit(True)).collect() == []
    for r in ppm.score_texts(docs, F.lit(None).cast("boolean")).select("doc_id", *NEW).collect():
        assert r.train_tokens == r.n_known == 0 and r.base_score == 0
        assert r.score <= -math.log10(257) + 1e-6
    one = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in ppm.score_texts(one, F.lit(False)).collect()}
    assert scores[1] == scores[2] == pytest.approx(-math.log10(257)) and scores[3] == pytest.approx(-3 * math.log10(257))


def test_clashing_names(clashing):
    named = clashing.select("*", *[F.lit("old").alias(c) for c in ("train", "block", "kind", "Base_Score", "bucket", "keys", "counts")])
    found = ppm.score_texts(named, F.col("doc_id") % 7 != 2)
    assert "Base_Score" not in found.columns and {"train", "block", "kind", "row"} <= set(found.columns)
    check(found.collect(), [(r.doc_id, r.text) for r in named.collect()], trains, ppm.ORDER)


def test_whole_table_and_held_out_texts(spark):
    """The query's scores are those of the dictionaries, and beat single words on texts that it has not seen."""
    from dataprobe.llm.queries import QUERIES
    found = QUERIES["op11_lm_scores"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    held = {r.doc_id for r in found if r.held_out}
    from zlib import crc32
    assert held == {i for i, _ in rows if crc32(str(i).encode()) % 7 == 2}
    check(found, rows, lambda i: i not in held, ppm.ORDER)


def test_each_different_gram_is_searched_once(monkeypatch):
    rng = np.random.default_rng(4)
    gram = np.unique(rng.integers(0, 1 << 49, 300, dtype=np.uint64))
    value, at = rng.random(len(gram)), rng.integers(0, len(gram), 5000)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(ppm.np, "searchsorted", lambda a, v, *rest, **more: (searched.append(len(v)), search(a, v, *rest, **more))[1])
    assert (ppm._looked_up(gram, value, gram[at]) == value[at]).all()
    assert searched == [len(np.unique(at))]
