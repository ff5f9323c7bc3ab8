"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features and adds a shallow tree over one of them each time, then over chosen pairs. A sum of trees
over one feature (or pair) is a lookup table over its bins, so a text is scored by adding a few table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import Words, bytes_of, pieces, row_column, with_new_columns

FEATURES = [
    "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "bars", "exclamations", "stops", "commas",
    "other_marks", "beyond_ascii", "controls", "white", "lines", "distinct_words", "commonest_word", "same_as_before",
    "distinct_pairs", "short_words", "ends_in_mark", "no_letter", "all_upper", "repeated_lines",
]
#: Labelled rows that the model is fitted on, at most; the choice goes by a hash of the id.
MAX_TRAINING_ROWS = 20_000
_CLASSES = 16


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, dtype=np.uint8)                  # control characters
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n",
                               ".", ",", "!", "|", "#$%&*@^~<>=+_{}[]\\/", "?;:'\"()-`"]):
        out[[ord(c) for c in chars]] = k
    out[0xC0:] = 11                                         # first bytes of characters beyond ASCII
    out[0x80:0xC0] = 12                                     # their other bytes
    return out


_CLASS = _byte_classes()


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and how often the commonest occurs."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (values[1:] != values[:-1])])) if len(owner) else owner
    runs = np.diff(np.concatenate([new, [len(owner)]]))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owner[new], runs)
    return np.bincount(owner[new], minlength=n), most


def text_features(array: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, from its characters, words and lines only; zeros for a null or empty text."""
    raw, offsets = bytes_of(array)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[raw]
    count = np.bincount(owner * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    chars = np.maximum(count.sum(axis=1) - count[:, 12], 1)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    words = Words(array)
    n_words = words.counts()
    some = np.maximum(n_words, 1)
    hashes = words.hashes()
    lengths = words.to - words.at
    word_owner = np.repeat(np.arange(n), n_words)
    distinct, most = _distinct(word_owner, hashes, n)
    inner = np.ones(len(hashes), dtype=bool)
    inner[words.first[:-1][n_words > 0]] = False
    follows = np.flatnonzero(inner)
    same = np.bincount(word_owner[follows][hashes[follows] == hashes[follows - 1]], minlength=n)
    pairs, _ = _distinct(word_owner[follows], hashes[follows] * np.uint64(3) + hashes[follows - 1], n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, word_owner, lengths)
    kind = _CLASS[words.text]
    letter = np.concatenate([[0], np.cumsum((kind <= 1) | (kind == 11))])
    lower = np.concatenate([[0], np.cumsum((kind == 0) | (kind == 11))])
    has_letter = letter[words.to] > letter[words.at]
    # The lines of all texts, as words between line breaks.
    breaks = np.zeros(256, dtype=bool)
    breaks[0x0A] = True
    lines = Words(array, white=breaks)
    n_lines = lines.counts()
    distinct_lines, _ = _distinct(np.repeat(np.arange(n), n_lines), lines.hashes(), n)
    ends = kind[words.to - 1] if len(words.to) else kind[:0]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner[mask], minlength=n) / some

    return np.column_stack([
        np.log1p(n_words), _per_text(lengths, words.first) / some, np.log1p(longest), count[:, 1] / letters,
        count[:, 2] / chars, count[:, 9] / chars, count[:, 8] / chars, count[:, 7] / chars, count[:, 5] / some,
        count[:, 6] / some, count[:, 10] / chars, count[:, 11] / chars, count[:, 15] / chars,
        (count[:, 3] + count[:, 4]) / chars, n_lines / some, distinct / some, most / some, same / some,
        pairs / np.maximum(n_words - 1, 1), share(lengths <= 3), share((ends >= 5) & (ends <= 10)), share(~has_letter),
        share(has_letter & (lower[words.to] == lower[words.at])), (n_lines - distinct_lines) / np.maximum(n_lines, 1),
    ]).astype(np.float64)


@dataclass
class AdditiveModel:
    """``score = 1 / (1 + exp(-(base + sum of table entries)))``."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), values in zip(self.pairs, self.pair_tables):
            total += values[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    values = np.unique(x)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    cuts = np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return middles[np.unique(np.clip(cuts, 0, len(middles) - 1))]


def _shallow_tree(g: np.ndarray, h: np.ndarray, splits: int, ridge: float, least: float) -> np.ndarray:
    """A step for each bin: a tree of at most ``splits`` cuts over the bins, grown at the best gain."""
    step, leaves = np.zeros(len(g)), [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(lo: int, hi: int) -> tuple[float, int]:
        cut = np.arange(lo + 1, hi)
        gl, hl, gr, hr = cg[cut] - cg[lo], ch[cut] - ch[lo], cg[hi] - cg[cut], ch[hi] - ch[cut]
        gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
        gain = np.where((hl >= least) & (hr >= least), gain, 0)
        return (float(gain.max()), int(cut[gain.argmax()])) if len(cut) else (0.0, lo)

    for _ in range(splits):
        found = [(*best(lo, hi), k) for k, (lo, hi) in enumerate(leaves)]
        gain, cut, k = max(found)
        if gain <= 1e-9:
            break
        lo, hi = leaves[k]
        leaves[k:k + 1] = [(lo, cut), (cut, hi)]
    for lo, hi in leaves:
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts a grid once along each axis: its gain and its step for each cell."""
    def corners(m: np.ndarray) -> list[np.ndarray]:
        c = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        c[1:, 1:] = m.cumsum(0).cumsum(1)
        a, row, col, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, row - a, col - a, all_ - row - col + a]

    gs, hs = corners(g), corners(h)
    step = np.zeros_like(g)
    if not gs[0].size:
        return 0.0, step
    gain = sum(a ** 2 / (b + ridge) for a, b in zip(gs, hs)) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where(np.minimum.reduce(hs) >= least, gain, 0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 1e-9:
        return 0.0, step
    value = [a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs)]
    step[:i + 1, :j + 1], step[:i + 1, j + 1:], step[i + 1:, :j + 1], step[i + 1:, j + 1:] = value
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 250, pair_rounds: int = 80,
        n_pairs: int = 10, rate: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting on the logistic loss. Without rows, or of one class, the score is the smoothed class share."""
    n = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel([_quantile_edges(x[:, j], bins) for j in range(n)], [], float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_quantile_edges(x[:, j], coarse_bins) for j in range(n)]
    if len(np.unique(y)) < 2:
        return model
    where = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n):
            size = len(model.tables[j])
            if size > 1:
                g, h = slopes()
                step = rate * _shallow_tree(np.bincount(where[j], g, size), np.bincount(where[j], h, size), 3, ridge, least)
                model.tables[j] += step
                total += step[where[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h), ridge, least)[0], a, b)
                     for a, b in combinations(range(n), 2) if min(shape[a], shape[b]) > 1), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h), ridge, least)[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          max_rows: int = MAX_TRAINING_ROWS, **options: float) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of the id. Their features come to the driver.

    Null ids and labels are left out. An id with several labels counts with the smallest, one with several texts once.
    """
    chosen = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))

    @F.arrow_udf("array<double>")
    def features(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            parts = [text_features(p["text"]) for p in pieces(iter([pa.record_batch({"text": array})]), "text")]
            yield pa.array([row for part in parts for row in part.tolist()], type=pa.list_(pa.float64()))

    # At most max_rows rows of two numbers are broadcast.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", features("body").alias("x")).groupBy(
        "id", "label").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], dtype=np.float64), **options)


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up); columns of these names are replaced.
    Null and empty texts are scored by their features, which are all 0."""
    @F.arrow_udf("double")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            parts = [model.score(text_features(p["text"])) for p in pieces(iter([pa.record_batch({"text": array})]), "text")]
            yield pa.array(np.concatenate(parts or [np.zeros(0)]))

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scored = docs.select(row_column(docs).alias("row"), score(body).alias("score"))
    return scored.select(*with_new_columns(
        docs.columns, "row", score=F.col("score"), predicted=F.when(F.col("score") >= threshold, 1).otherwise(0)))
