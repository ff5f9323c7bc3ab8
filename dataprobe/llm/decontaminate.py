"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import Words, mix64, pieces, row_column, with_new_columns

#: Bytes of item texts that go to the executors at a time; more items are searched block by block.
BLOCK_BYTES = 16 << 20
#: Sketch values of an item beyond those that may all be missing; as many must be found.
SPARE = 3
#: Words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z.
OTHER = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def shingle_hashes(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash per shingle of each text (fewer words: the whole sequence), and where each text's begin."""
    counts = words.counts()
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], n)
    length = np.repeat(np.minimum(counts, shingle), n)
    hashes = words.hashes()
    out = np.zeros(first[-1], dtype=np.uint64)
    for k in range(shingle):
        inside = length > k
        out[inside] = mix64(out[inside] * np.uint64(0x100000001B3) + hashes[begin[inside] + k])
    return out, first


def exact_shingles(words: Words, d: int, shingle: int) -> set[bytes]:
    """The distinct shingles of text ``d``, as words joined by a space."""
    a, b = int(words.first[d]), int(words.first[d + 1])
    if a == b:
        return set()
    text = words.text
    return {text[words.at[i]:words.to[min(i + shingle, b) - 1]].tobytes() for i in range(a, max(b - shingle, a) + 1)}


class ItemIndex:
    """MinHash sketches of short items, in partitions of items whose sizes (numbers of distinct shingles) have the same
    power of two.

    An item of size n is contained in a text if at least ceil(threshold * n) of its shingles occur there. Its sketch has the
    m smallest hashes, m being what may be missing at the largest size of the partition plus ``SPARE`` (at most n), so at
    least m minus the missing ones must be found: no contained item is overlooked.
    """

    def __init__(self, texts: list[str], shingle: int, threshold: float):
        self.shingle = shingle
        words = Words(pa.array(texts, type=pa.string()), lower=True, white=OTHER)
        hashes, first = shingle_hashes(words, shingle)
        self.shingles = [exact_shingles(words, i, shingle) for i in range(len(texts))]
        self.size = np.array([len(s) for s in self.shingles], dtype=np.int64)
        self.need = np.array([math.ceil(threshold * n - 1e-9) for n in self.size], dtype=np.int64)
        values, owners = [], []
        self.least = np.zeros(len(texts), dtype=np.int64)
        for power in sorted({int(n).bit_length() for n in self.size if n}):
            members = [i for i, n in enumerate(self.size) if int(n).bit_length() == power]
            missing = max(int(self.size[i] - self.need[i]) for i in members)
            for i in members:
                sketch = np.unique(hashes[first[i]:first[i + 1]])[:missing + SPARE]
                self.least[i] = max(1, len(sketch) - (self.size[i] - self.need[i]))
                values.append(sketch)
                owners.append(np.full(len(sketch), i))
        self.values = np.concatenate(values or [np.zeros(0, dtype=np.uint64)])
        order = np.argsort(self.values, kind="stable")
        self.values = self.values[order]
        self.owners = np.concatenate(owners or [np.zeros(0, dtype=np.int64)])[order]
        #: Low bits of all values, to turn away most shingles at once.
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(self.values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """``(text, item, shared shingles)`` for all contained items."""
        words = Words(texts, lower=True, white=OTHER)
        hashes, first = shingle_hashes(words, self.shingle)
        likely = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found = likely[np.isin(hashes[likely], self.values)]
        which = np.searchsorted(first, found, side="right") - 1
        for d in np.unique(which):
            values = np.unique(hashes[found[which == d]])
            lo, hi = (np.searchsorted(self.values, values, side=s) for s in ("left", "right"))
            hits = Counter(int(self.owners[k]) for a, b in zip(lo, hi) for k in range(a, b))
            items = [i for i, n in hits.items() if n >= self.least[i]]
            if items:
                own = exact_shingles(words, int(d), self.shingle)
                for i in sorted(items):
                    shared = len(own & self.shingles[i])
                    if shared >= self.need[i]:
                        yield int(d), i, shared


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """Distinct items, smallest first, in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    listed = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), body.alias("text")).distinct()
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        block = listed.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k)
        yield sorted(((r["id"], r["text"]) for r in block.collect()), key=lambda r: (len(r[1]), r[1], r[0] or 0))


def _searches(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float, shingle: int,
              block_bytes: int) -> Iterator[Column]:
    """Per block of items a column of what a text contains, given column ``body``."""
    for block in _blocks(items, item_id, item_text, block_bytes):
        yield _search(docs.sparkSession.sparkContext.broadcast(block), threshold, shingle)(F.col("body"))


def _search(sent: Broadcast, threshold: float, shingle: int) -> Callable:
    @F.arrow_udf("array<struct<item_id:long,n_item:long,n_shared:long>>")
    def search(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = [r[0] for r in sent.value]
        index = ItemIndex([r[1] for r in sent.value], shingle, threshold)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))
        for array in arrays:
            rows: list[list] = []
            for piece in pieces(iter([pa.record_batch({"text": array})]), "text"):
                part: list[list] = [[] for _ in range(piece.num_rows)]
                for d, i, shared in index.search(piece["text"]):
                    part[d].append({"item_id": ids[i], "n_item": int(index.size[i]), "n_shared": shared})
                rows += part
            yield pa.array(rows, type=kind)

    return search


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
               item_text: str = "text", threshold: float = 0.8, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` for each document and item of which at least ``threshold``
    of the distinct ``shingle``-word shingles occur in the document.

    Words are runs of letters and digits without regard to A-Z case. An item or document with fewer words has one
    shingle, its whole sequence; one without words (null, empty) contains nothing and is contained nowhere. Equal items
    with one id count once; rows of ``docs`` count each, whatever their ids (null included).
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    parts = [rows.select("doc_id", F.explode(found).alias("f"))
             for found in _searches(docs, items, item_id, item_text, threshold, shingle, block_bytes)]
    if not parts:
        none = "array<struct<item_id:long,n_item:long,n_shared:long>>"
        parts = [rows.where("false").select("doc_id", F.explode(F.array().cast(none)).alias("f"))]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "f.*").withColumn(
        "containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               threshold: float = 0.8, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with their columns, that contain no item (see ``find_leaks``)."""
    rows = docs.select(row_column(docs).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    for found in _searches(docs, items, item_id, item_text, threshold, shingle, block_bytes):
        rows = rows.select("row", "body", found.alias("found")).where(F.size("found") == 0).drop("found")
    return rows.select(*with_new_columns(docs.columns, "row"))
