"""SimHash near-duplicates, linked exactly by a vantage-point tree over Hamming distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import (Words, interim, map_arrow, materialize, mix64, narrow, pack, packet_columns, packets, pieces, row_column,
                                  small_batches, unpack, with_new_columns)
from dataprobe.llm.decontaminate import shingle_hashes
from dataprobe.llm.graph import Forest, connected_components
from dataprobe.operators.joins import broadcast_if_small, lookup_join

RADIUS, SEED = 3, 42
#: Fingerprints from which the shared part of the tree is built; a leaf of it holds at least 16 of them.
SAMPLE, SAMPLE_PER_LEAF = 1 << 14, 16
#: Fingerprints per leaf that are wanted of the shared tree, and compared directly within a task.
LEAF_ROWS, BLOCK = 20_000, 512
#: Pairs of whole texts that are compared at once.
PAIRS_PER_BATCH = 200
#: Most shingles in a signature.
LONGEST_RUN = 3
#: Texts of a signature that are compared at once, and rows that a task compares.
LONG_LIST, BUCKET_ROWS = 2048, 1 << 15
#: Bytes of text whose signatures travel together, bits of a signature, and bytes of text to a bucket of them.
SIGNED_BYTES, SIGNATURE_BITS, SIGNED_PER_BUCKET = 4 << 20, 48, 32 << 20
#: Leaders that a text carries along at most.
MOST_LEADERS = 64
#: Pairs that are looked at in one step of a task.
PAIRS_AT_ONCE = 1 << 20


def fingerprints(array: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: words ``[^\\x20\\x09-\\x0D]+`` after A-Z were lower-cased, shingles joined by a space
    (repeats count; fewer words: the whole sequence), XXH64 with seed 42. A bit is set if it is set in
    over half the hashes. A text without words has fingerprint 0."""
    words = Words(array, lower=True)
    counts = words.counts()
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], n)
    last = begin + np.repeat(np.minimum(counts, shingle) - 1, n)
    text, digest = memoryview(words.text), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(words.at[begin].tolist(), words.to[last].tolist())),
                         dtype=np.uint64, count=int(offsets[-1]))
    return _majority(hashes, offsets)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text (whose hashes begin at ``first``) the bits that are set in over half its hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    for at in range(0, len(some), 256):
        part = some[at:at + 256]
        lo, hi = first[part[0]], first[part[-1] + 1]
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[part] - lo, axis=0, dtype=np.int64)
        out[part] = np.packbits(2 * ones > n[part][:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``fp``, the fingerprint as a signed number. Null texts count as empty."""
    @F.arrow_udf("long")
    def fingerprint(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            found = [fingerprints(piece["text"], shingle)
                     for piece in pieces(iter([pa.record_batch({"text": array})]), "text")]
            yield pa.array(np.concatenate(found or [np.zeros(0, dtype=np.uint64)]).view(np.int64))

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(row_column(docs).alias("row"), body.alias("body")).select("row", fingerprint("body").alias("fp"))


def word_fingerprints(array: pa.Array, kinds: int) -> np.ndarray:
    """``kinds`` SimHashes of each text over its distinct words, each with hashes of its own; 0 for a text without words.
    (With repeats, the commonest words of a language would make all its texts alike.)"""
    words = Words(array, lower=True)
    owner, hashes = np.repeat(np.arange(len(words.first) - 1), words.counts()), words.hashes()
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    first = np.searchsorted(owner, np.arange(len(words.first)))
    return np.column_stack([_majority(mix64(hashes + np.uint64(k)), first) for k in range(kinds)])


def distances(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int64)


class VantageTree:
    """Inner nodes hold a vantage point and a distance ``mu``; leaves are numbered.

    A fingerprint lives in one leaf: at a node it goes in at a distance up to ``mu``, else out. It also visits leaves that
    may hold its partners. For partners that part at a node, the outer one is within ``mu + radius`` by the triangle
    bound, so it is enough that the outer one visits the inner side; visitors go wherever the bounds let them.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._build(sample, max(1, leaves))

    def _build(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = None if leaves < 2 or len(points) < 2 else choose_split(points)
        if split is None:
            self.nodes[at] = (None, self.leaves, None, None)
            self.leaves += 1
        else:
            point, mu = split
            near = distances(points, point) <= mu
            self.nodes[at] = (point, mu, self._build(points[near], leaves // 2), self._build(points[~near], leaves - leaves // 2))
        return at

    def route(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """``(leaf, indexes, home)`` for all leaves that the fingerprints live in or visit."""
        stack = [(0, np.arange(len(fps)), np.zeros(0, dtype=np.int64))]
        while stack:
            at, home, guests = stack.pop()
            point, mu, inner, outer = self.nodes[at]
            if point is None:
                for rows, lives in ((home, True), (guests, False)):
                    if len(rows):
                        yield mu, rows, lives
                continue
            h, g = distances(fps[home], point), distances(fps[guests], point)
            stack.append((inner, home[h <= mu], np.concatenate([guests[g <= mu + radius], home[(h > mu) & (h <= mu + radius)]])))
            stack.append((outer, home[h > mu], guests[g > mu - radius]))


def choose_split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few, with the fewest points in the ring of visitors beyond a middle distance."""
    best = None
    for point in points[:: max(1, len(points) // 5)][:5]:
        d = distances(points, point)
        counts = np.cumsum(np.bincount(d, minlength=65 + RADIUS))
        middle = int(np.searchsorted(counts, len(points) / 2))
        for mu in range(max(0, middle - 2), middle + 2):
            inside = counts[mu]
            if not len(points) // 5 <= inside <= len(points) - len(points) // 5 or inside == len(points) or not inside:
                continue
            ring = counts[min(mu + RADIUS, len(counts) - 1)] - inside
            # Two halves of the work, and what the ring adds to the inner one.
            cost = inside * (inside + ring) + (len(points) - inside) ** 2
            if best is None or cost < best[0]:
                best = cost, point, mu
    return None if best is None else best[1:]


def local_links(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints ``home + guests``: each one's root in the forest of the links that home takes part in, and
    the nearest one before it that it is linked with (itself if there is none)."""
    fps = np.concatenate([home, guests])
    forest = Forest(len(fps))
    nearest = np.arange(len(fps)) + (np.int64(64) << 40)
    stack = [(np.arange(len(home)), np.arange(len(home), len(fps)))]
    while stack:
        h, g = stack.pop()
        split = choose_split(fps[h]) if len(h) > BLOCK else None
        if split is not None:
            point, mu = split
            dh, dg = distances(fps[h], point), distances(fps[g], point)
            inner = h[dh <= mu], np.concatenate([g[dg <= mu + radius], h[(dh > mu) & (dh <= mu + radius)]])
            outer = h[dh > mu], g[dg > mu - radius]
            if max(len(inner[0]) + len(inner[1]), len(outer[0]) + len(outer[1])) < 0.97 * (len(h) + len(g)):
                stack += [inner, outer]
                continue
        others = np.concatenate([h, g])
        for i in range(0, len(h), BLOCK):
            block = h[i:i + BLOCK]
            for j in range(i, len(others), 64 * BLOCK):
                part = others[j:j + 64 * BLOCK]
                differing = np.bitwise_count(fps[block][:, None] ^ fps[part][None, :])
                a, b = np.nonzero(differing <= radius)
                bits, a, b = differing[a, b].astype(np.int64), block[a], part[b]
                forest.link(a, b)
                np.minimum.at(nearest, np.maximum(a, b), np.where(a == b, np.int64(64), bits) << 40 | np.minimum(a, b))
    return forest.parent, nearest & ((1 << 40) - 1)


def fingerprint_links(unique: DataFrame, radius: int = RADIUS, nearest: bool = False) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``unique (kind, fp, node)`` that connect whatever chains of pairs of one kind
    with at most ``radius`` differing bits connect: in each leaf of the kind's tree one for each node but the
    first. ``nearest`` adds each node's link to the nearest one before it. Fingerprints of a kind must be distinct."""
    spark = unique.sparkSession
    total = dict(unique.groupBy("kind").count().collect())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees, leaves = {}, min(max(sum(total.values()) // LEAF_ROWS, 2 * tasks), SAMPLE // SAMPLE_PER_LEAF) // max(len(total), 1)
    for kind, count in total.items():
        sample = unique.where(F.col("kind") == kind).select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE // len(total))
        points = np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64)
        trees[kind] = VantageTree(points, leaves if count > BLOCK else 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, fps, nodes = (batch[c].to_numpy() for c in ("kind", "fp", "node"))
            for kind in np.unique(kinds).tolist():
                mine = np.flatnonzero(kinds == kind)
                for leaf, rows, home in trees[kind].route(fps[mine].view(np.uint64), radius):
                    yield pa.record_batch({"kind": np.full(len(rows), kind, dtype=np.int32),
                                           "leaf": np.full(len(rows), leaf, dtype=np.int32), "fp": fps[mine[rows]],
                                           "node": nodes[mine[rows]], "home": np.full(len(rows), home)})

    def compare(table: pa.Table) -> pa.Table:
        fps, nodes, home = (table[c].to_numpy() for c in ("fp", "node", "home"))
        order = np.lexsort((nodes, ~home))
        fps, nodes, lives = fps[order].view(np.uint64), nodes[order], int(home.sum())
        roots, near = local_links(fps[:lives], fps[lives:], radius)
        parts = [(np.flatnonzero(x != np.arange(len(x))), x) for x in ([roots, near] if nearest else [roots])]
        return pa.table({"a": np.concatenate([nodes[i] for i, _ in parts]), "b": np.concatenate([nodes[x[i]] for i, x in parts])})

    dealt = map_arrow(unique, route, "kind int, leaf int, fp long, node long, home boolean")
    return dealt.groupBy("kind", "leaf").applyInArrow(compare, "a long, b long")


def components_of(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``coded (doc_id, fp)``, which is written down once."""
    coded = materialize(coded.select(F.col("doc_id").cast("long").alias("doc_id"), "fp"), "fingerprints")
    return coded.join(component_names(coded, radius).hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def component_names(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, component)`` for each fingerprint of ``coded (doc_id, fp)``. Equal fingerprints become one row at once."""
    unique = materialize(coded.groupBy("fp").agg(F.min("doc_id").alias("node")), "unique")
    nodes = unique.where("node IS NOT NULL").select(F.lit(0).alias("kind"), "fp", "node")
    linked = connected_components(fingerprint_links(nodes, radius))
    return unique.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                       radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``: the smallest id that is reached from the
    document over pairs of fingerprints with at most ``radius`` differing bits, its own id included.

    Ids are whole numbers; rows that share an id are judged each by its own text. A row with a null id has the component
    of the others with its fingerprint (null if they have no id). Texts that are null or empty have fingerprint
    0 and are linked like any other. Columns of ``docs`` that have a new column's name are replaced.
    """
    coded = with_fingerprints(docs, text, shingle)
    names = component_names(coded.select(F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), "fp"), radius)
    return coded.join(names.hint("merge"), "fp").select(*with_new_columns(
        docs.columns, "row", fingerprint=F.lower(F.lpad(F.hex("fp"), 16, "0")), component_id=F.col("component")))


def shingle_similarity(a: pa.Array, b: pa.Array, shingle: int) -> list[float]:
    """Jaccard similarity of the distinct word shingles of two texts each; 1 for two texts without words."""
    sides = []
    for array in (a, b):
        words = Words(array, lower=True)
        text, last = words.text, np.minimum(np.arange(len(words.at)) + shingle, np.repeat(words.first[1:], words.counts())) - 1
        spans = list(zip(words.at.tolist(), words.to[last].tolist()))
        sides.append([{text[x:y].tobytes() for x, y in spans[lo:max(hi - shingle, lo) + 1]} if hi > lo else set()
                      for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist())])
    return [len(x & y) / len(x | y) if x or y else 1.0 for x, y in zip(*sides)]


def distinct_shingles(array: pa.Array, shingle: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(key, text, texts)``: the distinct shingles of each text as 64-bit keys in one order for all texts: by hash, but those whose
    hashes are in ``common`` (sorted) come last."""
    words = Words(array, lower=True)
    hashes, first = shingle_hashes(words, shingle)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = hashes >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        keys |= (common[at] == hashes).astype(np.uint64) << np.uint64(63)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], owner[new], len(first) - 1


def common_shingles(texts: DataFrame, shingle: int, texts_read: int = 1 << 12, holders: int = 4) -> np.ndarray:
    """Hashes of shingles that at least ``holders`` of about ``texts_read`` texts hold (of each at most 1,024 by hash): passages that
    many texts share. They only choose the order of the shingles; any order gives right results."""
    parts = max(1, texts.count() // texts_read)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body"):
            hashes, first = shingle_hashes(Words(piece["body"], lower=True), shingle)
            found = [np.unique(hashes[lo:hi])[:1024] for lo, hi in zip(first[:-1], first[1:])]
            yield pa.record_batch({"hash": np.concatenate(found or [hashes]).view(np.int64)})

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0).select("body")
    counted = map_arrow(sample, listed, "hash long").groupBy("hash").count().where(F.col("count") >= holders)
    return np.sort(np.array([r[0] for r in counted.select("hash").collect()], dtype=np.int64).view(np.uint64))


def signatures(array: pa.Array, similarity: float, shingle: int,
               common: np.ndarray = np.zeros(0, dtype=np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(signature, text, size)``: hashes of which any two of the texts with a shingle similarity of at least ``similarity``
    share one, and the text's number of distinct shingles.

    A signature is a run of ``r`` neighbours among a text's distinct shingles in their common order. Let a text have ``a``
    shingles, ``x`` of them not in its partner, which has ``y`` of its own: x + y <= (1 - s) / s * (a - x). Where the shorter one of
    the two's first p = r * (1 - s) * a + r shingles ends, they share at least p - x; were no r of these neighbours in both, they
    would be at most (r - 1) * (x + y + 1), so p <= r * x + (r - 1) * (y + 1), which is at most r * (1 - s) * a + r - 1 while
    r * (1 - s) <= 1. Texts with fewer than p shingles, and those that may be their partners, give single shingles
    (r = 1: the first (1 - s) * a + 1). Texts without words share signature 0.
    """
    hashes, owner, texts = distinct_shingles(array, shingle, common)
    size = np.bincount(owner, minlength=texts)
    place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    longest = max(r for r in range(1, LONGEST_RUN + 1) if r == 1 or r * (1 - similarity) <= 0.75)
    few = int(longest / (1 - longest * (1 - similarity)) / similarity) + 1 if longest > 1 else 0
    none = np.flatnonzero(size == 0)
    found, owners = [np.zeros(len(none), dtype=np.uint64)], [none]
    for run in sorted({1, longest}):
        use = (place <= np.floor(run * (1 - similarity) * size + 1e-6)[owner]) & (place + run <= size[owner])
        if run < longest:
            use &= size[owner] <= few
        at = np.flatnonzero(use)
        values = np.full(len(at), run, dtype=np.uint64)
        for k in range(run):
            values = mix64(values * np.uint64(0x100000001B3) + hashes[at + k])
        found.append(values)
        owners.append(owner[at])
    owner = np.concatenate(owners)
    return np.concatenate(found), owner, size[owner]


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, shingle: int = 5,
                         kinds: int = 8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the smallest id stays.

    Groups are what chains of pairs with a similarity of at least ``similarity`` (above 0) by distinct ``shingle``-word shingles
    connect. Equal texts are one group. Most links come cheaply: SimHash fingerprints over distinct words, of several ``kinds``, that
    differ in at most ``radius`` bits, found by vantage-point trees; each document is compared with the nearest and the first one
    before it in a leaf and with the first of its chain. What these miss (cut or extended copies, pairs behind a stand-in), exact
    ``signatures`` find, see ``_link_by_signatures``. Every pair that is linked was verified.

    Of rows that share an id and a text all stay or go. Rows with null ids stay. A null text counts as empty.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body"):
            fps = word_fingerprints(piece["body"], kinds).view(np.int64)
            bits, sizes = bitmaps(piece["body"], shingle)
            yield pa.record_batch({"node": piece["node"], "size": sizes.astype(np.int32), "bits": pa.array(bits, type=pa.binary()),
                                   "fps": pa.ListArray.from_arrays(np.arange(0, fps.size + 1, kinds, dtype=np.int32), fps.reshape(-1))})

    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(row_column(docs).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), body.alias("body"))
    rows = rows.withColumn("text_key", F.md5(F.col("body").cast("binary")))
    # Each text once. Copies meet in the task that reads them, so many copies of a text are no large group.
    texts = materialize(rows.where("id IS NOT NULL").groupBy("text_key").agg(
        F.min("id").alias("node"), F.first("body").alias("body")), "texts")
    coded = materialize(map_arrow(texts.select("node", "body"), describe, "node long, size int, bits binary, fps array<long>"), "coded")
    maps, each = coded.select("node", "size", "bits"), coded.select("node", F.posexplode("fps").alias("kind", "fp"))
    unique = materialize(each.groupBy("kind", "fp").agg(F.min("node").alias("node")), "unique")
    same = each.select(F.col("node").alias("a"), "kind", "fp").join(unique.hint("merge"), ["kind", "fp"]).select(
        "a", F.col("node").alias("b"))
    proposed = same.where("a <> b").unionByName(fingerprint_links(unique, radius, nearest=True))
    proposed = materialize(proposed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "proposed")
    chains = connected_components(proposed).where("node <> component").select(
        F.col("node").alias("a"), F.col("component").alias("b"))
    near = _similar_pairs(texts, materialize(proposed.unionByName(chains).distinct(), "proposed"), maps, similarity, shingle)
    near = _link_by_signatures(texts, near, maps, similarity, shingle)
    losers = connected_components(near).where("node <> component").select("node")
    groups = texts.select("text_key", "node").join(losers.hint("merge"), "node", "left").select(
        "text_key", "node", losers["node"].isNotNull().alias("lost"))
    gone = rows.where("id IS NOT NULL").select("id", "text_key").distinct().join(groups.hint("merge"), "text_key").where(
        F.col("lost") | (F.col("id") != F.col("node"))).select("id", "text_key")
    return lookup_join(rows, materialize(gone, "gone"), ["id", "text_key"], "left_anti").select(*with_new_columns(docs.columns, "row"))


def _similar_pairs(texts: DataFrame, proposed: DataFrame, maps: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of the pairs ``proposed (a, b)`` those whose ``texts (node, body)`` are similar enough, written down. First the ``maps (node, size,
    bits)`` rule out what can't be similar; only texts that a pair names after that are moved."""
    @F.arrow_udf("boolean")
    def possible(size_a: pa.Array, bits_a: pa.Array, size_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        both = Bitmaps(pa.concat_arrays([bits_a, bits_b]), np.concatenate([size_a.to_numpy(), size_b.to_numpy()]))
        rows = np.arange(len(size_a))
        return pa.array(both.may_be_similar(rows, rows + len(rows), similarity))

    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(shingle_similarity(a, b, shingle), type=pa.float64())

    with interim(texts.sparkSession) as keep:
        for side in ("a", "b"):
            proposed = proposed.join(maps.toDF(side, f"size_{side}", f"bits_{side}").hint("merge"), side)
        fits = (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-6) & possible("size_a", "bits_a", "size_b", "bits_b")
        proposed = materialize(proposed.where(fits).select("a", "b"), "possible")
        ends = materialize(proposed.select("a").union(proposed.select("b")).distinct().withColumnRenamed("a", "node"), "ends")
        named = materialize(texts.select("node", "body").join(broadcast_if_small(ends), "node", "left_semi"), "named")
        pairs = proposed.join(named.select(F.col("node").alias("a"), F.col("body").alias("text_a")).hint("merge"), "a")
        pairs = pairs.join(named.select(F.col("node").alias("b"), F.col("body").alias("text_b")).hint("merge"), "b")
        with small_batches(texts.sparkSession, PAIRS_PER_BATCH):
            return keep(pairs.where(similar("text_a", "text_b") >= similarity).select("a", "b").distinct(), "near")


def _link_by_signatures(texts: DataFrame, near: DataFrame, maps: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``near (a, b)`` with verified links that connect all of the ``texts`` that chains of similar pairs connect.

    Similar texts share a signature. Those of many texts travel as packets to buckets, which tell those that several texts have. First each signature's smallest text is its leader, with which those of other groups are compared: a
    group of near copies takes one pair for each member, and is closed. Then the texts of signatures with one leader that are still in different
    groups are compared among themselves, within tasks, by ``bitmaps``, which bound how many shingles two texts can share. Only pairs that
    the bound lets through leave the task, and they are verified. A pair is left out only if it is in one group or can't be similar.
    """
    spark = texts.sparkSession
    common = common_shingles(texts, shingle)

    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SIGNED_PER_BUCKET), 1 << 15)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body", SIGNED_BYTES):
            found, owner, size = signatures(piece["body"], similarity, shingle, common)
            key, node = found >> np.uint64(64 - SIGNATURE_BITS), piece["node"].to_numpy()
            order = np.argsort(key)
            key, owner, size = key[order], owner[order], size[order]
            bucket = (key * np.uint64(buckets) >> np.uint64(SIGNATURE_BITS)).astype(np.int32)
            bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(key) else np.zeros(1, dtype=np.int64)
            rows = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                mine, first, place = np.unique(owner[lo:hi], return_index=True, return_inverse=True)
                rows.append(pack(narrow(np.diff(key[lo:hi], prepend=np.uint64(0))), narrow(place), node[mine], narrow(size[lo:hi][first])))
            yield pa.record_batch({"bucket": pa.array(bucket[bounds[:-1]], type=pa.int32()), **packet_columns(rows)})

    def meet(table: pa.Table) -> pa.Table:
        """The signatures of a bucket that several texts have."""
        sent = [unpack(*x) for x in packets(table)]
        key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
        node, size = (np.concatenate([x[k][x[1]] for x in sent]) for k in (2, 3))
        order = np.argsort(key)
        key, node, size = key[order].view(np.int64), node[order], size[order].astype(np.int32)
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        several = np.minimum.reduceat(node, heads) < np.maximum.reduceat(node, heads)
        several = np.repeat(several, np.diff(heads, append=len(key)))
        return pa.table({"sig": key[several], "node": node[several], "size": size[several]})

    def in_groups(members: DataFrame) -> DataFrame:
        """The members (sig, node, size) of signatures whose texts are in several groups, with their ``component`` and the ``leader``."""
        names = connected_components(near)
        named = members.join(names.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        ends = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.min(F.struct("size", "node", "component")).alias("leader"))
        return named.join(ends.where("low < high").select("sig", "leader").hint("merge"), "sig")

    with interim(spark) as keep:
        signed = map_arrow(texts.select("node", "body"), sign, "bucket int, size int, packed binary")
        shared = materialize(signed.groupBy("bucket").applyInArrow(meet, "sig long, node long, size int"), "shared")
        led = in_groups(shared).where((F.col("component") != F.col("leader.component")) & (
            F.least("size", "leader.size") >= F.greatest("size", "leader.size") * similarity - 1e-6))
        proposed = materialize(led.select(F.greatest("node", "leader.node").alias("a"), F.least("node", "leader.node").alias("b")).distinct(),
                               "proposed")
        near = materialize(near.unionByName(_similar_pairs(texts, proposed, maps, similarity, shingle)), "near")
        # Texts of signatures with one leader form one list, so that those of a shared passage meet once, not once for each of its signatures.
        open_ = in_groups(shared).select(F.col("leader.node").alias("leader"), "node", "size", "component").distinct()
        open_ = materialize(open_, "open")
        # Each text carries its leaders, unless they are many, so that a pair is named in the list of its smallest common one only.
        others = open_.groupBy("node").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
        others = others.select("node", F.when(F.size("leaders") <= MOST_LEADERS, F.col("leaders")).alias("leaders"))
        drawn = maps.select("node", "bits").join(others.hint("merge"), "node")
        # Long lists are cut into parts, and each part meets each.
        lists = open_.groupBy("leader").agg(F.ceil(F.count("*") / LONG_LIST).cast("int").alias("parts"))
        dealt = open_.join(lists.hint("merge"), "leader")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn(
            "met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("leader", "node", "size", "component", "own", F.least("own", "met").alias("part"), F.greatest("own", "met").alias("other"))
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), open_.count() // BUCKET_ROWS)
        dealt = dealt.join(drawn.hint("merge"), "node").withColumn("bucket", F.pmod(F.xxhash64("leader", "part", "other"), F.lit(buckets)))
        proposed = materialize(dealt.groupBy("bucket").applyInArrow(lambda table: possible_pairs(table, similarity), "a long, b long").distinct(),
                               "proposed")
        return keep(near.unionByName(_similar_pairs(texts, proposed, maps, similarity, shingle)).distinct(), "near")


def bitmaps(array: pa.Array, shingle: int) -> tuple[list[bytes], np.ndarray]:
    """For each text a bitmap of two to four bits for each distinct shingle (64 at least), with the bits of its shingles' hashes set; and
    the number of its distinct shingles."""
    keys, owner, n = distinct_shingles(array, shingle, np.zeros(0, dtype=np.uint64))
    first = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        width = max(64, 1 << int(2 * (hi - lo)).bit_length())
        bits = np.zeros(width, dtype=np.uint8)
        bits[(keys[lo:hi] & np.uint64(width - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out, np.diff(first)


def possible_pairs(table: pa.Table, similarity: float) -> pa.Table:
    """The pairs of texts in different groups, of those in one list (``leader``) of the table, whose sizes and bitmaps don't rule out a
    ``similarity``. A list holds a text once. A pair is given in the list of its smallest common leader only; texts without ``leaders``
    are given in each list."""
    leader, node, size, component, own, part, other = (
        table[c].to_numpy() for c in ("leader", "node", "size", "component", "own", "part", "other"))
    order = np.lexsort((node, size, other, part, leader))
    leader, node, size, component, own, part, other = (x[order] for x in (leader, node, size, component, own, part, other))
    new = np.ones(len(node), dtype=bool)
    new[1:] = (leader[1:] != leader[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])
    # In a list, ordered by size, a text's partners are those after it up to the largest size that can be similar.
    place = np.cumsum(new) << 32
    last = np.searchsorted(place + size, place + np.floor(size / similarity + 1e-6).astype(np.int64), side="right")
    later = np.maximum(last - np.arange(len(node)) - 1, 0)
    ends, keys, at = np.cumsum(later), [np.zeros(0, dtype=np.int64)], 0
    maps = Bitmaps(table["bits"].combine_chunks().take(pa.array(order)), size)
    ids, number = np.unique(node, return_inverse=True)
    lists = table["leaders"].combine_chunks().take(pa.array(order))
    known, none = lists.is_valid().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    leaders = np.full((len(node), max(counts.max(initial=0), 1)), none)
    leaders[np.arange(leaders.shape[1])[None, :] < counts[:, None]] = lists.flatten().to_numpy()
    while at < len(node):       # some rows at a time with all their partners
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")), at + 1)
        i = np.repeat(np.arange(at, to), later[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        fits = (component[i] != component[j]) & ((part[i] == other[i]) | (own[i] != own[j]))
        i, j = i[fits], j[fits]
        fits = maps.may_be_similar(i, j, similarity)
        i, j = i[fits], j[fits]
        fits = ~(known[i] & known[j])
        for k in range(0, len(i), 1 << 13):
            block = slice(k, k + (1 << 13))
            both = np.sort(np.concatenate([leaders[i[block]], leaders[j[block]]], axis=1), axis=1)
            least = np.where((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none), both[:, 1:], none).min(axis=1)
            fits[block] |= least == leader[i[block]]
        i, j = number[i[fits]], number[j[fits]]
        keys.append(np.unique(np.maximum(i, j) * np.int64(len(ids)) + np.minimum(i, j)))
        at = to
    keys = np.unique(np.concatenate(keys))
    return pa.table({"a": ids[keys // max(len(ids), 1)], "b": ids[keys % max(len(ids), 1)]})


class Bitmaps:
    """The bitmaps of texts with ``sizes`` shingles each. A wider bitmap is folded to the width of the one it meets."""

    def __init__(self, bits: pa.Array, sizes: np.ndarray):
        self.sizes = sizes.astype(np.float64)
        self.at = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset:bits.offset + len(bits) + 1].astype(np.int64) // 8 \
            if len(bits) else np.zeros(1, dtype=np.int64)
        self.words = np.frombuffer(bits.buffers()[2], dtype="<u8") if len(bits) else np.zeros(0, dtype=np.uint64)
        self.widths = np.diff(self.at)

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(rows), width), dtype=np.uint64)
        for wide in np.unique(self.widths[rows]).tolist():
            mine = np.flatnonzero(self.widths[rows] == wide)
            whole = self.words[self.at[rows[mine]][:, None] + np.arange(wide)]
            out[mine] = np.bitwise_or.reduce(whole.reshape(len(mine), wide // width, width), axis=1)
        return out

    def may_be_similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the bitmaps of rows ``a`` and ``b`` leave room for a ``similarity``.

        Each bit that only one of two texts has set stands for a shingle that the other doesn't have: with x such bits of a text of size a,
        the two share at most a - x; and a similarity of s takes (a + b) * s / (1 + s) shared ones.
        """
        fits, narrow = np.zeros(len(a), dtype=bool), np.minimum(self.widths[a], self.widths[b])
        for width in np.unique(narrow).tolist():
            mine = np.flatnonzero(narrow == width)
            step = max(1, PAIRS_AT_ONCE // int(max(self.widths[a[mine]].max(), self.widths[b[mine]].max())))
            for at in range(0, len(mine), step):
                i, j = a[mine[at:at + step]], b[mine[at:at + step]]
                x, y = self.folded(i, width), self.folded(j, width)
                most = np.minimum(self.sizes[i] - np.bitwise_count(x & ~y).sum(axis=1), self.sizes[j] - np.bitwise_count(y & ~x).sum(axis=1))
                fits[mine[at:at + step]] = most >= (self.sizes[i] + self.sizes[j]) * similarity / (1 + similarity) - 1e-6
        return fits
