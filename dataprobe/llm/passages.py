"""Repeated passages: full-text indexes over shards of the corpus, searched with the documents' own windows.

A window is ``width`` consecutive words. It is sent to a shard that its content decides: by the least hash of its short
word sequences, so that neighbouring windows mostly go to one shard and travel as one stretch of text. Equal windows
meet in one shard. There an FM-index over the distinct stretches gives the matching statistics of all windows, and the
interval of each repeated window gives the smallest document that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import Words, map_arrow, mix64, pieces, row_column, with_new_columns
from dataprobe.llm.fmindex import FMIndex

WIDTH = 13
#: Words of the sequences whose least hash names the shard, and windows in a stretch at most.
SEQUENCE, STRETCH = 3, 16
#: Text of documents whose stretches are sent together. Larger groups compress better and take more memory.
SHIPPED_BYTES = 4 << 20
#: Text in a shard, before equal stretches and single ones are taken out.
SHARD_BYTES = 64 << 20
#: Documents that are looked at for sequences that very many share. It only decides how windows are dealt out.
SAMPLE_DOCS = 20_000
#: A sequence in more than this share of them is dealt out by whole windows. There are at most so many of these.
COMMON_SHARE, MOST_COMMON = 1 / 500, 20_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def window_keys(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first word of each window, and the least hash of a word sequence in it."""
    counts = words.counts()
    n = np.maximum(counts - width + 1, 0)
    first = np.cumsum(n) - n
    start = np.arange(int(n.sum())) + np.repeat(words.first[:-1] - first, n)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    length = min(SEQUENCE, width)
    grams = np.zeros(len(hashes) - length + 1, dtype=np.uint64)
    for k in range(length):
        grams = grams * _ODD + hashes[k:len(hashes) - length + 1 + k]
    least, span, wanted = mix64(grams), 1, width - length + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:len(least) - span], least[span:])
        span *= 2
    return start, np.minimum(least[start], least[start + wanted - span])


def stretches(words: Words, hashes: np.ndarray, width: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first word, number of windows, key, and what decides the shard. A window with a
    ``common`` key is a run by itself and dealt out by its own content."""
    start, key = window_keys(words, hashes, width)
    if not len(start):
        return start, start, key, key
    hot = np.isin(key, common) if len(common) else np.zeros(len(key), dtype=bool)
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (np.diff(start) != 1) | (key[1:] != key[:-1]) | hot[1:]
    opened = np.flatnonzero(opens)
    place = np.arange(len(start)) - np.repeat(opened, np.diff(np.concatenate([opened, [len(start)]])))
    opens |= place % STRETCH == 0
    at = np.flatnonzero(opens)
    windows = np.diff(np.concatenate([at, [len(start)]]))
    shard = mix64(key[at] + np.uint64(1))
    own = np.flatnonzero(hot[at])
    if len(own):
        content = np.zeros(len(own), dtype=np.uint64)
        for k in range(width):
            content = content * _ODD + hashes[start[at[own]] + k]
        shard[own] = mix64(content)
    return start[at], windows, key[at], shard


def _gather(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings ``text[begin[i]:end[i]]``."""
    length = end - begin
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(int(offsets[-1]), dtype=np.uint8)
    for at in range(0, len(begin), 1 << 15):        # the places of all bytes at once would take eight times their room
        part = slice(at, at + (1 << 15))
        lo, hi = offsets[at], offsets[min(at + (1 << 15), len(begin))]
        out[lo:hi] = text[np.arange(lo, hi) + np.repeat(begin[part] - offsets[:-1][part], length[part])]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers that are not negative, lowest bytes first, then the next bytes and so on; small numbers compress well so."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(raw: np.ndarray, count: int, width: int) -> np.ndarray:
    return np.ascontiguousarray(raw[:count * width].reshape(width, count).T).view(f"<u{width}").reshape(-1).astype(np.int64)


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], np.diff(offsets)


_SHIPPED = "shard int, n int, m int, size int, data binary"


def _ship(ids: np.ndarray, words: Words, width: int, shards: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The stretches of some documents, one row for each shard: distinct texts, and where their smallest holder has them.

    All other holders here lose the stretch, whatever the rest of the corpus holds: that is decided at once, and the
    runs go along in a row of their own. So a shard gets a text once for each such group of documents at most.
    """
    hashes = words.hashes()
    start, windows, key, by = stretches(words, hashes, width, common)
    if not len(start):
        return
    shard = (by % np.uint64(shards)).astype(np.int64)
    found = _gather(words.text, words.at[start], words.to[start + windows + width - 2]).dictionary_encode()
    content = found.indices.to_numpy()
    texts, first = found.dictionary, np.unique(content, return_index=True)[1]
    document = np.searchsorted(words.first, start, side="right") - 1
    place = start - words.first[document]
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, content, ids[document])
    lost = np.flatnonzero(ids[document] > least[content])
    codec = pa.Codec("zstd", compression_level=6)
    if len(lost):
        check = _check(hashes, start[lost], start[lost] + windows[lost] + width - 1)
        base = ids[document[lost]].min()
        raw = b"".join([np.int64(base).tobytes(), _planes((ids[document[lost]] - base).view(np.uint64), 8),
                        _planes(_run(place[lost], windows[lost], check).view(np.uint64), 8)])
        yield pa.record_batch([pa.array([int(mix64(start[-1:].view(np.uint64) + ids[:1].view(np.uint64))[0] % np.uint64(shards))], pa.int32()),
                               pa.array([0], pa.int32()), pa.array([len(lost)], pa.int32()), pa.array([len(raw)], pa.int32()),
                               pa.array([codec.compress(raw, asbytes=True)], pa.binary())], names=["shard", "n", "m", "size", "data"])
    low = (key[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    order = np.lexsort((low, shard[first]))                         # contents by shard
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    texts, by_shard = texts.take(pa.array(order)), shard[first][order]
    data, length = _bytes(texts)
    low = low[order]
    first_holder = np.flatnonzero(ids[document] == least[content])
    held = first_holder[np.argsort(rank[content[first_holder]], kind="stable")]
    count = np.bincount(rank[content[first_holder]], minlength=len(order))
    owners, place = ids[document][held], place[held]
    c_bytes, c_held = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(count)])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(by_shard)) + 1, [len(by_shard)]])
    columns: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        p, q = int(c_held[a]), int(c_held[b])
        base = owners[p:q].min()
        raw = b"".join([np.int64(base).tobytes(), _planes(length[a:b], 4), _planes(np.diff(low[a:b], prepend=0), 4), _planes(count[a:b], 4),
                        _planes((owners[p:q] - base).view(np.uint64), 8), _planes(place[p:q], 4), data[c_bytes[a]:c_bytes[b]].tobytes()])
        for column, value in zip(columns, (int(by_shard[a]), b - a, q - p, len(raw), codec.compress(raw, asbytes=True))):
            column.append(value)
    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.binary()])],
                          names=["shard", "n", "m", "size", "data"])


def _received(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[pa.Table]]:
    """Distinct texts of a shard whose key occurs twice or more, and their holders: text number, document, place; and the
    runs that were decided before."""
    codec = pa.Codec("zstd")
    columns = [table[c].to_pylist() for c in ("n", "m", "size", "data")]
    parts, decided = [], []
    for n, m, size, data in zip(*columns):
        raw = np.frombuffer(codec.decompress(data, decompressed_size=size), dtype=np.uint8)
        if not n:
            ids = _from_planes(raw[8:], m, 8) + raw[:8].view(np.int64)[0]
            decided.append(pa.table({"id": ids, "run": _from_planes(raw[8 + 8 * m:], m, 8)}))
            continue
        at, part = 8, []
        for count, width in ((n, 4), (n, 4), (n, 4), (m, 8), (m, 4)):
            part.append(_from_planes(raw[at:], count, width))
            at += count * width
        part[1] = np.cumsum(part[1])
        part[3] = part[3] + raw[:8].view(np.int64)[0]
        parts.append((*part, raw[at:]))
    none = np.zeros(0, dtype=np.int64)
    if not parts:
        return pa.array([], type=pa.large_binary()), none, none, none, decided
    low, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    values, which = np.unique(low, return_inverse=True)
    again = np.bincount(which, count, len(values))[which] > 1
    texts, owners, places, at = [], [], [], 0
    sizes = []
    for length, _, held, ids, place, data in parts:
        keep = again[at:at + len(length)]
        at += len(length)
        if keep.any():
            ends = np.cumsum(length, dtype=np.int64)
            texts.append(_gather(data, (ends - length)[keep], ends[keep]))
            mine = np.repeat(keep, held)
            sizes.append(held[keep])
            owners.append(ids[mine])
            places.append(place[mine])
    if not texts:
        return pa.array([], type=pa.large_binary()), none, none, none, decided
    found = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    content = np.repeat(found.indices.to_numpy(), np.concatenate(sizes))
    return found.dictionary, content, np.concatenate(owners), np.concatenate(places), decided


def smallest_holders(texts: pa.Array, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """For each window of each text (in order; where each text's begin) the smallest of the numbers ``least`` of the
    texts that hold it."""
    words = Words(texts.cast(pa.large_string()))
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    numbers = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    length = np.diff(lists.offsets.to_numpy())
    index = FMIndex(numbers, length)
    windows = length - width + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(texts)), windows)
    ends = np.arange(begin[-1]) - np.repeat(begin[:-1], windows) + index.first[owner] + width - 1
    matched, low, high = index.matching_statistics(ends, width)
    holder = least[owner]
    repeated = np.flatnonzero(matched >= width)
    if len(repeated):
        # Intervals of equal length in words are equal or apart.
        lows, which = np.unique(low[repeated], return_inverse=True)
        highs = np.zeros(len(lows), dtype=np.int64)
        highs[which] = high[repeated]
        by_suffix = least[np.searchsorted(index.first, index.sa, side="right") - 1]
        edges = np.column_stack([lows, highs]).reshape(-1)
        by_suffix = np.append(by_suffix, np.iinfo(np.int64).max)
        holder[repeated] = np.minimum.reduceat(by_suffix, edges)[::2][which]
    return holder, begin, words


def _run(place: np.ndarray, windows: np.ndarray, check: np.ndarray) -> np.ndarray:
    """A run of windows in one number: the place of its first word (33 bits), how many (6 bits) and a check (24 bits)."""
    return (place << 30) | (windows << 24) | check


def _check(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """24 bits from the words of a stretch, to see that it is the same text."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    return (mix64(sums[end] - sums[begin]) & np.uint64(0xFFFFFF)).astype(np.int64)


def find_in_shard(table: pa.Table, width: int) -> pa.Table:
    """``(id, run)`` for each run of windows in a shard that a smaller document holds, see ``_run``."""
    texts, content, ids, place, decided = _received(table)
    if not len(content):
        none = pa.array([], type=pa.int64())
        return pa.concat_tables([*decided, pa.table({"id": none, "run": none})])
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, content, ids)
    holder, begin, words = smallest_holders(texts, least, width)
    # Holders of a text that are not its smallest, or whose text has a window of a smaller one.
    windows = np.diff(begin)
    smallest = np.minimum.reduceat(holder, begin[:-1])
    some = np.flatnonzero(ids > smallest[content])
    content, ids, place = content[some], ids[some], place[some]
    n = windows[content]
    first = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(first, n)
    seen = np.repeat(ids, n) > holder[np.repeat(begin[:-1][content], n) + inside]
    opens = seen & np.concatenate([[True], ~seen[:-1]])
    opens |= seen & (inside == 0)
    starts = np.flatnonzero(opens)
    closes = seen & np.concatenate([~seen[1:] | (inside[1:] == 0), [True]])
    count = np.flatnonzero(closes) - starts + 1
    owner = np.repeat(np.arange(len(n)), n)[starts]
    word = words.first[content[owner]] + inside[starts]
    check = _check(words.hashes(), word, word + count + width - 1)
    run = _run(place[owner] + inside[starts], count, check)
    return pa.concat_tables([*decided, pa.table({"id": ids[owner], "run": run})])


def _cut(texts: pa.Array, runs: list[list[int] | None], width: int) -> tuple[list[int], list[int], list[bytes]]:
    """Words, removed words and what is left of each text."""
    words = Words(texts)
    hashes = words.hashes()
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(runs)), [len(r or ()) for r in runs])
    if len(owner):
        run = np.array([x for r in runs for x in r or ()], dtype=np.int64)
        begin = words.first[owner] + (run >> 30)
        end = begin + ((run >> 24) & 63) + width - 1
        fits = end <= words.first[owner + 1]
        begin, end, run = begin[fits], end[fits], run[fits]
        same = _check(hashes, begin, end) == run & 0xFFFFFF
        np.add.at(change, begin[same], 1)
        np.add.at(change, end[same], -1)
    keep = np.cumsum(change)[:-1] == 0
    letters = np.repeat(keep, words.to - words.at + 1)
    left = words.text if keep.all() else words.text[letters[:len(words.text)]]
    kept = np.concatenate([[0], np.cumsum(np.where(keep, words.to - words.at + 1, 0))])[words.first]
    counts = words.counts()
    removed = counts - np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
    return counts.tolist(), removed.tolist(), [left[a:max(a, b - 1)].tobytes() for a, b in zip(kept[:-1], kept[1:])]


def remove_repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words of the text, joined by one space, without those covered by
    a window of ``width`` words whose sequence also starts in a document with a smaller id. Windows are judged
    on the input. Columns of ``docs`` that have a new column's name are replaced.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Ids are whole numbers. Rows that share an id are judged alike; a row
    with a null id loses nothing and counts as no other's source.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    base = base.where("id IS NOT NULL")
    total, size = base.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * tasks, -(-4 * size // SHARD_BYTES))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body"):
            words = Words(piece["body"])
            start, key = window_keys(words, words.hashes(), width)
            owner = np.searchsorted(words.first, start, side="right")
            new = np.ones(len(start), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            yield pa.record_batch({"key": key[new].view(np.int64)})

    sampled = base.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    least = max(10, int(min(total, SAMPLE_DOCS) * COMMON_SHARE))
    shared = map_arrow(sampled, keys, "key long").groupBy("key").count().where(F.col("count") > least).orderBy(
        F.desc("count"), "key").limit(MOST_COMMON).collect()
    common = np.sort(np.array([r["key"] for r in shared], dtype=np.int64).view(np.uint64))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body", SHIPPED_BYTES):
            yield from _ship(piece["id"].to_numpy(), Words(piece["body"]), width, shards, common)

    runs = map_arrow(base, ship, _SHIPPED).groupBy("shard").applyInArrow(
        lambda table: find_in_shard(table, width), "id long, run long")
    by_document = runs.groupBy("id").agg(F.collect_list("run").alias("runs"))

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def cut(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, found in arrays:
            out: list[list] = [[], [], []]
            for piece in pieces(iter([pa.record_batch({"text": bodies, "runs": found})]), "text"):
                for column, values in zip(out, _cut(piece["text"], piece["runs"].to_pylist(), width)):
                    column += values
            yield pa.StructArray.from_arrays(
                [pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.int64()),
                 pa.array(out[2], type=pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    rows = docs.select(row_column(docs).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    judged = rows.join(by_document.hint("merge"), "id", "left").select("row", cut("body", "runs").alias("x"))
    return judged.select(*with_new_columns(docs.columns, "row", n_words=F.col("x.n_words"), n_removed=F.col("x.n_removed"),
                                           kept=F.col("x.kept")))
