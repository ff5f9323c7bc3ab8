"""What the operators of this folder share: Arrow batches as byte arrays, words, and rows carried along."""

from __future__ import annotations

import contextlib
import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe import session
from dataprobe.session import materialize

__all__ = ["Words", "bytes_of", "inline_table", "interim", "map_arrow", "materialize", "mix64", "narrow", "pack", "packet_columns",
           "packets", "pieces", "row_column", "small_batches", "unpack", "with_new_columns"]

#: Bytes of text that are worked on at once in a task. Longer texts come alone.
PIECE_BYTES = 2 << 20
#: U+0020 and U+0009 to U+000D, the white space of the word rule ``[^\\x20\\x09-\\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each begins and ends; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of many texts. ``text`` holds all words with one space between neighbours; word ``i`` is
    ``text[at[i]:to[i]]``, and the words of text ``d`` are ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, array: pa.Array, lower: bool = False, white: np.ndarray = WHITE):
        raw, offsets = bytes_of(array)
        solid = ~white[raw]
        before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        before[inner], after[inner - 1] = False, False
        begins = solid & ~before
        start, end = np.flatnonzero(begins), np.flatnonzero(solid & ~after) + 1
        length = end - start
        self.to = np.cumsum(length + 1) - 1
        self.at = self.to - length
        self.text = np.full(int(length.sum()) + len(start), 0x20, dtype=np.uint8)
        small = np.int32 if len(raw) < 1 << 30 else np.int64
        place = np.repeat(np.arange(len(start), dtype=small), length)
        place += np.arange(len(place), dtype=small)
        self.text[place] = LOWER[raw[solid]] if lower else raw[solid]
        self.first = np.searchsorted(start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit number per word, equal for equal words. Only good for choosing, not for proving equality."""
        out = np.zeros(len(self.at), dtype=np.uint64)
        for i in range(0, len(self.at), 1 << 15):       # some words at a time, so that the powers stay few
            at, to = self.at[i:i + (1 << 15)], self.to[i:i + (1 << 15)]
            begin, n = at[0], int(to[-1] - at[0])
            powers, inverse = _powers(n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.text[begin:begin + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
            out[i:i + (1 << 15)] = (sums[to - begin] - sums[at - begin]) * inverse[at - begin]
        return mix64(out)


_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse, without carry beyond 64 bits. Only those of ordinary texts are kept."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    found = []
    for factor in (_ODD, pow(_ODD, -1, 1 << 64)):
        values = np.full(max(n, 1 << 18), np.uint64(factor), dtype=np.uint64)
        values[0] = 1
        found.append(np.multiply.accumulate(values))
    if n <= 1 << 20:
        _POWERS[:] = found
    return found


def mix64(x: np.ndarray) -> np.ndarray:
    """The published 64-bit finaliser of SplitMix64 (its constants are fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def pack(*values: object) -> tuple[int, bytes]:
    """Arrays as one compressed packet, after its size. Many small rows travel so as one."""
    data = pickle.dumps(values, protocol=5)
    return len(data), pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def unpack(size: int, packed: bytes) -> tuple:
    return pickle.loads(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True))


def packet_columns(rows: list[tuple[int, bytes]]) -> dict[str, pa.Array]:
    return {"size": pa.array([r[0] for r in rows], type=pa.int32()), "packed": pa.array([r[1] for r in rows], type=pa.binary())}


def packets(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    for batch in table.to_batches(max_chunksize=64):
        yield from zip(batch["size"].to_pylist(), batch["packed"].to_pylist())


@contextlib.contextmanager
def interim(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside the block go at its end, but for those that are written by the function that it gives."""
    since, kept = len(session._WRITTEN), []

    def keep(df: DataFrame, label: str) -> DataFrame:
        found = materialize(df, label)
        kept.append(session._WRITTEN.pop())
        return found

    try:
        yield keep
    finally:
        session.release_scratch(spark, since)
        session._WRITTEN.extend(kept)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside the block send at most ``rows`` rows to Python at once, for rows of several whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_column(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names of working columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_new_columns(columns: list[str], row: str, **new: Column) -> list[Column]:
    """The carried ``columns`` of struct ``row`` and then the ``new`` ones, which replace columns of that name."""
    taken = {name.lower() for name in new}
    kept = [F.col(f"{row}.`{c}`").alias(c) for c in columns if c.lower() not in taken]
    return kept + [value.alias(name) for name, value in new.items()]


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, sent as one JSON literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))

