"""Minimal unique column combinations of one table.

Two rows that agree on a set of columns refute every subset of it, so a few well chosen pairs rule out most of the lattice, and
the smallest sets that no known pair refutes are the candidates. They are tested on hash slices, which refute most of them, and then on
all rows. There each task sorts the hashes of a candidate's values and sends them packed, about four bytes for a row, to buckets
of their range; values that come twice in a bucket are looked up in the rows and compared by all their bits. A row that is alone with its values of a
set is alone for every superset, and where the others are few it is not sent again. A failed test gives new pairs, until all candidates
have passed. The driver holds sets of column names, and a bounded number of hashes. Nulls count as values: NULL equals NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.llm.common import mix64, narrow, pack, packet_columns, unpack
from dataprobe.operators.joins import broadcast_if_small
from dataprobe.session import materialize

#: Rows per order of columns that are searched for pairs which agree on many columns.
SLICE_ROWS = 10_000
#: Rows of the slice on which candidates are tested first.
TEST_ROWS = 64_000
#: Sets that are tested in one scan of a slice, which keeps the generated code small, and pairs of rows that a failed test gives.
PER_SCAN, WITNESSES = 96, 64
#: Rows whose hashes are sorted and packed together, and about how many hashes meet in a bucket.
BLOCK_ROWS, BUCKET_ROWS = 1 << 20, 1 << 21
#: Rows that are written down together and searched at once for those of a slice or with listed values (at most 1 << 17).
SCAN_ROWS = 1 << 16
FILE_BLOCKS = 4
#: Repeated values of a set that a test looks up in the rows.
SUSPECTS = 1024
#: Share of the rows that must be alone in a set's clusters for the set to be remembered, and how many values that come
#: twice, of all remembered sets, are sent to the tasks.
LONE_SHARE, STRIP_VALUES = 0.5, 1 << 20

Columns = frozenset[int]
#: For a set of columns the leading bits of its values that come twice, in order: rows with other values are alone.
Stripped = dict[Columns, np.ndarray]


def _hashed(columns: Sequence[str], numbers: Sequence[int] | None = None, kind: T.DataType | None = None) -> list[Column]:
    """``a0, b0, a1, b1, ...``: 128 bits for each of a row's values.

    Each column is hashed twice, with its number and whether it is null (hashes skip nulls); a set of columns has the exclusive
    or of its columns' hashes. Equal values have equal bits, so bits without a repeat prove a set unique.
    """
    value = (lambda c: F.col(f"`{c}`").cast("int")) if isinstance(kind, T.NullType) else (lambda c: F.col(f"`{c}`"))
    return [F.xxhash64(F.lit(2 * k + side), value(c).isNull().cast("int"), value(c)).alias(f"{'ab'[side]}{k}")
            for k, c in zip(numbers or range(len(columns)), columns) for side in (0, 1)]


def _encoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(block, rows, size, packed)``: the rows in blocks of up to ``SCAN_ROWS``, each column compressed. What is written down are values, which take
    far less space than hashes and are hashed anew by each scan (``_scan``); only of texts and compound types the hashes are kept."""
    whole = ("tinyint", "smallint", "int", "bigint", "boolean")
    plain = {"date": F.unix_date, "timestamp": F.unix_micros, "float": lambda c: c.cast("double"), "double": lambda c: c}
    plain |= dict.fromkeys(whole, lambda c: c.cast("bigint"))
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    sent = [plain[kind](F.col(f"`{c}`")).alias(f"v{k}") for k, (c, kind) in enumerate(zip(columns, kinds)) if kind in plain]
    texts = [k for k, kind in enumerate(kinds) if kind not in plain]
    sent += [x for k in texts for x in _hashed([columns[k]], [k], df.schema[columns[k]].dataType)]
    most = min(SCAN_ROWS, BLOCK_ROWS)

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                kept.append(batch.slice(at, most))
                if sum(b.num_rows for b in kept) >= most:
                    rows = pa.Table.from_batches(kept)
                    for low in range(0, rows.num_rows - most + 1, most):
                        yield block(number, rows.slice(low, most))
                        number += 1
                    kept = rows.slice(rows.num_rows - rows.num_rows % most).to_batches()
        if sum(b.num_rows for b in kept):
            yield block(number, pa.Table.from_batches(kept))

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        stored = []
        for k in range(len(columns)):
            if k in texts:
                stored.append([None, *(_stored(rows[f"{side}{k}"].to_numpy().view(np.uint64)) for side in "ab")])
                continue
            column = rows[f"v{k}"].combine_chunks()
            null = np.packbits(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else None
            values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            if values.dtype.kind == "f":        # one zero, one NaN
                values = np.where(np.isnan(values), np.nan, values + 0.0)
            else:
                values = values.astype(np.int64)
            stored.append([null, _stored(values.view(np.uint64))])
        return pa.record_batch({"block": pa.array([number], type=pa.int64()), "rows": pa.array([rows.num_rows], type=pa.int32()), **packet_columns([pack(rows.num_rows, stored)])})

    return materialize(df.select(*sent).mapInArrow(pack_blocks, "block long, rows int, size int, packed binary"), "encoded", FILE_BLOCKS)


def _stored(values: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The different values and each one's number, if they are few, else the values by byte planes."""
    if len(np.unique(values[:2048])) < 1536:
        listed, number = np.unique(values, return_inverse=True)
        if 2 * len(listed) < len(values):
            return listed, narrow(number)
    return None, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _mixed(values: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each value of column ``k``, different for different values."""
    return mix64(values * np.uint64(0x9E3779B97F4A7C15) + mix64(np.array([k + 1], dtype=np.uint64)))


def _loaded(block: int, size: int, packed: bytes, sides: str, rids: bool) -> dict[str, np.ndarray]:
    rows, stored = unpack(size, packed)
    found = {"rid": np.arange(rows, dtype=np.uint64) + np.uint64(block << 17)} if rids else {}
    for k, (null, *values) in enumerate(stored):
        for side in sides:
            listed, number = values["ab".index(side) if len(values) > 1 else 0]
            plain = listed if listed is not None else np.ascontiguousarray(number.T).reshape(-1).view("<u8")
            if len(values) == 1:
                plain = _mixed(plain, k)
                plain = plain if side == "a" else mix64(plain ^ np.uint64(0xD1B54A32D192ED03))
            found[f"{side}{k}"] = plain = plain[number] if listed is not None else plain
            if null is not None:
                plain[np.unpackbits(null, count=rows).astype(bool)] = np.uint64(0xA0761D6478BD642F + 2 * k + "ab".index(side))
    return found


def _scan(batches: Iterator[pa.RecordBatch], sides: str, rids: bool = False) -> Iterator[dict[str, np.ndarray]]:
    """``a0, b0, a1, b1, ...`` of the rows of each block of ``_encoded``: 128 bits for each of a row's values, as in ``_hashed``; and numbers of the rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield _loaded(*(batch[c][i].as_py() for c in ("block", "size", "packed")), sides, rids)


def _bits(side: str, columns: Iterable[int]) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"{side}{k}") for k in sorted(columns)])


def _clusters(rows: DataFrame, sets: Sequence[Columns], slices: int = 1) -> DataFrame:
    """``(i, h1, h2, rid)`` for each row and each of the ``sets``. With ``slices`` only those whose values hash to the first slice; clusters
    are in it as a whole, so what is found there holds for the table."""
    def cluster(i: int, block: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        return {"h1": _value(block, "a", sets[i], at), "h2": _value(block, "b", sets[i], at), "rid": block["rid"][at]}

    return _in_slice(rows, sets, slices, cluster, "h1 long, h2 long, rid long")


def _in_slice(rows: DataFrame, sets: Sequence[Columns], slices: int,
              values: Callable[[int, dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``(i, ...)``: for each of the ``sets`` the ``values`` of the rows whose hash of its columns is in the first of ``slices`` ranges. All
    sets are tried on a block of rows, of which few are left, so no row is made for each set."""
    last = np.uint64((1 << 64) // slices - 1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _scan(batches, "ab", rids=True):
            found = [(i, np.flatnonzero(_value(block, "b", columns) <= last)) for i, columns in enumerate(sets)]
            found = [(i, at, values(i, block, at)) for i, at in found if len(at)]
            if found:
                yield pa.record_batch({"i": pa.array(np.concatenate([np.full(len(at), i) for i, at, _ in found]), type=pa.int32()), **{
                    name: pa.array(np.concatenate([x[name] for *_, x in found]).view(np.int64)) for name in found[0][2]}})

    return rows.mapInArrow(pick, f"i int, {schema}")


def _fingerprints(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> DataFrame:
    """``(i, h1, h2)``: for each row and set of column names the number of the set and the 128 bits that name its values."""
    names = sorted({c for columns in sets for c in columns})
    named = [frozenset(names.index(c) for c in columns) for columns in sets]
    found = [F.struct(F.lit(i).alias("i"), _bits("a", columns).alias("h1"), _bits("b", columns).alias("h2")) for i, columns in enumerate(named)]
    rows = df.select(*_hashed(names))
    return reduce(DataFrame.unionAll, [rows.select(F.explode(F.array(*found[k:k + PER_SCAN])).alias("x")).select("x.*")
                                       for k in range(0, len(found), PER_SCAN)])


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers: their differences in byte planes, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, np.ndarray]]:
    """``a0, a1, ...`` of about ``most`` rows at a time."""
    kept: list[dict[str, np.ndarray]] = []
    for block in _scan(batches, "a"):
        kept.append(block)
        if sum(len(b["a0"]) for b in kept) >= most:
            yield {c: np.concatenate([b[c] for b in kept]) for c in block}
            kept = []
    if kept:
        yield {c: np.concatenate([b[c] for b in kept]) for c in kept[0]}


def _value(block: dict[str, np.ndarray], side: str, columns: Iterable[int], at: np.ndarray | slice = slice(None)) -> np.ndarray:
    return reduce(np.bitwise_xor, [block[f"{side}{k}"][at] for k in sorted(columns)])


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values, that are bits of hashes, are in the sorted list? A table by their last bits leaves few to be searched for."""
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    last = np.uint64((1 << min(max(len(listed).bit_length() + 4, 12), 24)) - 1)
    marks = np.zeros(int(last) + 1, dtype=bool)
    marks[listed & last] = True
    found = marks[values & last]
    at = np.flatnonzero(found)
    found[at] = listed[np.minimum(np.searchsorted(listed, values[at]), len(listed) - 1)] == values[at]
    return found


def _width(total: int) -> int:
    """Leading bits of a hash that are sent: so many that unlike values seldom have the same."""
    return min(64, total.bit_length() + 24)


def _repeats(rows: DataFrame, sets: Sequence[Columns], stripped: Stripped, size: int, total: int,
             most: int) -> list[tuple[np.ndarray, bool]]:
    """For each of the ``sets`` the leading bits, in order, of values that come twice, and whether these are all. About ``most`` of a
    set are listed. Rows that are alone in a set of ``stripped`` are alone in its supersets and are left out there."""
    width, lead = _width(total), (total // BUCKET_ROWS).bit_length()
    cut, per_bucket = np.uint64(64 - width), max(16, 4 * most >> lead)
    edges = np.arange(1, 1 << lead, dtype=np.uint64) << np.uint64(width - lead)
    sets, known = list(sets), dict(stripped)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK_ROWS):
            shared = {p: _among(_value(block, "a", p) >> cut, listed) for p, listed in known.items()}
            for i, columns in enumerate(sets):
                values = _value(block, "a", columns) >> cut
                parents = [mask for p, mask in shared.items() if p <= columns]
                values = np.sort(values[reduce(np.logical_and, parents)] if parents else values)
                kept = np.ones(len(values), dtype=bool)
                kept[2:] = values[2:] != values[:-2]        # twice is as good as often
                values = values[kept]
                parts = np.split(values, np.searchsorted(values, edges))
                some = [b for b, part in enumerate(parts) if len(part)]
                yield pa.record_batch({"i": pa.array([i] * len(some), type=pa.int32()), "bucket": pa.array(some, type=pa.int32()),
                                       "packed": pa.array([_pack(parts[b]) for b in some], type=pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([_unpack(x) for x in table["packed"].to_pylist()]))
        again = np.unique(values[1:][values[1:] == values[:-1]])
        return pa.table({"i": table["i"][:1], "n": pa.array([len(again)], type=pa.int64()),
                         "again": pa.array([again[:per_bucket].view(np.int64)], type=pa.list_(pa.int64()))})

    packed = rows.mapInArrow(pack, "i int, bucket int, packed binary")
    found = packed.groupBy("i", "bucket").applyInArrow(meet, "i int, n long, again array<long>").where("n > 0")
    out = [(np.zeros(0, dtype=np.uint64), True)] * len(sets)
    for row in found.groupBy("i").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("again")).alias("again")).collect():
        again = np.sort(np.array(row["again"], dtype=np.int64).view(np.uint64))
        out[row["i"]] = (again, len(again) == row["n"])
    return out


def _suspects(rows: DataFrame, sets: Sequence[Columns], listed: Sequence[np.ndarray], size: int, total: int) -> DataFrame:
    """``(i, h1, h2, rid)`` of rows whose value begins with one of the set's listed bits: of those that a task finds with the same
    128 bits, the first and the last in a block."""
    cut = np.uint64(64 - _width(total))
    wanted = [(i, columns, values) for i, (columns, values) in enumerate(zip(sets, listed)) if len(values)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _scan(batches, "ab", rids=True):
            for i, columns, values in wanted:
                at = np.flatnonzero(_among(_value(block, "a", columns) >> cut, values))
                if not len(at):
                    continue
                h1, h2 = (_value(block, side, columns, at) for side in "ab")
                order = np.lexsort((block["rid"][at], h2, h1))
                h1, h2, rid = h1[order], h2[order], block["rid"][at][order]
                new = np.ones(len(at) + 1, dtype=bool)
                new[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                ends = new[1:] | new[:-1]
                yield pa.record_batch({"i": pa.array(np.full(int(ends.sum()), i), type=pa.int32()), **{
                    name: pa.array(x[ends].view(np.int64)) for name, x in (("h1", h1), ("h2", h2), ("rid", rid))}})

    return rows.mapInArrow(find, "i int, h1 long, h2 long, rid long")


def _lone_shares(rows: DataFrame, sets: Sequence[Columns], slices: int) -> list[float]:
    """For each set the share of the rows that are alone with their values, in one slice."""
    sizes = _clusters(rows, sets, slices).groupBy("i", "h1", "h2").count()
    found = {r["i"]: r["lone"] / r["all"] for r in sizes.groupBy("i").agg(
        F.sum(F.when(F.col("count") == 1, 1).otherwise(0)).alias("lone"), F.sum("count").alias("all")).collect()}
    return [found.get(i, 0.0) for i in range(len(sets))]


def _strip(rows: DataFrame, sets: Sequence[Columns], stripped: Stripped, size: int, total: int) -> None:
    """Note the values of the ``sets`` that come twice, if they are few. Rows that are alone in a parent's cluster are left out, so
    a set's clusters are made of its parents'."""
    for columns, (values, complete) in zip(sets, _repeats(rows, sets, stripped, size, total, STRIP_VALUES)):
        if complete and len(values) <= STRIP_VALUES:
            stripped[columns] = values


def _agreements(rows: DataFrame, size: int, total: int, slice_rows: int) -> set[Columns]:
    """Sets of columns on which two rows agree: of neighbours in the orders that begin with each pair of columns. An order is looked
    at in one hash slice of the pair's values, about ``slice_rows`` rows, so clusters of the pair are seen whole."""
    pairs = list(combinations(range(size), 2))
    slices = max(1, total // slice_rows)
    bits = [f"{side}{k}" for k in range(size) for side in "ab"]

    def neighbours(table: pa.Table) -> pa.Table:
        first = pairs[table["i"][0].as_py()]
        values = {name: table[name].to_numpy() for name in bits}
        found = set()
        # Ties of the pair are ordered by the other columns, once from the left and once from the right.
        others = [k for k in range(size) if k not in first]
        for rest in (others, others[::-1]):
            order = np.lexsort([values[f"a{k}"] for k in [*first, *rest][::-1]])
            for step in (1, 2):
                same = np.stack([(values[f"a{k}"][order][step:] == values[f"a{k}"][order][:-step])
                                 & (values[f"b{k}"][order][step:] == values[f"b{k}"][order][:-step]) for k in range(size)], axis=1)
                found |= {"".join("01"[int(x)] for x in mask) for mask in np.unique(same, axis=0)}
        return pa.table({"mask": pa.array(sorted(found), type=pa.string())})

    sliced = _in_slice(rows, [frozenset(p) for p in pairs], slices, lambda _, block, at: {name: block[name][at] for name in bits},
                       ", ".join(f"{name} long" for name in bits))
    masks = sliced.groupBy("i").applyInArrow(neighbours, "mask string").distinct()
    return {frozenset(k for k, x in enumerate(row["mask"]) if x == "1") for row in masks.collect()}


def _refuted(rows: DataFrame, sets: Sequence[Columns], stripped: Stripped, size: int, total: int) -> dict[Columns, set[Columns]]:
    """``_witnesses`` over all rows, which are searched for repeats by packed hashes."""
    repeats = _repeats(rows, sets, stripped, size, total, SUSPECTS)
    if not any(len(values) for values, _ in repeats):
        return {}
    found = _witnesses(rows, sets, _suspects(rows, sets, [values for values, _ in repeats], size, total), size)
    # Should all the listed bits stand for unlike values, and there be more of them, the set's rows are compared one by one.
    unclear = [c for c, (_, complete) in zip(sets, repeats) if not complete and c not in found]
    return found | (_witnesses(rows, unclear, _clusters(rows, unclear), size) if unclear else {})


def _witnesses(rows: DataFrame, sets: Sequence[Columns], clusters: DataFrame, size: int) -> dict[Columns, set[Columns]]:
    """For each of the ``sets`` that has a repeat in the ``clusters`` the columns on which pairs of rows agree, up to ``WITNESSES`` of them."""
    repeated = clusters.groupBy("i", "h1", "h2").agg(
        F.count("*").alias("n"), F.min("rid").alias("x"), F.max("rid").alias("y")).where("n > 1")
    pairs = materialize(repeated.groupBy("i", F.pmod("h2", F.lit(WITNESSES)).alias("part")).agg(
        F.max(F.struct("x", "y")).alias("pair")).select("i", "pair.*"), "witnesses")
    ends = pairs.select(F.explode(F.array("x", "y")).alias("rid")).groupBy(F.shiftright("rid", 17).alias("block")).agg(F.collect_set("rid").alias("rids"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rids = np.array(batch["rids"][i].as_py(), dtype=np.int64)
                block = _loaded(*(batch[c][i].as_py() for c in ("block", "size", "packed")), "ab", False)
                at = rids & (1 << 17) - 1
                values = np.stack([block[f"{side}{k}"][at] for k in range(size) for side in "ab"], axis=1).view(np.int64)
                yield pa.record_batch({"rid": pa.array(rids), "bits": pa.array(list(values), type=pa.list_(pa.int64()))})

    named = materialize(rows.join(broadcast_if_small(ends), "block").mapInArrow(bits, "rid long, bits array<long>"), "witness-rows")
    both = pairs.join(broadcast_if_small(named.select(F.col("rid").alias("x"), F.col("bits").alias("mine"))), "x").join(
        broadcast_if_small(named.select(F.col("rid").alias("y"), F.col("bits").alias("other"))), "y")
    masks = both.select("i", F.zip_with("mine", "other", lambda p, q: p == q).alias("same")).distinct()
    found: dict[Columns, set[Columns]] = {}
    for row in masks.collect():
        found.setdefault(sets[row["i"]], set()).add(frozenset(k for k in range(size) if row["same"][2 * k] and row["same"][2 * k + 1]))
    return found


def _minimal_hitting(known: set[Columns], agreements: Iterable[Columns], size: int, most: int) -> set[Columns]:
    """Of the sets of up to ``most`` columns that no agreement holds the smallest ones; ``known`` are those before it."""
    for agreed in agreements:
        failing = {c for c in known if c <= agreed}
        if not failing:
            continue
        known = known - failing
        grown = {c | {k} for c in failing if len(c) < most for k in range(size) if k not in agreed}
        for c in sorted(grown, key=len):
            if not any(other <= c for other in known):
                known.add(c)
    return known


def _strip_parents(rows: DataFrame, sets: Sequence[Columns], size: int, total: int, slices: int) -> Stripped:
    """Strip by columns and pairs of columns that leave few rows to test for the ``sets``, the smallest parents first."""
    single = [frozenset([k]) for k in range(size)]
    pairs = sorted({frozenset(p) for c in sets if len(c) > 2 for p in combinations(c, 2)}, key=sorted)
    parents = single + pairs
    shares = dict(zip(parents, _lone_shares(rows, parents, slices * (1 + len(parents) // PER_SCAN))))
    chosen: list[Columns] = []
    room: float = STRIP_VALUES
    while True:
        rest = [c for c in sets if not any(p <= c for p in chosen)]
        # What a parent saves: the rows alone in it, for each set but one, which its own test costs.
        saved = {p: shares[p] * sum(p < c for c in rest) - 1 for p in parents
                 if shares[p] >= LONE_SHARE and (1 - shares[p]) * total <= room}
        best = max(saved, key=lambda p: (saved[p], -len(p), sorted(p)), default=None)
        if best is None or saved[best] <= 0:
            break
        chosen.append(best)
        room -= (1 - shares[best]) * total
    stripped: Stripped = {}
    for level in (1, 2):
        some = [p for p in chosen if len(p) == level]
        if some:
            _strip(rows, some, stripped, size, total)
    return stripped


def discover_uccs(df: DataFrame, max_size: int | None = None,
                  columns: Sequence[str] | None = None, slice_rows: int = SLICE_ROWS) -> list[tuple[str, ...]]:
    """All minimal unique column sets with at most ``max_size`` columns, by size and then in column order.

    Every reported set was tested on all rows, and for each of its columns two rows are known that agree on all the others. Each
    round tests the open candidates together, on a slice until none fails there.
    """
    columns = list(columns or df.columns)
    size = len(columns)
    most = min(max_size or size, size)
    rows = _encoded(df, columns)
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if total <= 1:
        return [(c,) for c in columns]
    slices = max(1, total // TEST_ROWS)
    agreements = _agreements(rows, size, total, slice_rows) if size > 1 else set()
    candidates = _minimal_hitting({frozenset([k]) for k in range(size)}, agreements, size, most)
    stripped: Stripped | None = None
    passed: set[Columns] = set()        # on a slice
    proven: set[Columns] = set()        # on all rows
    while candidates - proven:
        sliced = slices > 1 and bool(candidates - passed - proven)
        open_ = sorted(candidates - (passed if sliced else proven), key=lambda c: (len(c), sorted(c)))
        if sliced or slices == 1:
            refuted = _witnesses(rows, open_, _clusters(rows, open_, slices), size)
        else:
            stripped = _strip_parents(rows, open_, size, total, slices) if stripped is None else stripped
            refuted = _refuted(rows, open_, stripped, size, total)
        (passed if sliced else proven).update(c for c in open_ if c not in refuted)
        for found in refuted.values():
            candidates = _minimal_hitting(candidates, found, size, most)
    return [tuple(columns[k] for k in sorted(c)) for c in sorted(candidates, key=lambda c: (len(c), sorted(c)))]


def is_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does no value of the combination occur twice?"""
    return df.groupBy(*columns).count().agg(
        F.coalesce(F.max("count") <= 1, F.lit(True)).alias("is_unique"))


def outcomes(columns: Sequence[str], minimal: Sequence[tuple[str, ...]], max_size: int) -> list[tuple[tuple[str, ...], str]]:
    """How each column set up to ``max_size`` came out: MINIMAL (unique, reported), FALSE (contains a
    smaller unique set, dropped) or EXTENDABLE (not unique, goes on with one more column).
    A test that fails for outside reasons is run again by Spark, so that outcome does not appear."""
    unique = [set(m) for m in minimal]

    def outcome(candidate: tuple[str, ...]) -> str:
        if candidate in minimal:
            return "MINIMAL"
        return "FALSE" if any(m < set(candidate) for m in unique) else "EXTENDABLE"

    return [(c, outcome(c)) for size in range(1, max_size + 1) for c in combinations(columns, size)]
