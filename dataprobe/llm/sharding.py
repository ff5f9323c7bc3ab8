"""Sharding by histogram sort, with DataFrame functions only.

The order of the rows is that of the key (MD5 of the text, then MD5 of the id). Counts of bytes below candidate key
boundaries are summed over all partitions, and the cells in which a wanted splitter lies are counted again on a finer
grid, until each splitter is known. Then every row moves once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dataprobe.llm.common import inline_table, materialize, row_column, with_new_columns

#: Keys are two numbers of 60 bits, read in five digits of 12 bits: 4,096 boundaries are tried in each cell.
DIGIT = 12
LAST = (1 << 60) - 1
#: The exchange moves cells of about this share of all bytes, so the number of cells is bounded.
CELLS = 1024


def _key(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class _Cell:
    """Keys that share their first digits: of the first number, or (``k1`` given) of the second at that first number."""

    prefix: int
    depth: int
    k1: int | None = None
    start: int = 0
    size: int = 0
    low: tuple[int, int] = (0, 0)
    high: tuple[int, int] = (0, 0)

    @property
    def before(self) -> tuple[int, int]:
        """The greatest possible key below the cell."""
        first = self.prefix << (60 - DIGIT * self.depth)
        return (first - 1, LAST) if self.k1 is None else (self.k1, first - 1)

    @property
    def end(self) -> tuple[int, int]:
        """The greatest possible key in the cell."""
        last = ((self.prefix + 1) << (60 - DIGIT * self.depth)) - 1
        return (last, LAST) if self.k1 is None else (self.k1, last)


def _count(keys: DataFrame, cells: list[_Cell]) -> list[_Cell]:
    """The cells one digit below ``cells`` (all of one depth and kind) that hold rows, in key order, with exact bytes."""
    depth, nested = cells[0].depth, cells[0].k1 is not None
    number = F.col("k2" if nested else "k1")
    parent = F.shiftright(number, 60 - DIGIT * depth)
    k1 = F.col("k1") if nested else F.lit(None).cast("long")
    wanted = keys
    if depth or nested:
        tags = sorted({c.k1 if nested else c.prefix for c in cells})
        wanted = keys.where((F.col("k1") if nested else parent).isin(tags))
        if nested and depth:
            wanted = wanted.where(parent.isin(sorted({c.prefix for c in cells})))
    found = wanted.groupBy(k1.alias("at"), F.shiftright(number, 60 - DIGIT * (depth + 1)).alias("prefix")).agg(
        F.sum("size").alias("size"), F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
    children: dict[tuple, list] = {}
    for r in found.collect():           # at most 4,096 rows for each cell
        children.setdefault((r["at"], r["prefix"] >> DIGIT), []).append(r)
    out = []
    for cell in cells:
        start = cell.start
        for r in sorted(children.get((cell.k1, cell.prefix), []), key=lambda r: r["prefix"]):
            out.append(_Cell(r["prefix"], depth + 1, cell.k1, start, r["size"], tuple(r["low"]), tuple(r["high"])))
            start += r["size"]
    return out


def _splitters(keys: DataFrame, first: list[_Cell], wanted: list[int], tolerance: int, whole: int) -> dict[int, tuple]:
    """For each wanted number of bytes ``t`` the key after which to cut: that of the last unit with fewer than ``t``
    bytes before it. A cut may be off by ``tolerance`` bytes; a text with at most ``whole`` bytes in all its
    copies is not cut."""
    cuts: dict[int, tuple] = {}
    open_: list[tuple[_Cell, list[int]]] = _holding(first, wanted)
    while open_:
        again: dict[tuple, list[tuple[_Cell, list[int]]]] = {}
        for cell, targets in open_:
            one_text = cell.low[0] == cell.high[0]
            if cell.low == cell.high or (one_text and cell.k1 is None and cell.size <= whole):
                cuts |= {t: (cell.low[0], LAST) if one_text and cell.k1 is None and cell.size <= whole else cell.high
                         for t in targets}
            elif cell.size <= tolerance:
                cuts |= {t: cell.end for t in targets}
            else:
                if one_text and cell.k1 is None:
                    cell = replace(cell, prefix=0, depth=0, k1=cell.low[0])
                again.setdefault((cell.depth, cell.k1 is not None), []).append((cell, targets))
        open_ = []
        for group in again.values():
            below = _count(keys, [cell for cell, _ in group])
            open_ += _holding(below, [t for _, targets in group for t in targets])
    return cuts


def _holding(cells: list[_Cell], wanted: list[int]) -> list[tuple[_Cell, list[int]]]:
    out = []
    for cell in cells:
        inside = [t for t in wanted if cell.start < t <= cell.start + cell.size]
        if inside:
            out.append((cell, inside))
    return out


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id",
                    whole_share: float = 0.01, cells: int = CELLS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 8), ``shard`` from 0 and ``slot`` (gapless from 0 in the
    shard); columns of these names are replaced. Shards hold nearly equal bytes.

    A text goes to the shard in which its first byte lies when all rows stand in key order, so all its copies stay
    together; only where the copies of a text take over ``whole_share`` of a shard, each row (rows with the same text and
    the same id as one) is placed by its own first byte. So a shard differs from the mean by at most that
    share and one unit, however large a group of copies is. Null texts count as empty, null ids as one id. An empty
    table gives no rows.

    Splitters are exact. Sums for at most 4,096 candidate boundaries in each open cell reach the driver; there is at
    most one open cell for each splitter and round.
    """
    spark = docs.sparkSession
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = {"k1": _key(body), "k2": _key(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))),
             "size": F.octet_length(body).cast("long") + 8}
    keys = materialize(docs.select(*[value.alias(name) for name, value in names.items()]), "shard-keys")
    grid = _count(keys, [_Cell(0, 0)])
    total = sum(c.size for c in grid)
    bounds = [-(-j * total // shards) for j in range(1, shards)]
    step = max(total // cells, 1)
    heavy = [c for c in grid if c.size > 2 * step]
    fine = [t for c in heavy for t in range(c.start + step, c.start + c.size, step)]
    cuts = _splitters(keys, grid, bounds, 0, int(total / shards * whole_share))
    inner = set(cuts.values()) | set(_splitters(keys, heavy, fine, step // 2, 0).values())
    placed = _place(spark, docs.select(row_column(docs).alias("row"), *[v.alias(k) for k, v in names.items()]), inner)
    counted = _place(spark, keys, inner).groupBy("cell").agg(
        F.count("*").alias("rows"), F.max(F.struct("k1", "k2")).alias("last"))
    ends = sorted(cuts.values())
    table, offsets = [], [0] * shards
    for r in sorted(counted.collect(), key=lambda r: r["cell"]):        # the cells are bounded in number
        shard = sum(end < tuple(r["last"]) for end in ends)
        table.append({"cell": r["cell"], "shard": shard, "offset": offsets[shard]})
        offsets[shard] += r["rows"]
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("cell").orderBy("k1", "k2")))
    placed_cells = inline_table(spark, table, "cell:int,shard:int,offset:long")
    return numbered.join(F.broadcast(placed_cells), "cell").select(*with_new_columns(
        docs.columns, "row", size=F.col("size"), shard=F.col("shard"),
        slot=(F.col("offset") + F.col("number") - 1)))


def _place(spark: SparkSession, rows: DataFrame, cuts: set[tuple]) -> DataFrame:
    """Add ``cell``: the number of grid boundaries and cuts below the key. The table has one row for each of the 4,096
    first digits, with the cuts that lie in it."""
    by_digit: dict[int, list] = {}
    for cut in sorted(cuts):
        by_digit.setdefault(cut[0] >> (60 - DIGIT), []).append({"a": cut[0], "b": cut[1]})
    table, number = [], 0
    for digit in range(1 << DIGIT):
        inside = by_digit.get(digit, [])
        table.append({"digit": digit, "base": number, "cuts": inside})
        number += 1 + len(inside)
    grid = inline_table(spark, table, "digit:long,base:int,cuts:array<struct<a:long,b:long>>")
    key = F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"))
    return rows.withColumn("digit", F.shiftright("k1", 60 - DIGIT)).join(F.broadcast(grid), "digit").withColumn(
        "cell", (F.col("base") + F.size(F.filter("cuts", lambda c: c < key))).cast("int")).drop("digit", "base", "cuts")
