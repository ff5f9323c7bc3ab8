"""A Merkle manifest of a dataset: a hash tree of fan-out three over each group of rows, one over the groups, and every row's proof.

The nodes of a level stand in the rows of their first leaves. Per level, lag and lead columns with the level's fixed offset, masked by
the node's slot and by the length of its run, are its siblings, and the rows of first children hash the parents. All levels of
a block of leaves share one window; the blocks' roots are the leaves of the next round, so no window holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.llm.common import materialize, row_column, with_new_columns
from dataprobe.operators.joins import lookup_join

FAN = 3
#: Levels that are built in one window: 3^7 = 2,187 leaves, which the window keeps in memory.
BLOCK_LEVELS = 7
DIGEST = 64


def content_digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value itself, so that
    no two different rows give the same bytes."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 on within the group by ``order``, and ``n``, the group's rows.

    A group of any size is dealt over many tasks: rows are range partitioned, each task counts its own, and what the tasks before
    hold of the group is added. ``group`` must not be null.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("task", F.shiftright("at", 33))
    runs = ordered.groupBy(group, "task").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return lookup_join(ordered, runs, [group, "task"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _slot(level: int) -> str:
    """The place of the row's node of a level within its run."""
    return f"CAST(pos div {FAN ** level} % {FAN} AS INT)"


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (``g``, ``pos``, ``n``, ``digest``) with ``block`` and, in the rows of first leaves, the siblings of the node of each
    level and the block's root. Written down."""
    size = FAN ** levels
    found = nodes.selectExpr("*", f"floor(pos / {size}) AS block", "digest AS d0")
    over = "OVER (PARTITION BY g, block ORDER BY pos)"
    for level in range(levels):
        step, own, slot = FAN ** level, f"d{level}", _slot(level)
        found = found.selectExpr("*", *[f"{side}({own}, {k * step}) {over} AS {side}{k}" for side in ("lag", "lead") for k in (1, 2)])
        left = [f"if({slot} >= {k}, lag{k}, '')" for k in (2, 1)]
        right = [f"if({slot} + {k} < {FAN} AND pos + {k * step} < n, lead{k}, '')" for k in (1, 2)]
        live = f"n > {step} AND pos % {step} = 0"       # a node of this level that isn't the only one
        found = found.selectExpr(
            "*", f"CASE WHEN {live} THEN concat({', '.join(left + right)}) END AS siblings{level}",
            f"CASE WHEN {live} AND {slot} = 0 THEN sha2(concat({own}, {', '.join(right)}), 256) END AS d{level + 1}",
        ).drop("lag1", "lag2", "lead1", "lead2")
    roots = F.coalesce(*[F.col(f"d{level}") for level in range(levels, -1, -1)])
    found = found.withColumn("top", F.when(F.col("pos") % size == 0, roots))
    return materialize(found.drop(*[f"d{level}" for level in range(levels + 1)]), "merkle-blocks")


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks, as nodes."""
    return blocks.where("top IS NOT NULL").select(
        "g", F.col("block").alias("pos"), F.ceil(F.col("n") / FAN ** levels).alias("n"), F.col("top").alias("digest"))


def _paths(blocks: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """The rows of ``blocks`` with ``path``, from their own level up, after which ``upper`` (``g``, ``block``, ``above`` and what
    else it has) goes on."""
    over = "OVER (PARTITION BY g, block ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    filled = blocks.join(upper.hint("merge"), ["g", "block"]).selectExpr(
        "*", *[f"last_value(siblings{level}) IGNORE NULLS {over} AS s{level}" for level in range(levels)])
    steps = ", ".join(f"named_struct('slot', {_slot(level)}, 'siblings', s{level})" for level in range(levels))
    return filled.withColumn("path", F.expr(f"concat(filter(array({steps}), x -> x.siblings IS NOT NULL), above)")).drop(
        "top", "above", *[f"{name}{level}" for level in range(levels) for name in ("s", "siblings")])


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``path`` and ``peak``, the root of their group."""
    if nodes.where("n > 1").isEmpty():
        return nodes.select("*", F.col("digest").alias("peak"), F.array().cast("array<struct<slot:int,siblings:string>>").alias("path"))
    blocks = _blocks(nodes, levels)
    upper = _climb(_tops(blocks, levels), levels).select(
        "g", F.col("pos").alias("block"), "peak", F.col("path").alias("above"))
    return _paths(blocks, upper, levels)


def manifest(docs: DataFrame, group: str, key: str, digest: Column, levels: int = BLOCK_LEVELS, **carried: Column) -> DataFrame:
    """``docs`` reduced to ``row`` (the ``carried`` columns as a struct), ``leaf``, ``subroot``, ``root`` and ``path``.

    A row's leaf is its ``digest``. Per ``group`` the leaves ascend by ``key``; every three neighbours (the last run may be shorter,
    even one) are hashed to a node of the next level, until one node remains: the subroot (a lone leaf is its own). Subroots,
    in the order of their groups, give the root in the same way. ``path`` lists for each level, from the leaf to the root, the slot of
    the row's node in its run and the run's other digests from left to right.

    A null group is one of its own and comes first, a null key comes first within its group. Rows that share a key are ordered by
    their digests; rows that share both are alike, but each has a place of its own. An empty table gives no rows.
    """
    carried_row = F.struct(*[value.alias(name) for name, value in carried.items()]) if carried else row_column(docs)
    rows = docs.select(carried_row.alias("row"), F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),
                       F.col(f"`{key}`").alias("key"), digest.alias("digest"), F.monotonically_increasing_id().alias("tie"))
    nodes = numbered(rows, "g", ["key", "digest", "tie"]).drop("key", "tie")
    blocks = _blocks(nodes, levels)
    upper = materialize(_climb(_tops(blocks, levels), levels).select("g", F.col("pos").alias("block"), "path", "peak"), "merkle-upper")
    subroots = upper.where("block = 0").select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("peak").alias("digest"))
    tops = numbered(subroots, "all", ["name"]).withColumnRenamed("all", "g")
    tops = _climb(tops, levels).select(F.col("name").alias("g"), F.col("path").alias("rest"), F.col("peak").alias("root"))
    upper = lookup_join(upper, tops, ["g"]).select(
        "g", "block", F.concat("path", "rest").alias("above"), F.col("peak").alias("subroot"), "root")
    return _paths(blocks, upper, levels).select("row", F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: x["siblings"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of its ``path`` give."""
    def up(digest: Column, x: Column) -> Column:
        cut = x["slot"] * DIGEST
        return F.sha2(F.concat(x["siblings"].substr(F.lit(1), cut), digest, x["siblings"].substr(cut + 1, F.lit(FAN * DIGEST))), 256)

    return F.aggregate(path, leaf, up)


def with_manifest(docs: DataFrame, group: str, key: str, columns: Sequence[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """``docs`` with ``leaf`` (the digest of ``columns``), ``subroot``, ``root`` and ``path``, see ``manifest``. Columns of ``docs``
    that have these names are replaced."""
    found = manifest(docs, group, key, content_digest(*[F.col(f"`{c}`") for c in columns]), levels)
    return found.select(*with_new_columns(docs.columns, "row", **{c: F.col(c) for c in ("leaf", "subroot", "root", "path")}))
