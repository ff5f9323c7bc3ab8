"""Joins with checked broadcasts and linear forms of the self joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.session import materialize

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
HOT_ROWS = 2_000_000
HOT_SAMPLE = 0.01


def _row_bytes(df: DataFrame) -> Column:
    """Size of a row: 8 bytes per value and whatever text, lists and the like add."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it was counted and found small; else ask for a merge join."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df.hint("merge")


def is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Are there few enough rows and bytes to send to every executor? Both are summed up by an
    aggregate, since planner estimates do not see how many rows an ``explode`` makes."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return rows <= (max_rows or MAX_BROADCAST_ROWS) and size <= (max_bytes or MAX_BROADCAST_BYTES)


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                hot: DataFrame | None = None) -> DataFrame:
    """Join to a side with at most one row per key; ``how`` is inner, left, left_semi or left_anti.

    A small right side is broadcast. Otherwise rows are shuffled, and a key that holds more than ``HOT_ROWS``
    rows of the left side would end in one task; AQE looks at compressed bytes and
    can miss it. There are few such keys, and one right row for each: that part is joined
    by broadcast, the rest by a merge join. Rows with a null key match nothing and are not shuffled.

    ``hot`` names the hot keys if the caller knows them; else the left keys of a sample are counted.
    """
    on = list(on)
    right = materialize(right, "lookup")    # it is counted, and then joined once or twice
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    if hot is None:
        # A sample is enough: the answer decides how the rows travel, not which rows there are.
        part = left.select(*on).sample(HOT_SAMPLE, 7) if HOT_ROWS * HOT_SAMPLE >= 100 else left
        least = HOT_ROWS * HOT_SAMPLE if part is not left else HOT_ROWS
        hot = part.groupBy(*on).count().where(F.col("count") > least).select(*on)
    hot = materialize(hot.dropna(), "hot-keys")
    if hot.isEmpty():
        parts = [_keyed(left, on).join(right.hint("merge"), on, how)]
    else:
        keys = broadcast_if_small(hot)
        hot_right = materialize(right.join(keys, on, "left_semi"), "hot-rows")
        parts = [
            left.join(keys, on, "left_semi").join(broadcast_if_small(hot_right), on, how),
            _keyed(left, on).join(keys, on, "left_anti").join(right.hint("merge"), on, how),
        ]
    if how in ("left", "left_anti"):
        unmatched = left.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on]))
        wanted = parts[0].schema
        parts.append(unmatched.select(*[
            F.col(f.name) if f.name in left.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wanted.fields]))
    return reduce(DataFrame.unionByName, parts)


def _keyed(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(on))


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``listed``."""
    return lookup_join(df, listed.select(key).distinct(), [key], "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``listed``; null keys stay."""
    return lookup_join(df, listed.select(key).distinct(), [key], "left_anti")


def others_with_same_key(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Self join ``a.key = b.key and a.id <> b.id`` without its pairs: for each row with a
    partner, how many partners it has and the id of one of them (the smallest id of the
    key; for that row itself the greatest). Ids must be unique within a key.
    """
    ends = materialize(df.groupBy(key).agg(
        F.count("*").alias("rows"), F.min(ident).alias("first"), F.max(ident).alias("last")
    ).where("rows > 1"), "ends")
    hot = ends.where(F.col("rows") > HOT_ROWS).select(key)
    return lookup_join(df.select(key, ident), ends, [key], hot=hot).select(
        ident, key, (F.col("rows") - 1).alias("partners"),
        F.when(F.col(ident) == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("partner"),
    )


def pair_with_latest(df: DataFrame, key: str, order: Sequence[str], ident: str,
                     columns: Sequence[str]) -> DataFrame:
    """Each row beside the latest *other* row of its key, as structs ``a`` and ``b``:
    one partner per row, so the result is as long as the input."""
    row = F.struct(*columns)
    latest = materialize(df.groupBy(key).agg(
        F.max_by(row, F.struct(*order, ident)).alias("b"), F.count("*").alias("rows")), "latest")
    hot = latest.where(F.col("rows") > HOT_ROWS).select(key)
    return lookup_join(df.select(key, row.alias("a")), latest.drop("rows"), [key], hot=hot).where(
        F.col(f"a.{ident}") != F.col(f"b.{ident}")
    ).select("a", "b")


def match_digests(candidates: DataFrame, wanted: DataFrame, digest: str) -> DataFrame:
    """Candidates whose digest is wanted, each once however often it is wanted."""
    return keep_listed(candidates, wanted, digest)


def with_membership(df: DataFrame, listed: DataFrame, key: str, name: str = "listed") -> DataFrame:
    """``df`` with a flag: does the row's key occur in ``listed``? False for a null key."""
    marks = listed.select(key).distinct().withColumn(name, F.lit(True))
    return lookup_join(df, marks, [key], "left").withColumn(name, F.coalesce(name, F.lit(False)))
