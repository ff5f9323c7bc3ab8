"""Projections, predicates, aggregates and top-k queries shared by many reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.session import materialize


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` as ``schema``: the named columns, in that order, cast to those types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def rename_all(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def with_constants(df: DataFrame, columns: Sequence[str], **constants: object) -> DataFrame:
    return df.select(*columns, *[F.lit(v).alias(k) for k, v in constants.items()])


def keep_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def keep_not_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Rows whose value is not listed; a null is not listed either, so it stays."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def explode_rest(df: DataFrame, items: str, element: str = "element", rest: str = "rest") -> DataFrame:
    """Each element of an array with the other elements beside it."""
    others = [c for c in df.columns if c != items]
    return df.select(*others, items, F.explode(items).alias(element)).select(
        *others, element, F.array_remove(items, F.col(element)).alias(rest)
    )


def keep_nonempty(df: DataFrame, items: str) -> DataFrame:
    return df.where(F.size(items) > 0)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def joined_values(df: DataFrame, keys: Sequence[str], column: str, separator: str,
                  name: str, distinct: bool = False) -> DataFrame:
    """The values of ``column`` per key, ascending, joined into one text; each as often as it occurs,
    or once with ``distinct``. Nulls are left out.

    Equal values are counted in a hash aggregate before anything is collected, so a list
    holds one entry per distinct value. The text itself is as long as the values of its key: for a
    whole column write sorted lines instead (``sinks.write_lines``).
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(column).alias("value"), F.col("count").cast("int").alias("times"))))
    times = (lambda x: F.lit(1)) if distinct else (lambda x: x["times"])
    texts = F.flatten(F.transform("items", lambda x: F.array_repeat(x["value"].cast("string"), times(x))))
    return (
        df.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
        .groupBy(*keys).agg(items.alias("items"))
        .select(*keys, F.array_join(texts, separator).alias(name))
    )


def top_per_group(df: DataFrame, group: str, measure: str, label: str) -> DataFrame:
    """Per group the row with the greatest measure (then the smallest label); no group is
    ever held as a list, each task sends one row per group. A null measure comes after all others, so a
    group with nothing else keeps its row with the smallest label."""
    order = F.struct(F.col(measure).isNull(), F.negative(measure), F.col(label))
    return df.groupBy(group).agg(F.min_by(F.struct(label, measure), order).alias("best")).select(
        group, f"best.{label}", f"best.{measure}")


def longest_per_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """The longest text per key; among equals the smallest."""
    return df.groupBy(key).agg(F.min_by(text, F.struct(-F.length(text), F.col(text))).alias(text))


def set_intersection_per_key(df: DataFrame, key: str, items: str) -> DataFrame:
    """What all the arrays of a key have in common, sorted; a null array has no items, null items don't count.

    Pairs of key and item are counted against the arrays of the key: two aggregates that combine on the
    map side. What is collected per key is no longer than its shortest array.
    """
    arrays = materialize(df.groupBy(key).agg(F.count("*").alias("arrays")), "arrays")
    pairs = df.select(F.col(key).alias("pair_key"), F.explode(F.array_distinct(items)).alias("item")).groupBy(
        "pair_key", "item").agg(F.count("*").alias("held")).where("item IS NOT NULL")
    shared = pairs.join(arrays, (F.col("pair_key").eqNullSafe(F.col(key))) & (F.col("held") == F.col("arrays")))
    found = shared.groupBy("pair_key").agg(F.sort_array(F.collect_list("item")).alias(items)).withColumn("any", F.lit(True))
    none = F.array().cast(df.schema[items].dataType)
    return arrays.join(found, F.col("pair_key").eqNullSafe(F.col(key)), "left").select(
        key, F.when(F.col("any"), F.col(items)).otherwise(none).alias(items))


def count_if_all(df: DataFrame, **conditions: Column) -> DataFrame:
    """Any number of conditional counts in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def observe_counts(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The same counts as a by-product of whatever action runs on the returned frame."""
    observation = Observation()
    return df.observe(observation, *[F.count_if(c).alias(n) for n, c in conditions.items()]), observation


def max_or_zero(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias(name))


def top_k(df: DataFrame, measure: str, tie_break: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(tie_break)).limit(k)
