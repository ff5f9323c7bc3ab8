"""Unary inclusion dependencies: which column's values all occur in which other column.

Every cell becomes a row ``(value, attribute)``. One hash aggregate turns each
distinct value into the bit mask of the attributes that hold it; few distinct
masks remain, and a column A is included in B when every mask with bit A also has bit B.
Both aggregates combine on the map side, so a value that fills a third of all
cells still sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
LONG_TEXT = 64


def attribute_names(tables: Mapping[str, DataFrame]) -> list[str]:
    """``table.column`` for every column, in the order that numbers the mask bits."""
    return [f"{name}.{column}" for name, df in tables.items() for column in df.columns]


def unpivot_cells(
    df: DataFrame, columns: Sequence[str], labels: Sequence[object], cell_type: T.DataType,
    value: str = "value", attribute: str = "attribute",
) -> DataFrame:
    """One row per non-null cell: ``(value, attribute)``, values cast to ``cell_type``."""
    cells = F.array(*[
        F.struct(F.col(f"`{c}`").cast(cell_type).alias(value), F.lit(label).alias(attribute))
        for c, label in zip(columns, labels)
    ])
    return (
        df.select(F.explode(cells).alias("cell"))
        .select(f"cell.{value}", f"cell.{attribute}")
        .where(F.col(value).isNotNull())
    )


def _family(data_type: T.DataType) -> T.DataType:
    """The type cells are grouped by before they become text."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()  # same text for every width
    if isinstance(data_type, (T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return data_type
    return T.StringType()


def _word_columns(count: int) -> list[str]:
    return [f"mask{w}" for w in range((count + WORD - 1) // WORD)]


def _bits(words: Sequence[str]) -> list[Column]:
    bit = F.expr(f"shiftleft(1L, attribute % {WORD})")
    if len(words) == 1:
        return [bit.alias(words[0])]
    return [
        F.when(F.expr(f"attribute div {WORD} = {w}"), bit).otherwise(F.lit(0).cast("long")).alias(name)
        for w, name in enumerate(words)
    ]


def value_masks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(text, mask0, mask1, …)``: each distinct value with the attributes that hold it.

    Numbers, dates and timestamps are first aggregated in their own type: the
    keys are narrow, and only distinct values are turned into text. Text over
    64 characters is keyed by its SHA-256 digest, so that rows stay small; a key
    of that kind is longer than any short text and cannot be mistaken for one.
    """
    words = _word_columns(len(attribute_names(tables)))
    families: dict[T.DataType, list[DataFrame]] = {}
    first = 0
    for df in tables.values():
        by_family: dict[T.DataType, list[tuple[str, int]]] = {}
        for offset, field in enumerate(df.schema.fields):
            by_family.setdefault(_family(field.dataType), []).append((field.name, first + offset))
        for family, members in by_family.items():
            columns, labels = zip(*members)
            families.setdefault(family, []).append(unpivot_cells(df, columns, labels, family))
        first += len(df.columns)

    merged = []
    for family, parts in families.items():
        cells = reduce(DataFrame.unionByName, parts)
        masks = cells.select("value", *_bits(words))
        if isinstance(family, T.StringType):
            text = F.when(F.length("value") <= LONG_TEXT, F.col("value")).otherwise(
                F.concat(F.lit("#"), F.sha2("value", 256))
            )
        else:
            masks = masks.groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
            text = F.col("value").cast("string")
        merged.append(masks.select(text.alias("text"), *words))
    return reduce(DataFrame.unionByName, merged).groupBy("text").agg(
        *[F.bit_or(w).alias(w) for w in words]
    )


def _has_bit(words: Sequence[str], attribute: Column) -> Column:
    word = F.element_at(F.array(*words), F.shiftright(attribute, 6) + 1)
    return F.getbit(word, attribute % WORD) == 1


def attribute_sets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(text, attributes)``: the sorted names of the columns that hold each distinct value."""
    names = attribute_names(tables)
    words = _word_columns(len(names))
    every, name_list = F.sequence(F.lit(0), F.lit(len(names) - 1)), F.array(*[F.lit(n) for n in names])
    held = F.filter(every, lambda a: _has_bit(words, a))
    return value_masks(tables).select(
        "text", F.array_sort(F.transform(held, lambda a: F.element_at(name_list, a + 1))).alias("attributes"))


def discover_inds(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All pairs ``(dep, ref)`` of different columns with values(dep) ⊆ values(ref).

    Nulls are ignored; a column without any value appears on neither side.
    Values are compared as text, each column keeping its own type's text form.
    """
    names = attribute_names(tables)
    words = _word_columns(len(names))
    patterns = value_masks(tables).groupBy(*words).agg(F.lit(1).alias("seen"))

    def has(attribute: Column) -> Column:
        return _has_bit(words, attribute)

    every = F.sequence(F.lit(0), F.lit(len(names) - 1))
    common = (
        patterns.select(F.explode(F.filter(every, has)).alias("attribute"), *words)
        .groupBy("attribute")
        .agg(*[F.bit_and(w).alias(w) for w in words])
    )
    name_list = F.array(*[F.lit(n) for n in names])
    return (
        common.select("attribute", F.explode(F.filter(every, has)).alias("other"))
        .where("attribute <> other")
        .select(
            F.element_at(name_list, F.col("attribute") + 1).alias("dep"),
            F.element_at(name_list, F.col("other") + 1).alias("ref"),
        )
    )


def ind_report(inds: DataFrame) -> DataFrame:
    """One line per dependent column, ``dep < ref1, ref2``; the lists are bounded by the columns."""
    return (
        inds.groupBy("dep").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
        .select("dep", F.concat_ws(" < ", "dep", F.array_join("refs", ", ")).alias("line"))
    )
