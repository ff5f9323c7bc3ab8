"""Text and digest expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(column: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 text."""
    return F.sha2(column.cast("string"), 256)


def remove_characters(column: Column, characters: str) -> Column:
    """The text without any of ``characters``."""
    return F.translate(column, characters, "")


def prefixed(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def distinct_letters(column: Column) -> Column:
    """The distinct characters of a text, sorted: a character set for the generators."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(column, ""))), "")


def permutation_at(charset: Column, rank: Column) -> Column:
    """The permutation of ``charset`` with lexicographic number ``rank`` (from 0).

    Works in the factorial number system with 64-bit ranks, so up to 20
    characters; NULL for a rank outside 0 … n!-1.
    """
    size = F.length(charset)

    def pick(state: Column, left: Column) -> Column:
        weight = F.factorial(left - 1)
        # exact integer quotient: the remainder is taken off first
        index = ((state["code"] - state["code"] % weight) / weight).cast("int")
        return F.struct(
            F.concat(state["word"], F.substring(state["rest"], index + 1, F.lit(1))).alias("word"),
            F.concat(
                F.substring(state["rest"], F.lit(1), index),
                F.substring(state["rest"], index + 2, size),
            ).alias("rest"),
            (state["code"] % weight).alias("code"),
        )

    start = F.struct(F.lit("").alias("word"), charset.alias("rest"), rank.cast("long").alias("code"))
    word = F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), start, pick, lambda s: s["word"])
    return F.when(size == 0, F.when(rank == 0, F.lit(""))).when(
        (rank >= 0) & (rank < F.factorial(size)), word
    )


SHORT = 256


def _common_substring(left: str, right: str) -> str:
    """Longest common substring; among equals the smallest. Whoever shares a
    piece of length k shares one of length k-1, so the length can be bisected."""
    short, long = sorted((left, right), key=len)
    shared = _shared_pieces(short, long) if len(long) <= SHORT else _shared_pieces_by_name(short, long)
    low, high = 0, len(short)
    while low < high:
        middle = (low + high + 1) // 2
        if shared(middle):
            low = middle
        else:
            high = middle - 1
    return min((short[i:i + low] for i in shared(low)), default="") if low else ""


def _shared_pieces(short: str, long: str) -> Callable[[int], list[int]]:
    """length -> positions in ``short`` whose piece of that length occurs in ``long``."""

    def shared(length: int) -> list[int]:
        pieces = {long[i:i + length] for i in range(len(long) - length + 1)}
        return [i for i in range(len(short) - length + 1) if short[i:i + length] in pieces]

    return shared


def _shared_pieces_by_name(short: str, long: str) -> Callable[[int], list[int]]:
    """The same for long texts, without making the pieces.

    Every piece whose length is a power of two gets a number, equal pieces the same one: a piece
    is a pair of numbers of half its length. A piece of any length is the pair of its overlapping
    first and last power of two (Karp, Miller and Rosenberg 1972).
    """
    points = np.array([ord(c) for c in short] + [-1] + [ord(c) for c in long])
    names = [np.unique(points, return_inverse=True)[1]]

    def pairs(size: int, shift: int) -> np.ndarray:
        name = names[size]
        return name[:len(name) - shift] * np.int64(len(points)) + name[shift:]

    while 2 << len(names) - 1 <= len(short):
        names.append(np.unique(pairs(len(names) - 1, 1 << len(names) - 1), return_inverse=True)[1])

    def shared(length: int) -> list[int]:
        size = length.bit_length() - 1
        keys = pairs(size, length - (1 << size))
        mine = keys[:len(short) - length + 1]
        theirs = keys[len(short) + 1:len(points) - length + 1]
        return np.flatnonzero(np.isin(mine, theirs)).tolist()

    return shared


@F.pandas_udf(T.StringType())
def longest_common_substring(left: pd.Series, right: pd.Series) -> pd.Series:
    """Pairwise longest common substring of two columns; NULL if either is NULL."""
    return pd.Series([
        None if a is None or b is None else _common_substring(a, b) for a, b in zip(left, right)
    ], dtype=object)
