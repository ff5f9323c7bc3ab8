"""Algebra on sets of non-negative integers, each a one-column DataFrame ``id``.

The two-set operations share one table, ``membership``: each id with a flag for
the sides that hold it. It costs one shuffle of ids already deduplicated per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.session import materialize

IN_A, IN_B, IN_BOTH = 1, 2, 3
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
CAPACITY = 1 << 32


def membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, sides)`` with sides 1 (only a), 2 (only b) or 3 (both)."""
    return (
        a.select("id", F.lit(IN_A).alias("side"))
        .unionByName(b.select("id", F.lit(IN_B).alias("side")))
        .where("id is not null").groupBy("id").agg(F.bit_or("side").alias("sides"))
    )


def set_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).where(f"sides = {IN_BOTH}").select("id")


def set_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).select("id")


def set_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).where(f"sides <> {IN_BOTH}").select("id")


def set_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return membership(a, b).where(f"sides = {IN_A}").select("id")


def intersects(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do the sets have an element in common?"""
    return membership(a, b).agg(
        F.coalesce(F.bool_or(F.col("sides") == IN_BOTH), F.lit(False)).alias("intersects"))


def set_equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do the sets have the same elements?"""
    return membership(a, b).agg(
        F.coalesce(F.bool_and(F.col("sides") == IN_BOTH), F.lit(True)).alias("equal"))


def logical_length(a: DataFrame) -> DataFrame:
    """One row: the greatest id plus one, 0 for the empty set."""
    return a.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("length"))


def to_bitmaps(a: DataFrame) -> DataFrame:
    """Packed form: one bitmap per 32,768 ids."""
    return a.where("id is not null").groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets held by one side only have an empty intersection and drop out."""
    return (
        a.unionByName(b).groupBy("bucket")
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides"))
        .where("sides = 2").select("bucket", "bits")
    )


def fill_range(a: DataFrame, low: int, high: int) -> DataFrame:
    """The set with every id in [low, high) added; ``high = low + 1`` sets one bit."""
    return set_or(a, a.sparkSession.range(low, high))


def clear_range(a: DataFrame, low: int, high: int) -> DataFrame:
    """The set without the ids in [low, high)."""
    return a.where((F.col("id") < low) | (F.col("id") >= high)).distinct()


def flip_range(a: DataFrame, low: int, high: int) -> DataFrame:
    """Ids in [low, high) change sides."""
    return set_xor(a, a.sparkSession.range(low, high))


def random_set(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The keys of ``df`` whose seeded hash falls below ``share``; stable under re-runs."""
    return df.where(hash_draw(key, seed) < int(share * (1 << 32))).select(F.col(key).alias("id"))


def hash_draw(key: str, seed: int) -> Column:
    """A number of 32 bits for each key, the same in every run: the first digits of a SHA-256."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def _nearest(probes: DataFrame, a: DataFrame, step: int, span: int) -> DataFrame:
    """``(probe, found)`` with the nearest id at or after (step 1) or before (step -1) each probe.

    Ids are cut into blocks of 65,536 numbers. Within a block a window looks at
    distinct ids and probes only, so it never sees more than two blocks' worth
    of rows however skewed the input is. Probes without an answer in
    their block ask for the nearest occupied block: the same problem, with 65,536 times smaller numbers.
    """
    pick, order = (F.min, F.desc("id")) if step > 0 else (F.max, F.asc("id"))
    # towards the probe, so that the window runs on instead of starting over at each row
    frame = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    marks = (
        probes.select(F.col("probe").alias("id"), F.lit(IN_A).alias("kind"))
        .unionByName(a.select(F.col("id").cast("long").alias("id"), F.lit(IN_B).alias("kind")))
        .where("id is not null").groupBy("id").agg(F.bit_or("kind").alias("kind"))
    )
    member = F.when(F.col("kind") >= IN_B, F.col("id"))
    near = (
        marks.withColumn("block", block)
        .withColumn("found", F.last(member, ignorenulls=True).over(frame))
        .where(F.col("kind") != IN_B)
        .select(F.col("id").alias("probe"), "block", "found")
    )
    if span <= BLOCK:
        return near.select("probe", "found")
    # both are used twice; written down they are computed once
    near = materialize(near, "near")
    edges = materialize(a.where("id is not null").groupBy(block).agg(pick("id").cast("long").alias("edge")), "edges")
    far_blocks = near.where("found is null").select((F.col("block") + step).alias("probe")).distinct()
    jumps = _nearest(far_blocks, edges.select(F.col("block").alias("id")), step, span // BLOCK + 1)
    landed = jumps.join(edges, jumps["found"] == edges["block"]).select(
        (F.col("probe") - step).alias("block"), "edge")
    return near.join(landed, "block", "left").select("probe", F.coalesce("found", "edge").alias("found"))


def _distinct_probes(probes: DataFrame, probe: str) -> DataFrame:
    return probes.select(F.col(probe).cast("long").alias("probe")).distinct()


def _answer(found: DataFrame, probe: str, name: str) -> DataFrame:
    return found.select(F.col("probe").alias(probe), F.coalesce("found", F.lit(-1)).alias(name))


def _span(probes: DataFrame, a: DataFrame) -> int:
    """A number above every id and probe, with a block to spare: it decides the levels of blocks."""
    tops = probes.agg(F.max("probe").cast("long").alias("n")).unionByName(a.agg(F.max("id").cast("long").alias("n")))
    return (tops.agg(F.max("n")).first()[0] or 0) + BLOCK


def next_set(probes: DataFrame, a: DataFrame, probe: str = "probe") -> DataFrame:
    """Per distinct probe the smallest id >= probe, -1 if none."""
    asked = _distinct_probes(probes, probe)
    return _answer(_nearest(asked, a, 1, _span(asked, a)), probe, "next_set")


def previous_set(probes: DataFrame, a: DataFrame, probe: str = "probe") -> DataFrame:
    """Per distinct probe the greatest id <= probe, -1 if none."""
    asked = _distinct_probes(probes, probe)
    return _answer(_nearest(asked, a, -1, _span(asked, a)), probe, "previous_set")


def _gaps_beside(a: DataFrame, step: int) -> DataFrame:
    """The clear positions that directly follow (step 1) or precede (step -1) a set id."""
    ids = a.select(F.col("id").cast("long").alias("id"))
    return set_and_not(ids.select((F.col("id") + step).alias("id")), ids)


def _gap(probes: DataFrame, a: DataFrame, probe: str, step: int, past: Column, name: str) -> DataFrame:
    """A clear probe answers itself; a set one lands on the gap at the end of its run."""
    asked = _distinct_probes(probes, probe)
    sides = membership(asked.select(F.col("probe").alias("id")), a.select(F.col("id").cast("long").alias("id")))
    clear = sides.where(f"sides = {IN_A}").select(F.col("id").alias("probe"), F.col("id").alias("found"))
    held = sides.where(f"sides = {IN_BOTH}").select(F.col("id").alias("probe"))
    found = clear.unionByName(_nearest(held, _gaps_beside(a, step), step, _span(asked, a)))
    return found.select(F.col("probe").alias(probe), past.alias(name))


def next_gap(probes: DataFrame, a: DataFrame, probe: str = "probe", capacity: int = CAPACITY) -> DataFrame:
    """Per distinct probe the smallest clear position >= probe; -1 at or past ``capacity``."""
    inside = F.when(F.col("found") < capacity, F.col("found")).otherwise(F.lit(-1))
    return _gap(probes, a, probe, 1, inside, "next_gap")


def previous_gap(probes: DataFrame, a: DataFrame, probe: str = "probe", capacity: int = CAPACITY) -> DataFrame:
    """Per distinct probe the greatest clear position <= probe, -1 if none; a probe past
    ``capacity`` answers itself."""
    past = F.when(F.col("probe") >= capacity, F.col("probe")).otherwise(
        F.when(F.col("found") >= 0, F.col("found")).otherwise(F.lit(-1)))
    return _gap(probes, a, probe, -1, past, "previous_gap")
