"""Versioned writes: last-writer-wins merge and the acceptance rule of a replica."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.operators import joins
from dataprobe.session import materialize

LONG_HISTORY = 256
BLOCK_ROWS = 500_000


def lww_merge(df: DataFrame, key: str, value: str, counter: str, identifier: str) -> DataFrame:
    """Per key the value with the greatest counter, then the greatest identifier (then value).
    The merge is commutative and idempotent, so input order and repeats do not matter."""
    version = F.struct(counter, identifier, value)
    return df.groupBy(key).agg(F.max(version).alias("v")).select(
        key, f"v.{value}", f"v.{counter}", f"v.{identifier}")


def lww_read(df: DataFrame, wanted: object, key: str, value: str, counter: str, identifier: str) -> DataFrame:
    """Point read of one key; no row if it was never written. Other keys are filtered at the scan."""
    return lww_merge(df.where(F.col(key) == F.lit(wanted)), key, value, counter, identifier)


def lamport_fold(writes: DataFrame, long_history: int = LONG_HISTORY,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Replay ``(key, seq, leader, counter)`` per key in ``seq`` order; adds ``accepted``
    and ``stored``, the counter held after the write.

    A write is accepted if the key holds nothing yet, or if (counter, leader) is greater than the
    stored (counter, leader); then counter + 1 is stored with its leader. A write with a null
    counter or leader is refused and changes nothing, one with a null key belongs to no history
    and is refused too. ``seq`` must be unique within a key; leaders and counters are whole numbers.

    Short histories are folded inside an aggregate; their bound also bounds what copying the log costs. Keys with more
    than ``long_history`` writes are cut into blocks of about ``block_rows`` writes, see ``_fold_blocks``.
    """
    writes = writes.select("key", "seq", "leader", "counter")
    kinds = writes.schema
    keyless = writes.where("key IS NULL").select(
        "*", F.lit(False).alias("accepted"), F.lit(None).cast(kinds["counter"].dataType).alias("stored"))
    writes = writes.where("key IS NOT NULL")
    return _fold_keyed(writes, long_history, block_rows).unionByName(keyless)


def _fold_keyed(writes: DataFrame, long_history: int, block_rows: int) -> DataFrame:
    long_keys = materialize(
        writes.groupBy("key").count().where(F.col("count") > long_history), "long-histories")
    rows = long_keys.agg(F.sum("count")).first()[0]
    if not rows:
        return _fold_in_aggregate(writes)
    keys = long_keys.select("key")
    hot = long_keys.where(F.col("count") > joins.HOT_ROWS).select("key")
    short, long = (joins.lookup_join(writes, keys, ["key"], how, hot) for how in ("left_anti", "left_semi"))
    return _fold_in_aggregate(short).unionByName(_fold_blocks(long, rows // block_rows + 1))


def _fold_in_aggregate(writes: DataFrame) -> DataFrame:
    write = F.struct("seq", "leader", "counter")
    history = F.array_sort(F.collect_list(write))

    def step(state: Column, w: Column) -> Column:
        accepted = w["counter"].isNotNull() & w["leader"].isNotNull() & (state["counter"].isNull() | (
            F.struct(w["counter"], w["leader"]) > F.struct(state["counter"], state["leader"])))
        counter = F.when(accepted, w["counter"] + 1).otherwise(state["counter"])
        leader = F.when(accepted, w["leader"]).otherwise(state["leader"])
        done = F.struct(w["seq"].alias("seq"), w["leader"].alias("leader"), w["counter"].alias("counter"),
                        accepted.alias("accepted"), counter.alias("stored"))
        return F.struct(counter.alias("counter"), leader.alias("leader"),
                        F.concat(state["log"], F.array(done)).alias("log"))

    kinds = {f.name: f.dataType.simpleString() for f in writes.schema.fields}
    log_type = (f"array<struct<seq:{kinds['seq']},leader:{kinds['leader']},counter:{kinds['counter']},"
                f"accepted:boolean,stored:{kinds['counter']}>>")
    start = F.struct(
        F.lit(None).cast(kinds["counter"]).alias("counter"), F.lit(None).cast(kinds["leader"]).alias("leader"),
        F.array().cast(log_type).alias("log"))
    return (
        writes.groupBy("key").agg(history.alias("history"))
        .select("key", F.explode(F.aggregate("history", start, step, lambda s: s["log"])).alias("w"))
        .select("key", "w.*")
    )


State = tuple[int, int] | None
#: Block summaries that are chained in one task.
CHAIN = 64


def _replay(counters: list, leaders: list, state: State) -> tuple[list[bool], list[int | None]]:
    """Which writes are accepted from ``state`` on, and the counter that is stored after each."""
    accepted, stored = [], []
    for counter, leader in zip(counters, leaders):
        take = counter is not None and leader is not None and (state is None or (counter, leader) > state)
        if take:
            state = (counter + 1, leader)
        accepted.append(take)
        stored.append(None if state is None else state[0])
    return accepted, stored


def _after(effect: Sequence[tuple], state: State) -> State:
    """The state that ``effect`` turns ``state`` into."""
    for below_counter, below_leader, counter, leader in effect:
        if state is None or state < (below_counter, below_leader):
            return counter, leader
    return state


def _both(first: Sequence[tuple], second: Sequence[tuple]) -> list[tuple]:
    """The effect of ``first`` and then ``second``: its pieces end where ``second`` takes their ends, and states above them all
    meet ``second`` as they are."""
    out: list[tuple] = []
    pieces = [(*piece[:2], *_after(second, piece[2:])) for piece in first]
    last = first[-1][:2] if first else None
    pieces += [piece for piece in second if last is None or piece[:2] > last]
    for piece in pieces:
        if out and out[-1][2:] == piece[2:]:
            out[-1] = piece
        else:
            out.append(piece)
    return out


def _block_effect(writes: Sequence[tuple]) -> list[tuple]:
    """What a block of writes does to any earlier state, as ``(below, counter, leader)``.

    A state smaller than ``below`` (and not smaller than the entry before) ends as
    (counter, leader); a state above the last entry stays. A write (a) moves every
    state below a to the same new state, so states that have met stay together: the
    open states lie in a heap and each write merges the ones it passes.
    """
    bounds: list[tuple] = []
    group_of: list[int] = []            # bound -> group; groups are merged by redirecting
    merged: list[int] = []
    heap: list[tuple] = []
    final: dict[int, tuple] = {}

    def root(g: int) -> int:
        while merged[g] != g:
            merged[g] = merged[merged[g]]
            g = merged[g]
        return g

    for counter, leader in writes:
        asked, new = (counter, leader), (counter + 1, leader)
        passed = []
        while heap and heap[0][0] < asked:
            passed.append(heapq.heappop(heap)[1])
        if not bounds or asked > bounds[-1]:
            bounds.append(asked)
            merged.append(len(merged))
            group_of.append(len(merged) - 1)
            passed.append(len(merged) - 1)
        if passed:
            keep = passed[0]
            for g in passed[1:]:
                merged[g] = keep
            final[keep] = new
            heapq.heappush(heap, (new, keep))
    effect: list[tuple] = []
    for bound, g in zip(bounds, group_of):
        end = final[root(g)]
        if effect and effect[-1][2:] == end:
            effect[-1] = (*bound, *end)
        else:
            effect.append((*bound, *end))
    return effect


def _fold_blocks(writes: DataFrame, blocks: int) -> DataFrame:
    """Long histories: (1) each block of consecutive writes is summed up by its effect on any earlier state, (2) the
    effects of a key are chained, which gives the state at the start of each block, (3) each block is replayed from there.

    Blocks are range partitions of (key, seq), so they are equally large however the writes are spread, and one key may fill many of
    them. They are written down once, since all steps must see the same cut. Effects are chained in a tree: ``CHAIN`` blocks in a row
    become one of the next level, until a key has one; then the states go down the levels in the same groups.
    """
    kinds = {f.name: f.dataType.simpleString() for f in writes.schema.fields}
    key, leader, counter = kinds["key"], kinds["leader"], kinds["counter"]
    numbered = materialize(
        writes.repartitionByRange(blocks, "key", "seq").withColumn("block", F.spark_partition_id()), "blocks")
    effect_type = (f"key {key}, block int, effect array<struct<below_counter:{counter},below_leader:{leader},"
                   f"counter:{counter},leader:{leader}>>")
    names = ("below_counter", "below_leader", "counter", "leader")

    def effect_table(like: pa.Table, block: int, effect: Sequence[tuple]) -> pa.Table:
        kinds = [like.schema.field(c).type for c in ("counter", "leader")]
        piece = pa.struct(list(zip(names, kinds * 2)))
        return pa.table({"key": like["key"].slice(0, 1), "block": pa.array([block], type=pa.int32()),
                         "effect": pa.array([[dict(zip(names, p)) for p in effect]], type=pa.list_(piece))})

    def summarize(rows: pa.Table) -> pa.Table:
        valid = rows.filter(pc.and_(pc.is_valid(rows["counter"]), pc.is_valid(rows["leader"]))).sort_by("seq")
        effect = _block_effect(list(zip(valid["counter"].to_pylist(), valid["leader"].to_pylist())))
        return effect_table(rows, rows["block"][0].as_py(), effect)

    def in_order(rows: pa.Table) -> list[tuple[int, list[tuple]]]:
        """The blocks of a group and their effects."""
        return sorted((row["block"], [tuple(p[n] for n in names) for p in row["effect"]]) for row in rows.select(["block", "effect"]).to_pylist())

    def unite(rows: pa.Table) -> pa.Table:
        found = in_order(rows)
        effect: list[tuple] = []
        for _, later in found:
            effect = _both(effect, later)
        return pa.table({"key": rows["key"].slice(0, 1), "block": pa.array([found[0][0] // CHAIN], type=pa.int32()),
                         "effect": pa.array([[dict(zip(names, p)) for p in effect]], type=rows.schema.field("effect").type)})

    levels = [materialize(numbered.groupBy("key", "block").applyInArrow(summarize, effect_type), "effects")]
    width = blocks
    while width > 1:
        width = -(-width // CHAIN)
        levels.append(materialize(levels[-1].groupBy("key", F.floor(F.col("block") / CHAIN).alias("run")).applyInArrow(
            unite, effect_type), "effects"))

    def hand_down(above: pa.Table, rows: pa.Table) -> pa.Table:
        """The state before each block of a run, from the state before the run."""
        first = above.select(["counter", "leader"]).to_pylist()[0]
        state = None if first["counter"] is None else (first["counter"], first["leader"])
        found, before = in_order(rows), []
        for _, effect in found:
            before.append(state)
            state = _after(effect, state)
        columns = {c: pa.array([None if s is None else s[k] for s in before], type=above.schema.field(c).type)
                   for k, c in enumerate(("counter", "leader"))}
        return pa.table({"key": rows["key"], "block": pa.array([b for b, _ in found], type=pa.int32()), **columns})

    start_type = f"key {key}, block int, counter {counter}, leader {leader}"
    nothing = [F.lit(None).cast(counter).alias("counter"), F.lit(None).cast(leader).alias("leader")]
    starts = levels[-1].select("key", "block", *nothing)
    for effects in levels[-2::-1]:
        runs = effects.withColumn("run", F.floor(F.col("block") / CHAIN).cast("int"))
        starts = materialize(starts.withColumnRenamed("block", "run").groupBy("key", "run").cogroup(
            runs.groupBy("key", "run")).applyInArrow(hand_down, start_type), "starts")

    def replay(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        first = rows.select(["from_counter", "from_leader"]).slice(0, 1).to_pylist()[0]
        state = None if first["from_counter"] is None else (first["from_counter"], first["from_leader"])
        accepted, stored = _replay(rows["counter"].to_pylist(), rows["leader"].to_pylist(), state)
        return rows.select(["key", "seq", "leader", "counter"]).append_column("accepted", pa.array(accepted)).append_column(
            "stored", pa.array(stored, type=rows.schema.field("counter").type))

    begun = starts.select("key", "block", F.col("counter").alias("from_counter"), F.col("leader").alias("from_leader"))
    return numbered.join(begun, ["key", "block"], "left").groupBy("key", "block").applyInArrow(
        replay, f"key {key}, seq {kinds['seq']}, leader {leader}, counter {counter}, accepted boolean, stored {counter}")
