"""Streaming twins: distinct results with their maximum, last writer wins, acceptance of writes, batched copy; questions to a
query's state.

Each query runs with ``availableNow``: it works through everything that has arrived,
in batches, and stops; started again with the same checkpoint it goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dataprobe.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A sibling session with settings for stateful queries; the caller's session keeps its own.

    State lies in RocksDB, so it may outgrow the heap. The number of state
    partitions is fixed for the life of a checkpoint: choose it for the state to come.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions or 2 * spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def distinct_results(stream: DataFrame, column: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each result once, however often batches repeat it. Without a ``watermark``
    (time column, delay) every result seen is remembered for ever."""
    if watermark:
        when, delay = watermark
        return stream.select(column, when).withWatermark(when, delay).dropDuplicatesWithinWatermark([column])
    return stream.select(column).where(F.col(column).isNotNull()).dropDuplicates([column])


def distinct_max(stream: DataFrame, column: str) -> DataFrame:
    """One row: number of distinct results and the greatest, 0 if there are none."""
    return distinct_results(stream, column).agg(
        F.count("*").alias("n_distinct"), F.coalesce(F.max(column), F.lit(0)).alias("max_value"))


def last_writer_wins(stream: DataFrame, key: str, value: str, counter: str, identifier: str) -> DataFrame:
    """The winning version per key; the state holds one version per key."""
    version = F.struct(counter, identifier, value)
    return stream.groupBy(key).agg(F.max(version).alias("v")).select(
        key, f"v.{value}", f"v.{counter}", f"v.{identifier}")


def _run(query_writer, checkpoint: str) -> None:
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append every batch to parquet files, exactly once."""
    _run(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def for_each_batch(stream: DataFrame, mode: str, action: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    _run(stream.writeStream.outputMode(mode).foreachBatch(action), checkpoint)


def changes_to(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Write what each batch reports under its batch number. A batch that is run again
    after a failure replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for_each_batch(stream, mode, write, checkpoint)


def latest_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key of what ``changes_to`` wrote."""
    changes = spark.read.parquet(path)
    columns = [c for c in changes.columns if c != "batch"]
    newest = F.max_by(F.struct(*columns), F.col("batch")).alias("row")
    return changes.groupBy(*keys).agg(newest).select("row.*") if keys else changes.agg(newest).select("row.*")


def run_distinct_max(stream: DataFrame, column: str) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "distinct-max"), scratch_path(spark, "checkpoint")
    changes_to(distinct_max(stream, column), "complete", path, checkpoint)
    return latest_changes(spark, path, [])


def run_last_writer_wins(stream: DataFrame, key: str, value: str, counter: str, identifier: str) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "last-writer"), scratch_path(spark, "checkpoint")
    changes_to(last_writer_wins(stream, key, value, counter, identifier), "update", path, checkpoint)
    return latest_changes(spark, path, [key])


def run_batched_copy(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "batched-copy"), scratch_path(spark, "checkpoint")
    append_to(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


class AcceptWrites(StatefulProcessor):
    """Holds (counter, leader) per key. A write is accepted if the key holds nothing yet or less than the write's (counter, leader);
    then counter + 1 is held with its leader. Within a batch writes go by ``seq``, and batches go as they arrive.

    With ``idle_ms`` a key that gets no write for so long is forgotten, which bounds the state; its next write then counts as its first.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "counter bigint, leader bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        state = None if state is None else (int(state[0]), int(state[1]))
        # pandas turns whole numbers with gaps into floats, so the gaps came filled and marked.
        writes = pd.concat(list(rows)).sort_values("seq", kind="stable")
        accepted, stored, holds = [], [], []
        for counter, leader, valid in zip(writes["counter"].tolist(), writes["leader"].tolist(), writes["valid"].tolist()):
            take = valid and (state is None or (counter, leader) > state)
            if take:
                state = (counter + 1, leader)
            accepted.append(take)
            stored.append(0 if state is None else state[0])
            holds.append(state is not None)
        if state is not None:
            self.held.update(state)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield writes.assign(accepted=accepted, stored=stored, holds=holds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def accept_writes(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``(key, seq, leader, counter)`` with ``accepted`` and ``stored``, the counter held after the write: the rule of
    ``versions.lamport_fold`` over batches that arrive in the order of ``seq``. A write without key, counter or leader is refused and
    changes nothing. Counters and leaders are 64-bit numbers. With ``idle_ms`` give the query a trigger other than ``availableNow``, which
    doesn't end while timers may come."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    marked = stream.where("key IS NOT NULL").select(
        "key", "seq", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("leader", "counter")],
        F.col("leader").isNotNull().alias("has_leader"), F.col("counter").isNotNull().alias("has_counter"),
        (F.col("leader").isNotNull() & F.col("counter").isNotNull()).alias("valid"))
    out = (f"key {kinds['key']}, seq {kinds['seq']}, leader bigint, counter bigint, has_leader boolean, has_counter boolean, valid boolean, "
           "accepted boolean, stored bigint, holds boolean")
    done = marked.groupBy("key").transformWithStateInPandas(
        AcceptWrites(idle_ms), out, "Append", "None" if idle_ms is None else "ProcessingTime")
    found = done.select(
        "key", "seq", *[F.when(F.col(f"has_{c}"), F.col(c)).cast(kinds[c]).alias(c) for c in ("leader", "counter")], "accepted",
        F.when(F.col("holds"), F.col("stored")).cast(kinds["counter"]).alias("stored"))
    keyless = stream.where("key IS NULL").select(
        "key", "seq", "leader", "counter", F.lit(False).alias("accepted"), F.lit(None).cast(kinds["counter"]).alias("stored"))
    return found.unionByName(keyless)


def arrive_in_order(df: DataFrame, order: str, batches: int) -> str:
    """Write ``df`` in files that arrive one after another in the order of a numeric column; gives their folder."""
    path = scratch_path(df.sparkSession, "arrivals")
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = 1 if low is None else (high - low) // batches + 1
    for k in range(batches):
        part = df.where(F.floor((F.col(order) - F.lit(low)) / width) == k) if low is not None else df
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def record_files(df: DataFrame, order: str, records: int) -> str:
    """Write ``df`` as files of exactly ``records`` rows (the last has what is left) in the order of ``order``, with the number of its
    file as ``batch``; gives their folder. Each file that a stream takes is then a batch by number of records, see ``run_batch_counts``.

    Rows are numbered over range partitions: each counts its own and adds what those before it hold. All rows of a file
    are in one task, in order, so that Spark's writer cuts the files exactly there.
    """
    spark = df.sparkSession
    path, staged = scratch_path(spark, "record-files"), scratch_path(spark, "numbered")
    df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
    rows = spark.read.parquet(staged).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row for each partition
    parts = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = rows.join(parts, "_part").withColumn("_number", F.col("_at") + F.col("_shift"))
    numbered = numbered.withColumn("batch", F.floor(F.col("_number") / records))
    numbered.repartition("batch").sortWithinPartitions("batch", "_number").select(*df.columns, "batch").write.option(
        "maxRecordsPerFile", records).parquet(path)
    return path


def ask(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """What a stateful operator of a query remembers after its last finished batch, read from its state store: the query may go on
    meanwhile, and its batches need not emit it. Columns are those of the operator's key and value."""
    state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return state.select("key.*", "value.*") if "value" in state.columns else state.select("key.*")


def ask_all(spark: SparkSession, checkpoint: str, column: str) -> DataFrame:
    """All distinct results that ``distinct_results`` has seen so far."""
    return ask(spark, checkpoint).select(column)


def ask_max(spark: SparkSession, checkpoint: str, column: str) -> DataFrame:
    """One row: number of distinct results so far and the greatest, 0 if there are none."""
    return ask_all(spark, checkpoint, column).agg(
        F.count("*").alias("n_distinct"), F.coalesce(F.max(column), F.lit(0)).alias("max_value"))


def remember_distinct(stream: DataFrame, column: str, checkpoint: str) -> None:
    """Take in what has arrived; nothing is written but the state, see ``ask_all`` and ``ask_max``."""
    _run(distinct_results(stream, column).writeStream.format("noop").outputMode("append"), checkpoint)


def run_accept_writes(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "accepted"), scratch_path(spark, "checkpoint")
    done = accept_writes(stream)
    append_to(done, path, checkpoint)
    return spark.read.schema(done.schema).parquet(path)


def run_batch_counts(stream: DataFrame, ident: str) -> DataFrame:
    """``(batch, last_batch, n, first_id, last_id, number)`` of each file that a stream over ``record_files`` took, as it took it in
    its trigger ``number``. A trigger may take many files: they stay apart, each a batch of records by itself."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "batch-counts"), scratch_path(spark, "checkpoint")
    files = stream.withColumn("_file", F.input_file_name())

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy("_file").agg(
            F.min("batch").alias("batch"), F.max("batch").alias("last_batch"), F.count("*").alias("n"), F.min(ident).alias("first_id"),
            F.max(ident).alias("last_id")).drop("_file").write.mode("overwrite").parquet(f"{path}/number={number}")

    for_each_batch(files, "append", count, checkpoint)
    return spark.read.parquet(path).where("n > 0")
