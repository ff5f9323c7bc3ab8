import pytest

from dataprobe.operators.versions import lww_merge
from dataprobe.sources.readers import stream_files
from dataprobe.streaming import streams


@pytest.fixture
def arrive(spark, tmp_path):
    def write(*batches, schema="n long"):
        """One file per batch, then a stream that takes one file at a time."""
        path = str(tmp_path / "in")
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        frame = spark.read.parquet(path)
        return stream_files(streams.stream_session(spark, 2), path, frame.schema), path

    return write


def test_overlapping_batches(arrive):
    stream, _ = arrive([(2,), (3,), (5,)], [(5,), (7,)])
    assert tuple(streams.run_distinct_max(stream, "n").first()) == (4, 7)


def test_nothing_but_nulls(arrive):
    stream, _ = arrive([(None,)])
    assert tuple(streams.run_distinct_max(stream, "n").first()) == (0, 0)


def test_goes_on_from_its_checkpoint(spark, arrive, tmp_path):
    stream, path = arrive([(1,), (2,)])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    query = lambda s: streams.changes_to(streams.distinct_max(s, "n"), "complete", out, checkpoint)
    query(stream)
    spark.createDataFrame([(2,), (9,)], "n long").coalesce(1).write.mode("append").parquet(path)
    query(stream)
    assert tuple(streams.latest_changes(spark, out, []).first()) == (3, 9)


def test_last_writer_equals_batch(spark, arrive, rows):
    schema = "k int, v string, c int, i int"
    data = [(n % 3, f"v{n}", (n * 7) % 5, n) for n in range(30)]
    stream, path = arrive(data[:10], data[10:20], data[15:], schema=schema)
    got = streams.run_last_writer_wins(stream, "k", "v", "c", "i")
    assert rows(got) == rows(lww_merge(spark.read.parquet(path), "k", "v", "c", "i"))


def test_copy_is_exact(spark, arrive, rows):
    stream, path = arrive([(1,), (1,)], [(2,)], [(3,)])
    assert rows(streams.run_batched_copy(stream)) == rows(spark.read.parquet(path))


def test_watermark_bounds_the_state(arrive, spark):
    stream, path = arrive([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00")], [(2, "2024-01-01 00:02:00")],
                          schema="n long, at string")
    timed = stream.selectExpr("n", "cast(at as timestamp) as at")
    assert streams.run_batched_copy(streams.distinct_results(timed, "n", ("at", "1 hour"))).count() == 2


def fold_rows(n, seed=3):
    import random
    rng = random.Random(seed)
    return [(rng.choice([None, *range(6)]), seq, rng.choice([None, *range(9)]), rng.choice([None, (1 << 60) + 5, *range(30)]))
            for seq in range(n)]


FOLD = "key long, seq long, leader long, counter long"


def test_accepted_writes_equal_the_batch_fold(spark, rows):
    from dataprobe.operators.versions import lamport_fold
    writes = spark.createDataFrame(fold_rows(120), FOLD)
    path = streams.arrive_in_order(writes, "seq", 3)
    got = streams.run_accept_writes(stream_files(streams.stream_session(spark, 2), path, writes.schema))
    assert got.columns == [*writes.columns, "accepted", "stored"]
    assert rows(got) == rows(lamport_fold(writes))


def test_accepted_writes_go_on_from_their_checkpoint(spark, rows, tmp_path):
    """Stopped between batches and started again: the held state is there, and no row is written twice."""
    from dataprobe.operators.versions import lamport_fold
    data, path, out, checkpoint = fold_rows(80, 9), *(str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (data[:30], data[30:]):
        spark.createDataFrame(part, FOLD).coalesce(1).write.mode("append").parquet(path)
        stream = stream_files(streams.stream_session(spark, 2), path, spark.read.parquet(path).schema)
        streams.append_to(streams.accept_writes(stream), out, checkpoint)
    assert rows(spark.read.parquet(out)) == rows(lamport_fold(spark.createDataFrame(data, FOLD)))


def test_idle_keys_are_forgotten(spark, tmp_path):
    """With a timer of a millisecond, a key's next batch but one finds nothing held."""
    import time
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for seq, counter in ((1, 9), (2, 1), (3, 1)):
        spark.createDataFrame([(7 if seq != 2 else 8, seq, 1, counter)], FOLD).coalesce(1).write.mode("append").parquet(path)
        stream = stream_files(streams.stream_session(spark, 2), path, spark.read.parquet(path).schema)
        done = streams.accept_writes(stream, idle_ms=1).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(once=True).start()
        assert done.awaitTermination(40)
        time.sleep(0.1)
    found = {r["seq"]: (r["accepted"], r["stored"]) for r in spark.read.parquet(out).collect()}
    assert found == {1: (True, 10), 2: (True, 2), 3: (True, 2)}


def test_ask_while_batches_come(spark, arrive, tmp_path, rows):
    stream, path = arrive([(1,), (4,)], [(4,), (None,)])
    checkpoint = str(tmp_path / "check")
    streams.remember_distinct(stream, "n", checkpoint)
    assert rows(streams.ask_all(spark, checkpoint, "n")) == [(1,), (4,)]
    spark.createDataFrame([(2,), (9,)], "n long").coalesce(1).write.mode("append").parquet(path)
    streams.remember_distinct(stream, "n", checkpoint)
    assert tuple(streams.ask_max(spark, checkpoint, "n").first()) == (4, 9)
    assert rows(streams.ask_all(spark, checkpoint, "n")) == [(1,), (2,), (4,), (9,)]


@pytest.mark.parametrize("n, sizes", [(230, [50, 50, 50, 50, 30]), (100, [50, 50]), (7, [7])])
def test_batches_by_number_of_records(spark, n, sizes):
    path = streams.record_files(spark.range(n).repartition(3), "id", 50)
    stream = stream_files(streams.stream_session(spark, 2), path, spark.read.parquet(path).schema)
    found = streams.run_batch_counts(stream, "id").orderBy("batch").collect()
    assert [r["n"] for r in found] == sizes and len({r["number"] for r in found}) == len(sizes)
    assert all(r["batch"] == r["last_batch"] and r["first_id"] == 50 * r["batch"] for r in found)


def test_a_trigger_takes_many_record_batches(spark):
    """Few triggers, and still each batch by itself."""
    path = streams.record_files(spark.range(230).repartition(3), "id", 10)
    stream = stream_files(streams.stream_session(spark, 2), path, spark.read.parquet(path).schema, files_per_batch=16)
    found = streams.run_batch_counts(stream, "id").orderBy("batch").collect()
    assert [(r["batch"], r["last_batch"], r["n"], r["first_id"], r["last_id"]) for r in found] == [
        (k, k, 10, 10 * k, 10 * k + 9) for k in range(23)]
    assert len({r["number"] for r in found}) == 2
