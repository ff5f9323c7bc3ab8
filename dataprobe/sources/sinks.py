"""Sinks and bounded actions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def show_rows(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def explain_rows(df: DataFrame) -> None:
    """Schema and physical plan."""
    df.printSchema()
    df.explain("formatted")


def take_rows(df: DataFrame, n: int) -> list[Row]:
    """At most ``n`` rows on the driver."""
    return df.take(n)


def for_each_partition(df: DataFrame, action: Callable[[Iterable[Row]], None]) -> None:
    """Run ``action`` on the executors, once per partition."""
    df.foreachPartition(action)


def append_rows(df: DataFrame, path: str) -> None:
    """Add to a result log that is only ever appended to."""
    df.write.mode("append").parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line in global order: the files follow each other, no task holds all lines.
    Copies of one value are split by the partition they come from, so a frequent value fills
    several files instead of one."""
    lines = df.select(F.col(column).cast("string").alias("line")).where("line is not null").withColumn(
        "origin", F.spark_partition_id())
    lines.repartitionByRange("line", "origin").sortWithinPartitions("line").select("line").write.text(path)


def write_csv_file(df: DataFrame, path: str, **options: str) -> None:
    """One plain CSV file with a header, for tables that are to fit one file: one task writes it."""
    spark = df.sparkSession
    staged = f"{path}.parts"
    df.coalesce(1).write.options(**options).csv(staged, header=True)
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = paths.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = system.globStatus(paths.Path(f"{staged}/part-*"))[0].getPath()
    system.rename(part, paths.Path(path))
    system.delete(paths.Path(staged), True)
