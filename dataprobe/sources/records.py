"""CSV records whose quoted values hold line breaks, read by many tasks at once.

A line break belongs to a value if an odd number of quotes stands before it in its file. So each split of a file counts its quotes, a
running sum over the splits gives every split the parity that it begins with, and from there each line knows whether it begins a record
or goes on with one. Only the lines of records with several lines are brought together; the others stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.operators.joins import broadcast_if_small
from dataprobe.session import materialize
from dataprobe.sources.readers import CsvSpec

_CORRUPT = "_corrupt"


def read_csv_records(spark: SparkSession, spec: CsvSpec) -> DataFrame:
    """Read by description, line breaks within quoted values included, each file by as many tasks as it has splits.

    The description needs a schema, or a header whose names then stand for text columns. Files are UTF-8, and a quote may stand only
    around a value or, escaped, within one. An empty unquoted value is null. A record that doesn't fit is dropped with
    ``skip_bad_lines``, else what can't be read of it is null. A quote that is never closed takes in the rest of its file.
    """
    if spec.charset.upper() != "UTF-8" or spec.infer:
        raise ValueError("parallel records are UTF-8 with a given schema")
    lines = spark.read.option("lineSep", "\n").text(spec.location).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    # Escaped characters don't count; a doubled quote changes nothing.
    bare = F.col("value") if spec.escape == spec.quote else F.regexp_replace("value", re.escape(spec.escape) + ".", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit(spec.quote), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2 == 1)
    records = _whole_records(lines, _split_states(lines))
    schema = spec.schema or T.StructType([T.StructField(name, T.StringType()) for name in _header(spark, spec)])
    if spec.header:
        records = records.where("NOT leads")
    kinds = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {k: v for k, v in spec.options().items() if k not in ("header", "inferSchema", "mode", "encoding", "multiLine")}
    parsed = records.where("record <> ''").select(F.from_csv("record", _ddl(kinds), options | {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("row"))
    if spec.skip_bad_lines:
        parsed = parsed.where(F.col(f"row.{_CORRUPT}").isNull())
    return parsed.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _header(spark: SparkSession, spec: CsvSpec) -> list[str]:
    if not spec.header:
        raise ValueError("without a header the description needs a schema")
    return spark.read.options(**spec.options() | {"inferSchema": "false", "multiLine": "false"}).csv(spec.location).columns


def _split_states(lines: DataFrame) -> DataFrame:
    """Per split ``(file, start)``: ``inside``, whether it begins within a quoted value, and ``opened``, the line where that record began.
    A file has one row for each of its splits here."""
    splits = lines.groupBy("file", "start").agg(
        F.sum(F.col("odd").cast("int")).alias("odds"), F.max(F.when(F.col("odd"), F.col("at"))).alias("last_odd"))
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("inside_after", F.sum("odds").over(upto) % 2 == 1)
    # If a split ends within a value, its last line with an odd number of quotes opened it; without one, it was open before.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("inside_after") & (F.col("odds") > 0), F.col("last_odd")), ignorenulls=True).over(before)
    return materialize(splits.select(
        "file", "start", ((F.sum("odds").over(upto) - F.col("odds")) % 2 == 1).alias("inside"), opened.alias("opened")), "splits")


def _whole_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``(record, leads)``: the text of each record, and whether it is the first of its file."""
    known = lines.join(broadcast_if_small(splits), ["file", "start"]).sortWithinPartitions("file", "start", "at")
    schema = "value string, start long, at long, record_at long, single boolean, leads boolean"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The line with which each line's record began."""
        split, inside, opened = None, False, -1
        for batch in batches:
            files, starts, ats = batch["file"].to_pylist(), batch["start"].to_pylist(), batch["at"].to_pylist()
            odds, insides, openers = (batch[c].to_pylist() for c in ("odd", "inside", "opened"))
            record_at, single, leads = [], [], np.zeros(len(files), dtype=bool)
            for i, (name, start, at, odd) in enumerate(zip(files, starts, ats, odds)):
                if (name, start) != split:
                    split, inside, opened = (name, start), insides[i], openers[i]
                    leads[i] = start == 0
                if not inside:
                    opened = at
                record_at.append(opened)
                single.append(not inside and not odd)
                inside ^= odd
            yield pa.record_batch({"value": batch["value"], "start": batch["start"], "at": batch["at"],
                                   "record_at": pa.array(record_at, type=pa.int64()), "single": pa.array(single), "leads": pa.array(leads)})

    marked = materialize(known.mapInArrow(mark, schema), "lines")
    end = F.regexp_replace("value", "\r$", "")      # of a file whose lines end in two characters
    single = marked.where("single").select(end.alias("record"), "leads")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "value"))), lambda x: x["value"])
    several = marked.where("NOT single").groupBy("record_at").agg(
        F.array_join(parts, "\n").alias("value"), F.max("leads").alias("leads")).select(end.alias("record"), "leads")
    return single.unionByName(several)
