"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import row_column, with_new_columns
from dataprobe.operators.joins import lookup_join

#: A Poisson number with a greater mean is the sum of several with means of at most this.
LARGEST_MEAN = 16.0
#: Counts per draw that are told apart. With a mean of 16, more has a probability below 1e-17, less
#: than the step of the 52-bit uniform number.
LARGEST_COUNT = 72


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts' text, the same in every run."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source",
                 text: str = "text", default: float = 0.0) -> DataFrame:
    """Per source: its UTF-8 bytes and ``rate``, the mean number of times each of its documents is to appear, so
    that the sources' bytes have the ratio of ``weights`` and the total is that of the sources with a weight.

    Each source that ``weights`` does not name weighs ``default``; without ``weights`` all weigh the same. Null
    sources are pooled with the empty name. A source without a byte has rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")).alias("bytes"))
    if weights is None:
        weight = F.lit(1.0)
    elif not weights or min(*weights.values(), default) < 0:
        raise ValueError("weights must be given and not negative")
    else:
        table = F.create_map(*[F.lit(x) for name, w in sorted(weights.items()) for x in (name, float(w))])
        weight = F.coalesce(table[F.col("source")], F.lit(float(default)))
    sizes = sizes.withColumn("weight", weight).where("bytes > 0 and weight > 0")
    total = sizes.agg(F.sum("weight").alias("weights"), F.sum("bytes").alias("total"))
    # One row, from an aggregate.
    return sizes.join(F.broadcast(total)).select(
        "source", "bytes", (F.col("weight") * F.col("total") / F.col("weights") / F.col("bytes")).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson number."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["all"], F.array(F.element_at(state["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST_COUNT)), start, step, lambda s: s["all"])


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 42, doc_id: str = "doc_id",
                source: str = "source", text: str = "text", default: float = 0.0) -> DataFrame:
    """Repeat each document a Poisson number of times with its source's rate (see ``source_rates``), in random order.

    Returns the columns of ``docs`` and ``copy_no`` (from 0), ``n_copies`` and ``order_key`` (32 hex digits);
    columns of these names in ``docs`` are replaced. The count inverts the distribution at a uniform number hashed from
    ``seed`` and ``doc_id``, so a task that runs again gives the same rows; rows that share a ``doc_id``
    (null ids too) are repeated alike. Documents with count 0 do not appear. Rows are spread over the partitions by
    ``order_key`` and sorted by it within each: a global shuffle with one exchange.

    The rates are joined by broadcast if counted small; else a source that holds very many rows is joined apart.
    """
    rates = source_rates(docs, weights, source, text, default)
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    tables = rates.select("source", draws.alias("draws"), _cumulative(F.col("rate") / draws).alias("cumulative"))
    rows = docs.select(row_column(docs).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"))
    rows = lookup_join(rows, tables, ["source"])
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda total, draw: total + F.size(F.filter(
            "cumulative", lambda c: c < unit_interval(F.lit(seed), F.col("id"), draw))))
    copies = rows.withColumn("n_copies", count).where("n_copies > 0").select(
        "row", "id", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_no"))
    key = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                            F.col("copy_no").cast("string")).cast("binary"))
    return copies.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key").select(
        *with_new_columns(docs.columns, "row", copy_no=F.col("copy_no"), n_copies=F.col("n_copies"),
                          order_key=F.col("order_key")))
