"""Connected components of links, in Spark and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import interim, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its smallest node.

    Alternates the published large-star and small-star steps: link all greater neighbours of a node, then all smaller
    ones, to its smallest neighbour, until nothing changes. The minimum is combined before the shuffle and written
    down, so that AQE can split the join that follows where a node has very many links.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    spark = links.sparkSession
    with interim(spark) as keep:
        links = materialize(links, "links")
        while True:
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            lowest = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
            large = both.where("b > a").join(lowest.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            large = materialize(large.where("a <> b").distinct(), "links")
            lowest = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
            small = large.join(lowest.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            small = small.unionByName(lowest.select("a", F.col("low").alias("b")))
            links = materialize(small.where("a <> b").distinct(), "links")
            now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
        return keep(links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")


class Forest:
    """Disjoint sets over ``0 .. n - 1`` whose root is the smallest member; links come as arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up
