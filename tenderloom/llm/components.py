"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is one aggregate (the smallest neighbour, combined on the map side) and one join of the stored edges with the
stored result, so that a node with very many edges is split by adaptive execution. Nothing is gathered on the driver but
a count and a checksum per round. The edges of each task are first reduced to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.session import frozen


class Forest:
    """Union-find over numbers; the smallest of a tree is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        if a != b:
            self.parent[b] = a
        return a != b


def spanning(edges: DataFrame) -> DataFrame:
    """Of each Arrow batch only a spanning forest: the same components with fewer edges. Columns a, b of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest, a, b = Forest(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in zip(a, b):
                forest.join(x, y)
            nodes = [x for x in forest.parent if forest.root(x) != x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of every node to the smallest of them: those above the node (large) or below it (small)."""
    least = frozen(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    met = directed.join(least, "u")
    linked = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else (
        met.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a != b"))
    return frozen(linked.distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b: longs)."""
    edges = frozen(spanning(edges).where("a != b").distinct())
    seen = None
    while True:
        total = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (total["n"], total["s"]) == seen or total["n"] == 0:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = (total["n"], total["s"])
        edges = _star(_both_ways(edges), large=True)
        edges = _star(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), large=False)
