"""Connected components of a table of links, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.session import materialise

#: Parts in which the neighbours of a node meet its smallest one.
SALTS = 8


class UnionFind(dict):
    """Roots are the smallest members."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around their smallest members."""
    sets = UnionFind()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(x, y)
    nodes = [x for x in sets if sets.find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], names=["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """(x, y) pairs of longs to (node, component): each linked node's smallest reachable one.

    Links of a task are contracted by union-find first, so what is shuffled is
    a forest.  Then, until nothing changes, every node hands its larger
    neighbours to its smallest one, and afterwards its smaller ones.  Minima
    are combined before they are shuffled, and a node's links are dealt to several
    tasks, so one with very many links is no single task.  Null ends and links of a node with itself are ignored; nodes
    without a link to another are not returned.
    """
    # written first: where the links come from Python as well, a task would need two workers at once
    given = materialise(links.select(F.col("x").cast("long"), F.col("y").cast("long")).filter("x <> y"))
    edges = materialise(given.mapInArrow(_forest, "x long, y long"))
    while not _stars(edges):
        # large star: both directions, larger neighbours to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = (
            _meet(both, least.select(F.col("x").alias("k"), F.least("x", "m").alias("m")))
            .filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        )
        # small star: smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            _meet(large, low.select(F.col("x").alias("k"), "m"))
            .select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select("e.x", "e.y").filter("x <> y").distinct()
        )
        edges = materialise(small)
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))


def _meet(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(x, y, m) of edges and the value of their ``x``; the edges of one ``x`` are dealt to several tasks by ``y``."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, (F.col("x") == F.col("k")) & (F.col("salt") == F.col("s"))).select("x", "y", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and this one none."""
    n = edges.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("x").alias("nodes")).first()
    ends = edges.select(F.col("y").alias("x")).distinct()
    return n["all"] == n["nodes"] and not edges.join(ends, "x", "left_semi").limit(1).count()
