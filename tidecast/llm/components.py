"""Distributed union-find: connected components of an edge table.

Edges are written, and contracted inside each partition by a local union-find, which
puts out at most one edge per node.  (What made the edges may run Python too; two
workers a core would then be held at a time, and workers outlive their tasks.)  Then large-star and small-star rounds run
until every component is a star around its smallest node; every round is written
to the shared folder, so a lost executor costs one round at most, and nothing of
the graph reaches the driver but one count.  A round's table is deleted once the
next one is written.

Defined results: an edge from a node to itself and an edge with a null end make
no component; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, lean, written


class UnionFind:
    """Roots are the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while (nxt := up.get(x, x)) != root:
            up[x] = root
            x = nxt
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


@lean
def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    nodes = [x for x in sets.up if sets.find(x) != x]
    for i in range(0, len(nodes), 65536):
        some = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(some, np.int64)), pa.array(np.array([sets.find(x) for x in some], np.int64))], names=["a", "b"]
        )


def _not_stars(edges: DataFrame) -> bool:
    """Whether some node has two roots or is a root and a child."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    seen = ends.groupBy("v").agg(F.sum("child").alias("c"), F.max("root").alias("r"))
    return seen.agg(F.count_if((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("r") > 0))).alias("n")).first()["n"] > 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of the component) for every node that has an edge to another."""
    own = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    made = written(own.where(F.col("a") != F.col("b")), "edges")
    now = written(made.mapInArrow(_contract, "a long, b long"), "edges")  # a > b
    drop(made)
    while _not_stars(now):
        # Large star: every neighbour above u goes to the smallest around u.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "edges")
        drop(now)
        # Small star: every node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(large)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.scratch = now.scratch
    return out
