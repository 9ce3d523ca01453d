"""Connected components of an edge table by union-find within tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges; gives (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(parent)]
    found = [x for x in found if x[0] != x[1]]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the long edges (a, b): the component is its smallest node. Nodes without an edge are absent.

    A node with very many edges is no hot spot: minima are pre-aggregated in each task, and the join that spreads them
    has one row a node on one side, which adaptive execution splits. Self loops and repeated edges do no harm.
    """
    now = common.materialise(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "u long, v long").distinct(), "stars")
    while True:
        # After a contraction every edge goes from a node to a smaller one. Done: one edge a node, and no target has one.
        count, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if count == nodes and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(least, "u")
        small = spread.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        now = common.materialise(small.mapInArrow(_contract, "u long, v long").distinct(), "stars")
