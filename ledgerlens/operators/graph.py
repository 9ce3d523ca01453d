"""Bounded traversal, distances and orphans over an edge table (edge_id, subject, object, predicate)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.heads import heads
from ledgerlens.operators.predicates import versioned

MOST_DEPTH, MOST_PATHS = 16, 500


def branch_limit(limit: int, depth: int) -> int:
    """Next edges that each partial path may take."""
    return next(b for b in range(1, limit + 1) if b**depth >= limit)


def steps(edges: DataFrame, direction: str, predicates: Sequence[str] = ()) -> DataFrame:
    """(near, far, edge_id, predicate): edges as they are walked."""
    if predicates:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    out = edges.select(F.col("subject").alias("near"), F.col("object").alias("far"), "edge_id", "predicate")
    back = edges.select(F.col("object").alias("near"), F.col("subject").alias("far"), "edge_id", "predicate")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]().where("near IS NOT NULL AND far IS NOT NULL")


def traverse(edges: DataFrame, seed: str, depth: int, limit: int, direction: str = "out", predicates: Sequence[str] = ()) -> DataFrame:
    """Simple paths from ``seed``: (depth, nodes, edge_ids), at most ``limit + 1`` in the order (depth, nodes, edge_ids).

    Each partial path keeps its first ``branch_limit`` steps by (far node, edge id) before the next hop, so a frontier
    has at most limit * branch_limit paths whatever the graph. It is held here; a hop is one pass over the edges that
    begin at its nodes, a condition that reaches the scan.
    """
    if not 0 < depth <= MOST_DEPTH or not 0 < limit <= MOST_PATHS:
        raise ValueError(f"depth is 1 to {MOST_DEPTH} and limit 1 to {MOST_PATHS}")
    walk = steps(edges, direction, predicates).select("near", "far", "edge_id")
    own, spark = branch_limit(limit, depth), edges.sparkSession
    schema = "depth int, nodes array<string>, edge_ids array<string>"
    frontier: list[tuple[list[str], list[str]]] = [([seed], [])]
    found: list[tuple[int, list[str], list[str]]] = []
    for hop in range(1, depth + 1):
        ends = sorted({nodes[-1] for nodes, _ in frontier})
        if not ends or len(found) > limit:  # paths are ordered by depth first
            break
        last = spark.createDataFrame([(k, nodes[-1], nodes) for k, (nodes, _) in enumerate(frontier)], "path int, near string, nodes array<string>")
        order = Window.partitionBy("path").orderBy("far", "edge_id")
        grown = walk.where(F.col("near").isin(ends)).join(F.broadcast(last), "near").where(~F.array_contains("nodes", F.col("far")))
        grown = grown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= own).select("path", "far", "edge_id").collect()
        frontier = [(frontier[r["path"]][0] + [r["far"]], frontier[r["path"]][1] + [r["edge_id"]]) for r in grown]
        found += [(hop, nodes, ids) for nodes, ids in frontier]
    return spark.createDataFrame(sorted(found)[: limit + 1], schema)


def distances(paths: DataFrame) -> DataFrame:
    """Shortest distance of each node on the paths."""
    return paths.select(F.posexplode("nodes").alias("distance", "node")).groupBy("node").agg(F.min("distance").alias("distance"))


def citations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges on the paths, in the order of first use: (edge_id, subject, object, predicate, first_use)."""
    used = paths.select("depth", F.array_join("nodes", "\x1f").alias("nodes"), F.posexplode("edge_ids").alias("at", "edge_id"))
    first = used.groupBy("edge_id").agg(F.min(F.struct("depth", "nodes", "at")).alias("first"))
    return edges.join(F.broadcast(first), "edge_id").withColumn("first_use", F.row_number().over(Window.orderBy("first", "edge_id"))).drop("first")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (key) that are in no edge's subject or object."""
    ends = edges.select(F.col("subject").alias("key")).unionByName(edges.select(F.col("object").alias("key"))).distinct()
    return nodes.join(ends, "key", "left_anti")


def proximity_boost(ranked: DataFrame, near: DataFrame, weight: float, key: str = "key", score: str = "score") -> DataFrame:
    """``weight / (distance + 1)`` added for rows whose key is on a path."""
    hit = ranked.join(near.withColumnRenamed("node", key), key, "left")
    return hit.withColumn(score, F.col(score) + F.coalesce(F.lit(float(weight)) / (F.col("distance") + 1), F.lit(0.0)))


def edges_of(rows: DataFrame, roles: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Edge rows that may be walked (active, ready, no tombstones) with their roles read from declared JSON paths.

    ``roles``: subject, object and predicate to the path in each version; rows of undeclared versions have null roles and
    are on no path.
    """
    live = rows.where("status = 'active' AND ready AND NOT tombstone")
    return live.select("*", *[versioned(paths).alias(role) for role, paths in roles.items()])


def live_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Current ready nodes (entity, key, id) without a live edge in either role within their entity.

    An edge is live if it cites no version of its subject, or cites the current one; what an old revision said does not
    keep a node connected.
    """
    current = heads(nodes.where("ready"), ("entity", "key")).where("NOT tombstone").select("entity", "key", "id")
    usable = edges.where("status = 'active' AND ready AND NOT tombstone").select("edge_id", "entity", "subject", "object", "derived_from")
    cited = usable.select("edge_id", "entity", F.col("subject").alias("key"), F.explode("derived_from").alias("id"))
    versions = cited.join(nodes.select("entity", "key", "id").distinct(), ["entity", "key", "id"]).join(current.withColumn("__now", F.lit(True)), ["entity", "key", "id"], "left")
    stale = versions.groupBy("edge_id").agg(F.count("__now").alias("now")).where("now = 0").select("edge_id")
    live = usable.join(stale, "edge_id", "left_anti")
    ends = live.select("entity", F.col("subject").alias("key")).unionByName(live.select("entity", F.col("object").alias("key"))).distinct()
    return current.join(ends, ["entity", "key"], "left_anti")
