"""Search plans: one to eight sources in five modes, ranked, fused, boosted and scored, as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as words
from ledgerlens.functions.vectors import query_cosine
from ledgerlens.operators import predicates, ranking
from ledgerlens.sources.records import Scope, scan

#: Declared types and what they are read as.
SPARK_KINDS = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "datetime": "timestamp"}
MODES = ("vector", "text", "hybrid", "recent", "structured")
MOST_SOURCES, MOST_K, MOST_CANDIDATES = 8, 100, 1000


class IllegalSearch(ValueError):
    """A search that the limits or the mode do not allow."""


@dataclass(frozen=True)
class Source:
    mode: str
    scope: Scope = field(default_factory=Scope)
    vector: Sequence[float] | None = None
    text: str | None = None
    where: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    order_by: Sequence[tuple[str, str]] = ()
    rank: Any = None
    k: int = 10
    candidates: int | None = None
    weight: float = 1.0
    #: Declared fields read from JSON content: name to (type, {version: path}); conditions and orders may use them.
    fields: Mapping[str, tuple[str, Mapping[int, str]]] = field(default_factory=dict)
    #: Conditions normally apply after the candidate cap, as the modes' recall is defined; this applies them before.
    prefilter: bool = False

    def cap(self) -> int:
        return self.candidates or min(MOST_CANDIDATES, max(100, 10 * self.k))

    def check(self) -> None:
        if self.mode not in MODES or not 1 <= self.k <= MOST_K or not 1 <= self.cap() <= MOST_CANDIDATES:
            raise IllegalSearch("mode, k or candidates out of range")
        if self.mode in ("vector", "hybrid") and self.vector is None or self.mode in ("text", "hybrid") and not self.text:
            raise IllegalSearch(f"{self.mode} needs its query")


def signals(rows: DataFrame, source: Source) -> DataFrame:
    """Rows with similarity and text_match, null where the mode has none."""
    near = query_cosine(F.col("embedding"), source.vector) if source.vector is not None else F.lit(None).cast("double")
    rows = rows.withColumn("similarity", near)
    if not source.text:
        return rows.withColumn("text_match", F.lit(None).cast("double"))
    return rows.join(words.cover_density(rows, source.text).withColumnRenamed("score", "text_match"), "id", "left")


def candidates(rows: DataFrame, source: Source) -> DataFrame:
    """The candidate rows of a source: its channel's best, at most ``cap``."""
    cap = source.cap()
    channel: dict[str, tuple[Column, list[Column]]] = {
        "vector": (F.col("similarity").isNotNull(), [F.desc("similarity"), F.desc("seq")]),
        "text": (F.col("text_match") > 0, [F.desc("text_match"), F.desc("seq")]),
        "recent": (F.lit(True), [F.desc("occurred_at"), F.desc("seq")]),
    }
    if source.mode == "structured":
        return predicates.where(rows, source.where).orderBy(*ranking.by_fields(source.order_by)).limit(cap)
    if source.mode != "hybrid":
        condition, order = channel[source.mode]
        return rows.where(condition).orderBy(*order).limit(cap)
    lists = [ranking.numbered(rows.where(c).select("id", "seq", "similarity", "text_match", "occurred_at"), o, cap) for c, o in channel.values()]
    return rows.join(F.broadcast(ranking.round_robin(lists, cap)), "id").drop("place")  # cap rows at most


def run_source(log: DataFrame, source: Source, now: Column | None = None) -> DataFrame:
    """Ranked rows of one source with rank_score, score (public) and rank, the first k."""
    source.check()
    rows = scan(log, source.scope)
    for name, (kind, paths) in source.fields.items():
        rows = rows.withColumn(name, predicates.versioned(paths, kind=SPARK_KINDS[kind]))
    if source.prefilter:
        rows = predicates.where(rows, source.where)
    found = candidates(signals(rows, source), source)
    if source.mode == "structured":
        found = found.withColumn("rank_score", F.lit(None).cast("double")).withColumn("score", F.lit(None).cast("double"))
        return ranking.numbered(found, ranking.by_fields(source.order_by), source.k)
    found = predicates.where(found, source.where).withColumn("rank_score", ranking.finite(ranking.compile_rank(source.rank or ranking.DEFAULTS[source.mode], now)))
    return ranking.numbered(found.withColumn("score", ranking.public_score()), ranking.by_relevance(), source.k)


@dataclass(frozen=True)
class GraphBoost:
    """``weight / (distance + 1)`` for rows whose key or entity is on a path from an anchor; ``near``: (node, distance)."""

    near: DataFrame
    weight: float = 1.0


def resolve(source: Source, catalog: Any) -> Source:
    """A source checked against a catalog: its collections are known, its fields legal in each of their versions, its rank
    made of signals that its mode has and scores that processors make."""
    from ledgerlens.plans import checks

    source.check()
    declared = checks.fields_of(catalog, source.scope.collections)
    if source.scope.collections and not declared:
        raise IllegalSearch(f"unknown collections {list(source.scope.collections)}")
    if declared:
        predicates.legal(source.where, declared, [f for f, _ in source.order_by])
    known = {s for p in catalog.families.get("processors", {}).values() for s in (*p.get("scores", []), *(p.get("score_fields") or {}))}
    if source.rank is not None:
        ranking.check_rank(source.rank, checks.SIGNALS[source.mode], known)
    return source


def search(log: DataFrame, sources: Mapping[str, Source], k: int = 10, constant: float = 60.0, now: Column | None = None, boost: Any = None, graph: GraphBoost | None = None) -> DataFrame:
    """The fused result of all sources: id, score and rank. Ranks that fuse are those after each source's own cut; with a
    graph boost the sources go on to their candidate cap, as far as ``MOST_K``."""
    if not 1 <= len(sources) <= MOST_SOURCES:
        raise IllegalSearch(f"1 to {MOST_SOURCES} sources")
    if graph is not None:
        sources = {n: replace(s, k=min(MOST_K, max(s.k, s.cap()))) for n, s in sources.items()}
    ranked = {n: (run_source(log, s, now), s.weight) for n, s in sources.items()}
    if len(ranked) == 1 and graph is None:
        return next(iter(ranked.values()))[0].select("id", "score", "rank")
    # MOST_SOURCES times MOST_K rows at most: the log is read once more for these ids, not joined by shuffle
    found = F.broadcast(ranking.fuse(ranked, constant))
    fused = log.select("id", "seq", "occurred_at", *[c for c in ("scores", "last_accessed", "key", "entity") if c in log.columns]).join(found, "id")
    if boost is not None:
        fused = fused.withColumn("fused", F.col("fused") * F.greatest(F.lit(0.0), ranking.compile_rank(boost, now)))
    if graph is not None:
        near = F.broadcast(graph.near.select("node", "distance"))  # a traversal's nodes: bounded by its paths
        fused = fused.join(near.select(F.col("node").alias("key"), F.col("distance").alias("__key")), "key", "left").join(near.select(F.col("node").alias("entity"), F.col("distance").alias("__entity")), "entity", "left")
        closest = F.least("__key", "__entity")
        fused = fused.withColumn("fused", F.col("fused") + F.coalesce(F.lit(float(graph.weight)) / (closest + 1), F.lit(0.0)))
    return ranking.numbered(fused.withColumn("score", ranking.public_score("fused")), ranking.by_relevance("fused"), k).select("id", "fused", "score", "rank")


def final_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*ranking.by_relevance())))


def reranked(rows: DataFrame, judge: Any, most: int = 20, k: int = MOST_K) -> DataFrame:
    """(id, rank, rerank_score): the first ``k`` rows, of which the first ``most`` are ordered by a judge."""
    from ledgerlens.plans.models import rerank

    first = [r.asDict() for r in rows.orderBy("rank").limit(k).collect()]
    made = [(r["id"], r["rank"], float(r["rerank_score"])) for r in rerank(first, judge, most)]
    return rows.sparkSession.createDataFrame(made, f"id {rows.schema['id'].dataType.simpleString()}, rank int, rerank_score double")


def view_source(log: DataFrame, catalog: Any, view: str, parameters: Mapping[str, Any], budget: int, line: Column, most: int = 100) -> DataFrame:
    """What a named view gives a derivation: its rows with their lines, the longest prefix within a token budget."""
    from ledgerlens.functions.render import tokens
    from ledgerlens.operators.packing import packed_prefix

    rows = query_view(log, catalog, view, parameters).orderBy("rank").limit(most).select("id", "rank")
    lines = log.select("id", line.alias("line")).join(F.broadcast(rows), "id")  # ``most`` rows
    return packed_prefix(lines, tokens(F.col("line")), budget, [F.col("rank")]).select("id", "rank", "line")


def query_view(log: DataFrame, catalog: Any, view: str, parameters: Mapping[str, Any], edges: DataFrame | None = None, nodes: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The rows of a named view: a search, a traversal over ``edges``, or the orphans among ``nodes``."""
    from ledgerlens.operators import graph

    kind = catalog.get("views", view).get("kind", "search")
    if kind == "search":
        q = catalog.query_of(view, parameters)
        scope = Scope(collections=tuple(q.get("collections", ())), types=tuple(q.get("types", ())))
        names = ("vector", "text", "rank", "k", "candidates", "weight", "prefilter")
        source = Source(q["mode"], scope, where=q.get("where", {}), order_by=[tuple(o) for o in q.get("order_by", ())], **{n: q[n] for n in names if n in q})
        return run_source(log, source, now)
    given = {n: parameters.get(n, r.get("default")) for n, r in (catalog.get("views", view).get("parameters") or {}).items()}
    if kind == "graph":
        return graph.traverse(edges, given["seed"], given["depth"], given["limit"], given["direction"])
    return graph.live_orphans(nodes, edges).orderBy("entity", "key").limit(given["limit"])


class LocalIndex:
    """A search backend over an indexed table (``lifecycle.index_rows`` with text and embedding): candidates by exact
    nearest vectors, BM25 and filters, as an external index would give them."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def candidates(self, most: int, vector: Sequence[float] | None = None, text: str | None = None, where: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
        """(id, channel, rank) of each channel asked for."""
        rows = predicates.where(self.rows, where or {})
        out = []
        if vector is not None:
            near = rows.select("id", query_cosine(F.col("embedding"), vector).alias("s")).where("s IS NOT NULL")
            out.append(ranking.numbered(near, [F.desc("s"), F.col("id")], most).select("id", F.lit("vector").alias("channel"), "rank"))
        if text is not None:
            out.append(ranking.numbered(words.bm25(rows, text), [F.desc("score"), F.col("id")], most).select("id", F.lit("text").alias("channel"), "rank"))
        if not out:
            raise IllegalSearch("ask for a vector or a text")
        return out[0] if len(out) == 1 else out[0].unionAll(out[1])
