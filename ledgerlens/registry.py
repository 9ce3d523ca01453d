"""The queries of the reference operators over the fixture tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import render, text, vectors
from ledgerlens.operators import enrich, graph, heads, lifecycle, packing, predicates, provenance, ranking, storage, triggers
from ledgerlens.plans import artifacts, catalog
from ledgerlens.plans.search import Source, run_source, search
from ledgerlens.sources.records import Scope, activity, graph_edges, scan, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = """WITH RECURSIVE log AS (
  SELECT event_id AS id, event_id + 1 AS seq, 'activity' AS collection, 'user-' || user_id AS entity, event_type AS key, event_type AS type,
         CASE WHEN event_id % 17 = 0 THEN 'draft' ELSE 'active' END AS status, event_id % 10 <> 0 AS ready, event_id % 11 = 0 AS tombstone,
         ts AS occurred_at, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM events)"""
RUNS = (
    LOG
    + """, runs AS (SELECT entity, seq, seq AS high_seq, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'ok' END AS outcome, occurred_at AS completed_at FROM log WHERE id % 25 = 0),
marks AS (SELECT entity, max(high_seq) AS watermark, arg_max(completed_at, high_seq) AS last_success FROM runs WHERE outcome IN ('ok', 'noop') GROUP BY entity),
pend AS (SELECT l.* FROM log l LEFT JOIN marks m USING (entity) WHERE l.seq > coalesce(m.watermark, 0) AND l.ready)"""
)
CURRENT = LOG + ", now AS (SELECT * FROM log QUALIFY max(seq) OVER (PARTITION BY entity, collection, key, status) = seq)"
VEC = """WITH v AS (SELECT vec_id AS id, vec_id + 1 AS seq, label, embedding AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0),
s AS (SELECT id, seq, label, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sim FROM v, q WHERE id <> 0)"""
TS = "yyyy-MM-dd HH:mm:ss"
DTS = "%Y-%m-%d %H:%M:%S"
SLOT = heads.SLOT


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def stamp(c: str):
    return F.date_format(c, TS)


def _runs(log: DataFrame) -> DataFrame:
    n = F.col("id")
    return log.where(n % 25 == 0).select("entity", "seq", F.col("seq").alias("high_seq"), F.when(n % 4 == 0, "failed").otherwise("ok").alias("outcome"), F.col("occurred_at").alias("completed_at"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = activity(spark, d)
    return log, triggers.watermarks(_runs(log))


# Scans, heads and pages.
@query("timeline_page", LOG + " SELECT seq, entity, type, status FROM log WHERE seq < 900 ORDER BY seq DESC LIMIT 50")
def timeline_page(s, d):
    return heads.timeline(activity(s, d), before=900, limit=50).select("seq", "entity", "type", "status")


@query("entity_directory", LOG + " SELECT entity, count(*) AS n, max(seq) AS last_seq FROM log GROUP BY 1")
def entity_directory(s, d):
    return heads.entity_directory(activity(s, d))


@query("entity_ilike", LOG + " SELECT entity, count(*) AS n, max(seq) AS last_seq FROM log WHERE entity ILIKE '%USER-1%' GROUP BY 1")
def entity_ilike(s, d):
    return heads.entity_directory(activity(s, d), "%USER-1%")


HEADS_SQL = LOG + ", h AS (SELECT * FROM log WHERE status = '{status}' QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1)"


@query("document_heads", HEADS_SQL.format(status="active") + " SELECT entity, key, seq, ready FROM h WHERE NOT tombstone")
def document_heads(s, d):
    return heads.document(activity(s, d))[0].select("entity", "key", "seq", "ready")


@query("document_retractions", HEADS_SQL.format(status="active") + " SELECT entity, key, seq FROM h WHERE tombstone")
def document_retractions(s, d):
    return heads.document(activity(s, d))[1].select("entity", "key", "seq")


@query("document_draft_lane", HEADS_SQL.format(status="draft") + " SELECT entity, key, seq FROM h WHERE NOT tombstone")
def document_draft_lane(s, d):
    return heads.document(activity(s, d), status="draft")[0].select("entity", "key", "seq")


@query("key_history", LOG + " SELECT seq, status, tombstone FROM log WHERE entity = 'user-1' AND key = 'click' AND seq < 5000 ORDER BY seq DESC LIMIT 20")
def key_history(s, d):
    return heads.history(activity(s, d), "user-1", "click", before=5000, limit=20).select("seq", "status", "tombstone")


@query("delta_page", LOG + " SELECT seq, entity, ready, tombstone FROM log WHERE seq > 300 ORDER BY seq LIMIT 40")
def delta_page(s, d):
    return heads.delta(activity(s, d), 300, 40).select("seq", "entity", "ready", "tombstone")


@query("current_filter_unready_hides", CURRENT + " SELECT id, entity, key FROM now WHERE status = 'active' AND ready AND NOT tombstone")
def current_filter(s, d):
    return scan(activity(s, d), Scope(current=True)).select("id", "entity", "key")


@query("record_scope_scan", LOG + " SELECT id FROM log WHERE type IN ('click', 'view') AND status = 'active'")
def record_scope_scan(s, d):
    return scan(activity(s, d), Scope(types=("click", "view"), ready=False, tombstones=True)).select("id")


@query("scope_time_bounds", LOG + " SELECT id FROM log WHERE status = 'active' AND ready AND NOT tombstone AND occurred_at > TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-09'")
def scope_time_bounds(s, d):
    return scan(activity(s, d), Scope(after="2024-01-05 00:00:00", before="2024-01-09 00:00:00")).select("id")


@query("record_source_newest", LOG + " SELECT id, seq, ready FROM log WHERE entity = 'user-2' AND key = 'view' AND status = 'active' ORDER BY seq DESC LIMIT 1")
def record_source_newest(s, d):
    return heads.history(activity(s, d).where("status = 'active'"), "user-2", "view", limit=1).select("id", "seq", "ready")


@query("changes_ready_prefix", LOG + ", f AS (SELECT * FROM log WHERE seq > 1 ORDER BY seq LIMIT 200), m AS (SELECT coalesce(min(seq), 1000000000) AS cut FROM f WHERE NOT ready) SELECT seq, entity FROM f, m WHERE seq < cut")
def changes_ready_prefix(s, d):
    return heads.ready_prefix(activity(s, d).where("seq > 1"), 200).select("seq", "entity")


@query("snapshot_recent_window", LOG + " SELECT seq, entity FROM log ORDER BY seq DESC LIMIT 25")
def snapshot_recent(s, d):
    return heads.snapshot(activity(s, d), recent=25).select("seq", "entity")


@query("snapshot_range_window", LOG + " SELECT seq FROM log WHERE occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at <= TIMESTAMP '2024-01-04'")
def snapshot_range(s, d):
    return heads.snapshot(activity(s, d), since="2024-01-03 00:00:00", until="2024-01-04 00:00:00").select("seq")


# Predicates and projections.
def _where(name: str, sql: str, conditions: dict) -> None:
    query(name, LOG + f" SELECT id FROM log WHERE {sql}")(lambda s, d: predicates.where(activity(s, d), conditions).select("id"))


_where("pred_eq", "type = 'purchase'", {"type": {"eq": "purchase"}})
_where("pred_in", "k IN (1, 5, 9)", {"k": {"in": [1, 5, 9]}})
_where("pred_range", "value >= 10 AND value < 20.5 AND k > 2", {"value": {"gte": 10, "lt": 20.5}, "k": {"gt": 2}})
_where("pred_exists", "k IS NOT NULL", {"k": {"exists": True}})

ARRAYS = LOG + ", a AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE [type, status] END AS tags FROM log)"


def _tags(s: SparkSession, d: str) -> DataFrame:
    return activity(s, d).select("id", F.when(F.col("id") % 13 != 0, F.array("type", "status")).alias("tags"))


for _name, _sql, _ops in (
    ("pred_contains_any", "list_has_any(tags, ['view', 'draft'])", {"contains_any": ["view", "draft"]}),
    ("pred_contains_all", "list_has_all(tags, ['view', 'draft'])", {"contains_all": ["view", "draft"]}),
    ("pred_array_eq", "tags = ['click', 'active']", {"eq": ["click", "active"]}),
):
    query(_name, f"{ARRAYS} SELECT id FROM a WHERE {_sql}")(lambda s, d, ops=_ops: predicates.where(_tags(s, d), {"tags": ops}).select("id"))


@query("versioned_field_read", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE NULL END AS amount FROM events")
def versioned_field_read(s, d):
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("version"), F.col("props").alias("content"))
    return rows.select("id", predicates.versioned({1: "$.absent", 2: "$.k"}, kind="double").alias("amount"))


@query("supersession_coalesce", LOG + " SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN value END, CASE WHEN id % 3 = 0 THEN CAST(k AS DOUBLE) END) AS topic FROM log")
def supersession_coalesce(s, d):
    rows = activity(s, d).select("id", F.when(F.col("id") % 4 == 0, F.col("value")).alias("newer"), F.when(F.col("id") % 3 == 0, F.col("k").cast("double")).alias("older"))
    return rows.select("id", predicates.superseded(["newer", "older"]).alias("topic"))


@query("structured_order_nulls_last", LOG + ", x AS (SELECT id, seq, CASE WHEN id % 7 <> 0 THEN k END AS k, value FROM log) SELECT id, row_number() OVER (ORDER BY k DESC NULLS LAST, value ASC NULLS LAST, seq, CAST(id AS VARCHAR)) AS rank FROM x QUALIFY rank <= 60")
def structured_order(s, d):
    rows = activity(s, d).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("k")))
    return ranking.numbered(rows, ranking.by_fields([("k", "desc"), ("value", "asc")]), 60).select("id", F.col("rank").cast("bigint").alias("rank"))


# Ranking and search.
LIVE = LOG + ", live AS (SELECT * FROM log WHERE status = 'active' AND ready AND NOT tombstone)"


@query("recent_topk", LIVE + " SELECT id, occurred_at::VARCHAR IS NOT NULL AS timed FROM live ORDER BY occurred_at DESC, seq DESC LIMIT 30")
def recent_topk(s, d):
    return scan(activity(s, d), Scope()).orderBy(F.desc("occurred_at"), F.desc("seq")).limit(30).select("id", F.col("occurred_at").isNotNull().alias("timed"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()
    rows = v.where("vec_id <> 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("seq"), "label", "embedding")
    return rows.withColumn("similarity", vectors.query_cosine(F.col("embedding"), q["embedding"] if q else [0.0])).drop("embedding")


@query("vector_topk", VEC + " SELECT id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, seq DESC LIMIT 20")
def vector_topk(s, d):
    return _vectors(s, d).orderBy(F.desc("similarity"), F.desc("seq")).limit(20).select("id", F.round("similarity", 6).alias("similarity"))


@query("vector_where_after_cap", VEC + ", c AS (SELECT * FROM s ORDER BY sim DESC, seq DESC LIMIT 100) SELECT id, label FROM c WHERE label IN (1, 3)")
def vector_where_after_cap(s, d):
    capped = _vectors(s, d).orderBy(F.desc("similarity"), F.desc("seq")).limit(100)
    return predicates.where(capped, {"label": {"in": [1, 3]}}).select("id", "label")


NOW = "2024-02-01 00:00:00"
AGE = "greatest(0, date_diff('microsecond', occurred_at, TIMESTAMP '2024-02-01') / 3.6e9)"


def _ranked(s: SparkSession, d: str, rank) -> DataFrame:
    rows = scan(activity(s, d), Scope()).withColumn("scores", F.create_map(F.lit("importance"), F.col("k").cast("double")))
    now = F.lit(NOW).cast("timestamp_ntz")
    return rows.withColumn("rank_score", ranking.compile_rank(rank, now))


def _rank(name: str, sql: str, rank) -> None:
    query(name, LIVE + f" SELECT id, round({sql}, 6) AS rank_score FROM live")(lambda s, d: _ranked(s, d, rank).select("id", F.round("rank_score", 6).alias("rank_score")))


_rank("rank_sum_decay", f"coalesce(k, 0) + 1 / (1 + {AGE} / 24)", {"sum": [{"score": "importance"}, {"decay": {"of": {"age_hours": "occurred_at"}, "midpoint": 24, "exponent": 1}}]})
_rank("rank_saturate", "pow(greatest(0, value), 2) / (pow(greatest(0, value), 2) + 100)", {"saturate": {"of": "value", "midpoint": 10, "exponent": 2}})
_rank("rank_max_product", "greatest(0.5 * value, coalesce(k, 0))", {"max": [{"product": {"factor": 0.5, "of": "value"}}, {"score": "importance"}]})


@query("rank_normalize", LIVE + " SELECT id, round(CASE WHEN max(value) OVER (PARTITION BY entity) > min(value) OVER (PARTITION BY entity) THEN (value - min(value) OVER (PARTITION BY entity)) / (max(value) OVER (PARTITION BY entity) - min(value) OVER (PARTITION BY entity)) ELSE 0 END, 6) AS rank_score FROM live")
def rank_normalize(s, d):
    rows = scan(activity(s, d), Scope())
    return rows.select("id", F.round(ranking.compile_rank({"normalize": "value"}, pool=("entity",)), 6).alias("rank_score"))


@query("public_score_minmax", LIVE + ", p AS (SELECT * FROM live ORDER BY value DESC, seq DESC LIMIT 200), r AS (SELECT id, CASE WHEN max(value) OVER () > min(value) OVER () THEN (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) ELSE 1 END AS score, row_number() OVER (ORDER BY value DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM p) SELECT id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def public_score_minmax(s, d):
    pool = scan(activity(s, d), Scope()).orderBy(F.desc("value"), F.desc("seq")).limit(200).withColumn("rank_score", F.col("value")).withColumn("score", ranking.public_score())
    return ranking.numbered(pool, ranking.by_relevance(), 20).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


LISTS = LIVE + ", a AS (SELECT id, row_number() OVER (ORDER BY value DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM live QUALIFY rank <= 40), b AS (SELECT id, row_number() OVER (ORDER BY occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM live QUALIFY rank <= 40)"


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = scan(activity(s, d), Scope())
    a = ranking.numbered(live, ranking.by_relevance("value"), 40).select("id", "rank")
    b = ranking.numbered(live, [F.desc("occurred_at"), F.desc("seq"), F.col("id").cast("string")], 40).select("id", "rank")
    return a, b


@query("rrf_weighted", LISTS + ", f AS (SELECT id, sum(w) AS fused FROM (SELECT id, 1.0 / (60 + rank) AS w FROM a UNION ALL SELECT id, 1.1 / (60 + rank) FROM b) GROUP BY id) SELECT id, round(fused, 8) AS fused FROM f")
def rrf_weighted(s, d):
    a, b = _lists(s, d)
    return ranking.fuse({"a": (a, 1.0), "b": (b, 1.1)}).select("id", F.round("fused", 8).alias("fused"))


@query("rrf_boost", LISTS + ", f AS (SELECT id, sum(w) AS fused FROM (SELECT id, 1.0 / (60 + rank) AS w FROM a UNION ALL SELECT id, 1.1 / (60 + rank) FROM b) GROUP BY id) SELECT f.id, round(fused * greatest(0, coalesce(k, 0)), 8) AS fused FROM f JOIN live USING (id)")
def rrf_boost(s, d):
    a, b = _lists(s, d)
    fused = ranking.fuse({"a": (a, 1.0), "b": (b, 1.1)}).join(activity(s, d).select("id", "k"), "id")
    return fused.select("id", F.round(F.col("fused") * F.greatest(F.lit(0.0), ranking.compile_rank("k")), 8).alias("fused"))


@query("round_robin_hybrid", LISTS + ", u AS (SELECT id, rank, 0 AS c FROM a UNION ALL SELECT id, rank, 1 FROM b), m AS (SELECT id, min({'at': rank, 'c': c}) AS t FROM u GROUP BY id) SELECT id, row_number() OVER (ORDER BY t, id) AS place FROM m QUALIFY place <= 50")
def round_robin_hybrid(s, d):
    return ranking.round_robin(_lists(s, d), 50).select("id", F.col("place").cast("bigint").alias("place"))


def _recall_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the vectors and texts of the same numbers: a log for every search mode."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    t = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    log = activity(spark, folder).join(v, "id", "left").join(t, "id", "left")
    return log.withColumn("last_accessed", F.col("occurred_at")).withColumn("scores", F.create_map(F.lit("importance"), F.col("k").cast("double")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-source recall: a vector, a structured and a recent source, fused by weighted ranks and scored."""
    first = table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()
    now = F.lit(NOW).cast("timestamp_ntz")
    sources = {
        "near": Source("vector", vector=first["embedding"] if first else [0.0], k=20),
        "valued": Source("structured", where={"value": {"gte": 5.0}}, order_by=[("value", "desc")], k=20, weight=1.1),
        "recent": Source("recent", k=20, weight=0.5),
    }
    return search(_recall_log(spark, folder), sources, k=15, now=now)


FUSED = f"""{LIVE}, v AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings),
c1 AS (SELECT id, seq, occurred_at, sim FROM live JOIN v USING (id) ORDER BY sim DESC, seq DESC LIMIT 200),
r1 AS (SELECT *, CASE WHEN max(sim) OVER () > min(sim) OVER () THEN (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) ELSE 0 END + 1 / (1 + {AGE} / 24) AS s FROM c1),
n1 AS (SELECT id, row_number() OVER (ORDER BY s DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM r1 QUALIFY rank <= 20),
n2 AS (SELECT id, row_number() OVER (ORDER BY value DESC NULLS LAST, seq, CAST(id AS VARCHAR)) AS rank FROM live WHERE value >= 5 QUALIFY rank <= 20),
c3 AS (SELECT id, seq, occurred_at, 1 / (1 + {AGE} / 24) AS s FROM live ORDER BY occurred_at DESC, seq DESC LIMIT 200),
n3 AS (SELECT id, row_number() OVER (ORDER BY s DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM c3 QUALIFY rank <= 20),
f AS (SELECT id, sum(w) AS fused FROM (SELECT id, 1.0 / (60 + rank) AS w FROM n1 UNION ALL SELECT id, 1.1 / (60 + rank) FROM n2 UNION ALL SELECT id, 0.5 / (60 + rank) FROM n3) GROUP BY id),
g AS (SELECT id, fused, CASE WHEN max(fused) OVER () > min(fused) OVER () THEN (fused - min(fused) OVER ()) / (max(fused) OVER () - min(fused) OVER ()) ELSE 1 END AS score, row_number() OVER (ORDER BY fused DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM f JOIN live USING (id))
SELECT id, round(fused, 8) AS fused, round(score, 5) AS score, rank FROM g WHERE rank <= 15"""


@query("recall_fused", FUSED)
def recall_fused(s, d):
    return flagship(s, d).select("id", F.round("fused", 8).alias("fused"), F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("search_hybrid")
def search_hybrid(s, d):
    first = table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    source = Source("hybrid", vector=first["embedding"] if first else [0.0], text="idiot or clown or moron", k=20)
    return run_source(_recall_log(s, d), source, F.lit(NOW).cast("timestamp_ntz")).select("id", "rank", "score")


# Text.
@query("term_match", "SELECT doc_id AS id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = 'the')) AS INTEGER) AS hits FROM documents WHERE hits > 0")
def term_match(s, d):
    return text.match_counts(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "the")


@query(
    "bm25_topk",
    """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'license')) AS b FROM w),
g AS (SELECT count(*) AS nn, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT id, round(ln(1 + (nn - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nn - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, g WHERE a + b > 0 ORDER BY score DESC, id LIMIT 50""",
)
def bm25_topk(s, d):
    scored = text.bm25(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "idiot license")
    return scored.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("cover_density")
def cover_density(s, d):
    return text.cover_density(table(s, d, "documents").withColumnRenamed("doc_id", "id"), 'idiot or "the stupid" or clown -license')


# Graph.
EDGES = """WITH RECURSIVE edges0 AS (
SELECT 'customer-' || c_custkey AS subject, 'nation-' || c_nationkey AS object, 'lives_in' AS predicate FROM customer
UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'based_in' FROM supplier
UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, 'part_of' FROM nation
UNION ALL SELECT DISTINCT 'part-' || l_partkey, 'supplier-' || l_suppkey, 'supplied_by' FROM lineitem),
edges AS (SELECT *, predicate || '|' || subject || '|' || object AS edge_id FROM edges0)"""


def _walk_sql(seed: str, depth: int, limit: int, near: str) -> str:
    b = graph.branch_limit(limit, depth)
    hops = f", steps AS ({near}), w0 AS (SELECT ['{seed}'] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids)"
    for h in range(1, depth + 1):
        hops += f", w{h} AS (SELECT list_append(nodes, far) AS nodes, list_append(edge_ids, edge_id) AS edge_ids FROM (SELECT w.nodes, w.edge_ids, s.far, s.edge_id, row_number() OVER (PARTITION BY w.nodes, w.edge_ids ORDER BY s.far, s.edge_id) AS n FROM w{h - 1} w JOIN steps s ON s.near = w.nodes[-1] AND NOT list_contains(w.nodes, s.far)) WHERE n <= {b})"
    union = " UNION ALL ".join(f"SELECT {h} AS depth, nodes, edge_ids FROM w{h}" for h in range(1, depth + 1))
    return f"{EDGES}{hops}, paths AS (SELECT * FROM ({union}) ORDER BY depth, nodes, edge_ids LIMIT {limit + 1})"


OUT = "SELECT subject AS near, object AS far, edge_id, predicate FROM edges"
IN = "SELECT object AS near, subject AS far, edge_id, predicate FROM edges"
PATHS = " SELECT depth, array_to_string(nodes, '>') AS nodes, array_to_string(edge_ids, '>') AS edge_ids FROM paths"


def _paths(p: DataFrame) -> DataFrame:
    return p.select("depth", F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edge_ids"))


@query("graph_out_depth2", _walk_sql("part-1", 2, 20, OUT) + PATHS)
def graph_out(s, d):
    return _paths(graph.traverse(graph_edges(s, d), "part-1", 2, 20, "out"))


@query("graph_in_depth2", _walk_sql("region-1", 2, 30, IN) + PATHS)
def graph_in(s, d):
    return _paths(graph.traverse(graph_edges(s, d), "region-1", 2, 30, "in"))


BOTH = _walk_sql("nation-3", 3, 60, f"{OUT} WHERE predicate IN ('based_in', 'part_of') UNION ALL {IN} WHERE predicate IN ('based_in', 'part_of')")


def _both_ways(s: SparkSession, d: str) -> DataFrame:
    return graph.traverse(graph_edges(s, d), "nation-3", 3, 60, "both", ("based_in", "part_of"))


@query("graph_both_predicates", BOTH + PATHS)
def graph_both(s, d):
    return _paths(_both_ways(s, d))


@query("graph_distances", BOTH + ", f AS (SELECT unnest(nodes) AS node, unnest(range(0, len(nodes))) AS p FROM paths) SELECT node, CAST(min(p) AS INTEGER) AS distance FROM f GROUP BY node")
def graph_distances(s, d):
    return graph.distances(_both_ways(s, d))


@query("graph_citations", BOTH + " SELECT DISTINCT edge_id FROM (SELECT unnest(edge_ids) AS edge_id FROM paths)")
def graph_citations(s, d):
    return graph.citations(_both_ways(s, d), graph_edges(s, d)).select("edge_id")


@query("graph_boost_rank", BOTH + ", f AS (SELECT unnest(nodes) AS node, unnest(range(0, len(nodes))) AS p FROM paths), g AS (SELECT node, min(p) AS distance FROM f GROUP BY node) SELECT 'supplier-' || s_suppkey AS key, round(s_acctbal / 1000 + coalesce(2.0 / (distance + 1), 0), 6) AS score FROM supplier LEFT JOIN g ON g.node = 'supplier-' || s_suppkey")
def graph_boost(s, d):
    ranked = table(s, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("key"), (F.col("s_acctbal") / 1000).alias("score"))
    return graph.proximity_boost(ranked, graph.distances(_both_ways(s, d)), 2.0).select("key", F.round("score", 6).alias("score"))


@query("graph_orphans", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def graph_orphans(s, d):
    made = table(s, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("object"))
    return graph.orphans(table(s, d, "customer").select(F.col("c_custkey").alias("key")), made.withColumn("object", F.lit(None).cast("bigint")))



# Provenance and lifecycle.
LINKS = LOG + ", links AS (SELECT id AS child, id // 3 AS parent FROM log WHERE id % 2 = 1)"


def _links(s: SparkSession, d: str) -> DataFrame:
    log = activity(s, d).where("id % 2 = 1").select("id", F.array(F.floor(F.col("id") / 3)).alias("derived_from"))
    return provenance.parents(log)


@query("erasure_closure", LINKS + ", reach(id) AS (SELECT id FROM log WHERE id IN (1, 2, 6) UNION SELECT l.child FROM reach r JOIN links l ON l.parent = r.id) SELECT id FROM reach")
def erasure_closure(s, d):
    return provenance.closure(_links(s, d), activity(s, d).where("id IN (1, 2, 6)").select("id")).select("id")


@query("erasure_audit", LINKS + ", reach(id) AS (SELECT id FROM log WHERE id IN (1, 2, 6) UNION SELECT l.child FROM reach r JOIN links l ON l.parent = r.id), ids AS (SELECT CAST(id AS VARCHAR) AS id, left(sha256(CAST(id AS VARCHAR)), 2) AS part FROM reach), p AS (SELECT part, count(*) AS n, sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)) AS digest FROM ids GROUP BY part) SELECT CAST(sum(n) AS BIGINT) AS erased, sha256(string_agg(digest, '' ORDER BY part)) AS digest FROM p")
def erasure_audit(s, d):
    log = activity(s, d)
    return provenance.erase(log, provenance.closure(_links(s, d), log.where("id IN (1, 2, 6)").select("id")))[1]


@query("lineage_depth", LINKS + ", up(id, place, depth) AS (SELECT id, id, 0 FROM log UNION ALL SELECT u.id, l.parent, u.depth + 1 FROM up u JOIN links l ON l.child = u.place) SELECT id, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY id")
def lineage_depth(s, d):
    return provenance.depths(activity(s, d).select("id"), _links(s, d))


@query("stale_citations", LINKS + ", live AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity, collection, version, key, status ORDER BY seq DESC) = 1), newest AS (SELECT entity, collection, version, key, status, max(seq) AS newer FROM log WHERE ready GROUP BY ALL) SELECT child, parent, newer FROM links JOIN live h ON h.id = child AND h.ready AND NOT h.tombstone JOIN log p ON p.id = parent JOIN newest n ON n.entity = p.entity AND n.collection = p.collection AND n.version = p.version AND n.key = p.key AND n.status = p.status WHERE newer > p.seq")
def stale_citations(s, d):
    return provenance.stale_citations(activity(s, d), _links(s, d), ("entity", "collection", "version", "key", "status"))


RETENTION = LOG + ", slots AS (SELECT entity, key, status, seq FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity, key, status ORDER BY seq DESC) = 1) WHERE tombstone AND occurred_at <= TIMESTAMP '2024-01-30')"


@query("retention_slots", RETENTION + " SELECT * FROM slots")
def retention_slots(s, d):
    return provenance.expired_slots(activity(s, d), ("entity", "key", "status"), "2024-01-30 00:00:00")


@query("retention_purge", RETENTION + " SELECT l.id FROM log l JOIN slots s ON s.entity = l.entity AND s.key = l.key AND s.status = l.status")
def retention_purge(s, d):
    log, slot = activity(s, d), ("entity", "key", "status")
    return provenance.purge(log, provenance.expired_slots(log, slot, "2024-01-30 00:00:00"), slot)


@query("divergence", LOG + ", a AS (SELECT * FROM log WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1), b AS (SELECT * FROM log WHERE status = 'draft' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1) SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.key, b.key) AS key, CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'removed' WHEN a.k IS NOT DISTINCT FROM b.k THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.entity = b.entity AND a.key = b.key")
def divergence(s, d):
    log, by = activity(s, d), ("entity", "key")
    return provenance.divergence(heads.heads(log.where("status = 'active'"), by), heads.heads(log.where("status = 'draft'"), by), by, "k")


@query("embedding_coverage", LOG + ", e AS (SELECT vec_id AS id, vec_id % 5 <> 0 AS has_vector FROM embeddings) SELECT count(*) AS total, count(*) FILTER (has_vector) AS embedded, count(*) FILTER (has_vector IS NULL) AS pending FROM log LEFT JOIN e USING (id)")
def embedding_coverage(s, d):
    staged = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5 != 0).alias("has_vector"))
    return provenance.coverage(activity(s, d), staged)


@query("contract_groups", LOG + " SELECT collection, version, sha256(collection || '@' || version) AS hash, count(*) AS n FROM log GROUP BY ALL")
def contract_groups(s, d):
    h = F.sha2(F.concat_ws("@", "collection", F.col("version").cast("string")), 256)
    return storage.contract_groups(activity(s, d).withColumn("hash", h))


@query("annotation_vintage", LOG + ", m AS (SELECT 'topic' AS name, 'h' || (id % 3) AS hash FROM log UNION ALL SELECT 'mood', 'm' || (id % 2) FROM log) SELECT name, count(*) AS n FROM m WHERE hash <> CASE name WHEN 'topic' THEN 'h1' ELSE 'm0' END GROUP BY name")
def annotation_vintage(s, d):
    n = F.col("id")
    meta = F.create_map(F.lit("topic"), F.concat(F.lit("h"), (n % 3).cast("string")), F.lit("mood"), F.concat(F.lit("m"), (n % 2).cast("string")))
    return provenance.vintage(activity(s, d).select(meta.alias("annotation_meta")), {"topic": "h1", "mood": "m0"})


@query("reindex_since", LOG + ", f AS (SELECT * FROM log WHERE seq > 600 AND ready), t AS (SELECT DISTINCT entity, collection, key, status FROM f), b AS (SELECT l.* FROM log l SEMI JOIN t ON t.entity = l.entity AND t.collection = l.collection AND t.key = l.key AND t.status = l.status WHERE l.seq <= 600 AND l.ready QUALIFY row_number() OVER (PARTITION BY l.entity, l.collection, l.key, l.status ORDER BY l.seq DESC) = 1) SELECT id FROM f UNION SELECT id FROM b")
def reindex_since(s, d):
    return provenance.reindex_scope(activity(s, d), 600, SLOT)



# Triggers.
@query("watermarks", RUNS + f" SELECT entity, watermark, strftime(last_success, '{DTS}') AS last_success FROM marks")
def watermarks(s, d):
    return _both(s, d)[1].select("entity", "watermark", stamp("last_success").alias("last_success"))


@query("trigger_write", RUNS + " SELECT entity, count(*) AS n FROM pend WHERE type = 'purchase' AND value > 20 GROUP BY entity")
def trigger_write(s, d):
    log, marks = _both(s, d)
    return triggers.on_write(log, marks, (F.col("type") == "purchase") & (F.col("value") > 20))


for _agg, _sql, _at in (("sum", "sum(coalesce(k, 0))", 20), ("count", "count(*)", 5), ("avg", "avg(k)", 3), ("min", "min(k)", 1), ("max", "max(k)", 5), ("distinct_count", "count(DISTINCT k)", 4)):
    query(f"accumulator_{_agg.split('_')[0]}", RUNS + f" SELECT entity, count(*) AS matched, round(CAST({_sql} AS DOUBLE), 6) AS amount FROM pend GROUP BY entity HAVING {_sql} >= {_at}")(
        lambda s, d, agg=_agg, at=_at: triggers.accumulator(*_both(s, d), "k", agg, at).select("entity", "matched", F.round("amount", 6).alias("amount"))
    )


CHANGES = ", t AS (SELECT *, lag(tombstone) OVER w AS pt, lag(k) OVER w AS pk FROM log WINDOW w AS (PARTITION BY entity, collection, key, status ORDER BY seq)), c AS (SELECT *, CASE WHEN tombstone THEN CASE WHEN coalesce(pt, true) THEN 'unchanged' ELSE 'removed' END WHEN coalesce(pt, true) THEN 'added' WHEN k IS DISTINCT FROM pk THEN 'changed' ELSE 'unchanged' END AS change FROM t)"


@query("head_transitions", LOG + CHANGES + " SELECT id, change FROM c")
def head_transitions(s, d):
    return triggers.transitions(activity(s, d), SLOT, "k").select("id", "change")


@query("trigger_changed", RUNS + CHANGES + " SELECT c.entity, count(*) AS n FROM c LEFT JOIN marks m USING (entity) WHERE c.ready AND c.seq > coalesce(m.watermark, 0) AND change IN ('added', 'changed') GROUP BY c.entity")
def trigger_changed(s, d):
    log, marks = _both(s, d)
    return triggers.on_change(log, marks, SLOT, "k", ("added", "changed"))


@query("trigger_retraction", RUNS + " SELECT entity, count(*) AS n FROM pend WHERE tombstone GROUP BY entity")
def trigger_retraction(s, d):
    log, marks = _both(s, d)
    return triggers.on_write(log, marks, F.col("tombstone"))


@query("census_floor", RUNS + ", h AS (SELECT * FROM log WHERE ready QUALIFY row_number() OVER (PARTITION BY entity, coalesce(key, CAST(seq AS VARCHAR)) ORDER BY seq DESC) = 1) SELECT entity, count(*) AS live FROM h WHERE NOT tombstone AND value > 5 AND entity IN (SELECT entity FROM pend) GROUP BY entity HAVING count(*) >= 3")
def census_floor(s, d):
    return triggers.census(*_both(s, d), 3, F.col("value") > 5)


@query("lifecycle_total", RUNS + " SELECT entity, count(*) AS n FROM log WHERE ready AND entity IN (SELECT entity FROM pend) GROUP BY entity HAVING count(*) >= 30")
def lifecycle_total(s, d):
    return triggers.lifecycle(*_both(s, d), total=30)


@query("lifecycle_first", RUNS + " SELECT entity, count(*) AS n FROM log WHERE ready AND entity NOT IN (SELECT entity FROM marks) GROUP BY entity")
def lifecycle_first(s, d):
    return triggers.lifecycle(*_both(s, d))


@query("at_deadline", RUNS + f" SELECT entity, strftime(min(occurred_at - INTERVAL 600 SECOND), '{DTS}') AS due FROM log l LEFT JOIN marks m USING (entity) WHERE ready AND NOT tombstone AND (last_success IS NULL OR occurred_at - INTERVAL 600 SECOND > last_success) GROUP BY entity")
def at_deadline(s, d):
    return triggers.deadlines(*_both(s, d), "occurred_at", -600).select("entity", stamp("due").alias("due"))


@query("quiet_sessions", LOG + f", g AS (SELECT *, date_diff('second', lag(occurred_at) OVER w, occurred_at) AS gap FROM log WINDOW w AS (PARTITION BY entity ORDER BY occurred_at, seq)), b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY occurred_at, seq) AS burst FROM g) SELECT entity, strftime(min(occurred_at), '{DTS}') AS started, strftime(max(occurred_at), '{DTS}') AS ended, count(*) AS n FROM b GROUP BY entity, burst".replace("date_diff('second', lag(occurred_at) OVER w, occurred_at)", "date_diff('microsecond', lag(occurred_at) OVER w, occurred_at) // 1000000"))
def quiet_sessions(s, d):
    return triggers.quiet_periods(activity(s, d), 21600).select("entity", stamp("started").alias("started"), stamp("ended").alias("ended"), "n")


@query("cooldown_due", RUNS + f" SELECT entity, strftime(greatest(TIMESTAMP '2024-01-20', last_success + INTERVAL 3600 SECOND), '{DTS}') AS due FROM marks")
def cooldown_due(s, d):
    return triggers.cooled_down(_both(s, d)[1], "2024-01-20 00:00:00", 3600).select("entity", stamp("due").alias("due"))


@query("mailbox_coalesce", LOG + f" SELECT 'd' || (id % 2) AS derivation, entity, strftime(min(occurred_at), '{DTS}') AS earliest, strftime(max(occurred_at), '{DTS}') AS latest, array_to_string(list_sort(list(DISTINCT type)), ',') AS reasons FROM log WHERE ready GROUP BY ALL")
def mailbox_coalesce(s, d):
    asked = activity(s, d).where("ready").select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("derivation"), "entity", F.col("occurred_at").alias("due"), F.col("type").alias("reason"))
    return triggers.mailbox(asked).select("derivation", "entity", stamp("earliest").alias("earliest"), stamp("latest").alias("latest"), F.array_join("reasons", ",").alias("reasons"))


@query("freshness_dirty", RUNS + ", p AS (SELECT l.* FROM log l LEFT JOIN marks m USING (entity) WHERE l.seq > coalesce(m.watermark, 0)) SELECT e.entity, coalesce(m.watermark, 0) AS watermark, coalesce(bool_or(p.ready), false) AS dirty, coalesce(NOT arg_min(p.ready, p.seq), false) AS pending_unready FROM (SELECT DISTINCT entity FROM log) e LEFT JOIN marks m USING (entity) LEFT JOIN p ON p.entity = e.entity GROUP BY e.entity, m.watermark")
def freshness_dirty(s, d):
    return triggers.freshness(*_both(s, d))


# Enrichment.
@query("group_readiness", LOG + " SELECT id, CASE WHEN id % 5 = 0 THEN id % 7 <> 0 ELSE bool_and(id % 7 <> 0) OVER (PARTITION BY CASE WHEN id % 5 = 0 THEN NULL ELSE id // 4 END) END AS ready_now FROM log")
def group_readiness(s, d):
    n = F.col("id")
    rows = activity(s, d).select("id", F.when(n % 5 != 0, F.floor(n / 4).cast("string")).alias("run_id"), (n % 7 != 0).alias("complete"))
    return enrich.group_ready(rows).select("id", "ready_now")


@query("required_queue", LOG + ", q AS (SELECT id, seq, CASE WHEN id % 60 = 50 THEN 'r' END AS run FROM log WHERE NOT ready ORDER BY seq LIMIT 32), m AS (SELECT coalesce(min(seq), 1000000000) AS cut FROM q WHERE run IS NOT NULL) SELECT id FROM q, m WHERE seq < cut")
def required_queue(s, d):
    rows = activity(s, d).withColumn("run_id", F.when(F.col("id") % 60 == 50, "r"))
    return enrich.required_queue(rows).select("id")


@query("optional_queue", LOG + ", b AS (SELECT * FROM (VALUES ('topic', 1), ('mood', 2), ('links', 3)) t(processor, ordinal)), w AS (SELECT id, processor, ordinal FROM log, b WHERE ready AND NOT (processor = 'topic' AND id % 2 = 0) AND NOT (processor = 'mood' AND id % 4 = 0)) SELECT id, arg_min(processor, ordinal) AS processor FROM w GROUP BY id")
def optional_queue(s, d):
    log, n = activity(s, d), F.col("id")
    bindings = s.createDataFrame([("activity", "topic", 1), ("activity", "mood", 2), ("activity", "links", 3)], "collection string, processor string, ordinal int")
    done = log.where(n % 2 == 0).select("id", F.lit("topic").alias("processor")).unionByName(log.where(n % 4 == 0).select("id", F.lit("mood").alias("processor")))
    return enrich.optional_queue(log, bindings, done).select("id", "processor")


@query("annotation_write_once", LOG + " SELECT id, CASE WHEN id % 3 <> 0 THEN 'written' WHEN id % 2 = 0 THEN 'same' ELSE 'conflict' END AS verdict FROM log")
def annotation_write_once(s, d):
    rows, n = activity(s, d), F.col("id")
    old = rows.where(n % 3 == 0).select("id", F.lit("topic").alias("name"), F.col("type").alias("value"))
    new = rows.select("id", F.lit("topic").alias("name"), F.when(n % 2 == 0, F.col("type")).otherwise("other").alias("value"))
    return enrich.write_once(old, new).select("id", "verdict")


@query("marked_score", LOG + " SELECT id, CASE WHEN id % 3 = 0 THEN 5.0 ELSE least(10.0, greatest(0.0, CAST(k - 3 AS DOUBLE))) END AS importance FROM log")
def marked_score(s, d):
    note = F.when(F.col("id") % 3 == 0, "plain").otherwise(F.concat(F.lit("Risk [importance="), (F.col("k") - 3).cast("string"), F.lit("]")))
    return activity(s, d).select("id", enrich.marked_score(note, "importance", 0.0, 10.0, 5.0).alias("importance"))


@query("deterministic_embedding", "WITH h AS (SELECT doc_id, sha256('ledgerlens-embedding' || chr(0) || text || chr(0) || '0') AS h FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, list_transform(range(16), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS INTEGER) / 127.5 - 1) AS v FROM h) SELECT doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 3) AS first, round(v[16] / sqrt(list_inner_product(v, v)), 3) AS last FROM v")
def deterministic_embedding(s, d):
    made = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", vectors.deterministic_embedding(F.col("text")).alias("e"))
    return made.select("doc_id", *[F.round(F.get("e", F.lit(i)).cast("double"), 3).alias(n) for i, n in ((0, "first"), (15, "last"))])


# Rendering and budgets.
@query("truncate_middle", f"SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 38) || '{render.SENTINEL}' || right(text, 39) END AS short FROM documents".replace("\n", "' || chr(10) || '"))
def truncate_middle(s, d):
    return table(s, d, "documents").select("doc_id", render.truncate_middle(F.col("text"), 100).alias("short"))


@query("escape_untrusted", r"SELECT page_id, replace(replace(replace(html, '&', '\u0026'), '<', '\u003c'), '>', '\u003e') AS safe FROM pages")
def escape_untrusted(s, d):
    return table(s, d, "pages").select("page_id", render.escape_untrusted(F.col("html")).alias("safe"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, ceil(strlen(text) / 4.0)) AS BIGINT) AS tokens FROM documents")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", render.tokens(F.col("text")).alias("tokens"))


@query("render_compact", LOG + " SELECT id, '[id=' || id || '] ' || strftime(occurred_at, '%Y-%m-%dT%H:%M') || CASE WHEN strftime(occurred_at, '%f') <> '000000' THEN strftime(occurred_at, ':%S.%f') WHEN strftime(occurred_at, '%S') <> '00' THEN strftime(occurred_at, ':%S') ELSE '' END || 'Z | activity/' || type || ' | key ' || key || ' | ' || CASE WHEN tombstone THEN 'retracted' ELSE entity || ' <' || 'k' || '>' END AS line FROM log".replace("' <' || 'k' || '>'", r"' \u003ck\u003e'"))
def render_compact(s, d):
    log = activity(s, d)
    place = F.concat(F.lit("activity/"), F.col("type"))
    return log.select("id", render.record_line(F.col("id"), F.col("occurred_at"), place, F.col("key"), F.concat(F.col("entity"), F.lit(" <k>")), F.col("tombstone"), 500).alias("line"))


@query("token_pack_prefix", "WITH r AS (SELECT source, doc_id, sum(CAST(greatest(1, ceil(strlen(text) / 4.0)) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 5000")
def token_pack_prefix(s, d):
    rows = table(s, d, "documents").select("source", "doc_id", render.tokens(F.col("text")).alias("cost"))
    return packing.packed_prefix(rows, F.col("cost"), 5000, [F.col("doc_id")], ("source",)).select("source", "doc_id", "used")


@query("byte_page", """WITH r AS (SELECT conv_id, turn, sum(strlen('{"turn":' || turn || ',"role":"' || role || '"}') + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 90""")
def byte_page(s, d):
    return packing.byte_page(table(s, d, "conversations"), ["turn", "role"], 90, [F.col("turn")], ("conv_id",)).select("conv_id", "turn", "used")


PACKED = """WITH RECURSIVE t AS (SELECT source, doc_id, CAST(greatest(1, ceil(strlen(text) / 4.0)) AS BIGINT) AS cost FROM documents), top AS (SELECT *, row_number() OVER (ORDER BY cost DESC, doc_id) AS rank FROM t QUALIFY rank <= 800),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS n FROM top),
pack AS (SELECT source, n, doc_id, cost, cost <= 4000 AS fits, CASE WHEN cost <= 4000 THEN 4000 - cost ELSE 4000 END AS room FROM o WHERE n = 1 UNION ALL SELECT o.source, o.n, o.doc_id, o.cost, o.cost <= p.room, CASE WHEN o.cost <= p.room THEN p.room - o.cost ELSE p.room END FROM pack p JOIN o ON o.source IS NOT DISTINCT FROM p.source AND o.n = p.n + 1)
SELECT source, doc_id, cost FROM pack WHERE fits"""


@query("context_pack", PACKED)
def context_pack(s, d):
    rows = table(s, d, "documents").select("source", "doc_id", render.tokens(F.col("text")).alias("cost"))
    top = ranking.numbered(rows, [F.col("cost").desc(), F.col("doc_id")], 800).select("source", "doc_id", "cost", "rank")
    return packing.greedy_pack(top, "cost", 4000, "rank", "source").select("source", "doc_id", "cost")


@query("promotion_verdicts", LOG + ", d AS (SELECT * FROM log WHERE status = 'draft' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1), a AS (SELECT * FROM log WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1), b AS (SELECT entity, key, max(seq) AS base_seq FROM log WHERE status = 'active' AND id % 9 <> 0 GROUP BY ALL) SELECT d.entity, CASE WHEN bool_and(a.seq IS NOT NULL AND d.k IS NOT DISTINCT FROM a.k) THEN 'already' WHEN bool_or(coalesce(a.seq, 0) > coalesce(b.base_seq, 0)) THEN 'conflict' ELSE 'promote' END AS verdict, count(*) AS n FROM d LEFT JOIN a USING (entity, key) LEFT JOIN b USING (entity, key) GROUP BY d.entity")
def promotion_verdicts(s, d):
    log = activity(s, d)
    base = log.where("status = 'active' AND id % 9 <> 0").groupBy("entity", "key").agg(F.max("seq").alias("base_seq"))
    return lifecycle.promotion(log, base, "k")


@query("backfill_page", LOG + " SELECT id, seq FROM log WHERE ready AND seq > 120 AND id % 3 <> 0 ORDER BY seq LIMIT 70")
def backfill_page(s, d):
    log = activity(s, d)
    return lifecycle.backfill_page(log, log.where("id % 3 = 0"), 120, 70).select("id", "seq")


@query("contract_offenders", LOG + " SELECT collection, version, 'h' || (id % 4) AS hash, count(*) AS n, min(seq) AS first_seq FROM log WHERE NOT (version = 1 AND id % 4 IN (1, 2)) GROUP BY ALL")
def contract_offenders(s, d):
    log = activity(s, d).withColumn("hash", F.concat(F.lit("h"), (F.col("id") % 4).cast("string")))
    known = s.createDataFrame([("activity", 1, "h1"), ("activity", 1, "h2")], "collection string, version int, hash string")
    return lifecycle.contract_offenders(log, known)


@query("reference_counts", LOG + " SELECT name, count(*) AS n FROM (SELECT 'topic' AS name FROM log UNION ALL SELECT type FROM log) GROUP BY name")
def reference_counts(s, d):
    held = F.create_map(F.lit("topic"), F.lit("x"), F.col("type"), F.lit("y"))
    return lifecycle.reference_counts(activity(s, d).select(held.alias("annotations")), "annotations")


@query("lineage_faults", LINKS + " SELECT child, bool_or(parent >= child) AS bad_order, bool_or(l.id IS NULL) AS missing FROM links LEFT JOIN (SELECT id FROM log WHERE id % 5 <> 0) l ON l.id = parent GROUP BY child")
def lineage_faults(s, d):
    return lifecycle.lineage_faults(_links(s, d), activity(s, d).where("id % 5 <> 0").select("id"))


@query("outputs_page", LOG + ", r AS (SELECT entity AS run, list(id ORDER BY seq) AS o FROM log GROUP BY entity), f AS (SELECT run, unnest(o[3:5]) AS id, unnest(range(2, 2 + len(o[3:5]))) AS place FROM r) SELECT run, CAST(place AS INTEGER) AS place, id, id % 4 <> 0 AS found FROM f")
def outputs_page(s, d):
    log = activity(s, d)
    runs = log.groupBy(F.col("entity").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("outputs"))
    return lifecycle.outputs_page(runs, log.where("id % 4 <> 0"), 2, 3)


@query("index_rows", CURRENT + " SELECT l.id, l.entity, n.id IS NOT NULL AS is_current, true AS keyed, l.tombstone, 'f_' || left(sha256(l.collection || '/' || l.type), 16) AS attribute FROM log l LEFT JOIN now n USING (id)")
def index_rows(s, d):
    return lifecycle.index_rows(activity(s, d), heads.is_current(SLOT))


RENDERED = LIVE + """, a AS (SELECT entity || ' | ' || key AS line, seq FROM live), r AS (SELECT line, seq, sum(greatest(1, ceil(strlen(line) / 4.0))) OVER (ORDER BY seq DESC) AS used FROM a), n AS (SELECT n_name AS line, n_nationkey AS place, sum(greatest(1, ceil(strlen(n_name) / 4.0))) OVER (ORDER BY n_nationkey) AS used FROM nation),
x AS (SELECT '# Recent' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY seq DESC) FROM r WHERE used <= 200) || chr(10) || '# Nations' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place) FROM n WHERE used <= 60) AS text)
SELECT text, sha256(text) AS digest, CAST((SELECT count(*) FROM r WHERE used <= 200) AS INTEGER) AS n_recent, CAST((SELECT count(*) FROM n WHERE used <= 60) AS INTEGER) AS n_nations FROM x"""


@query("artifact_render", RENDERED)
def artifact_render(s, d):
    lines = scan(activity(s, d), Scope()).select("id", F.concat_ws(" | ", "entity", "key").alias("line"), (-F.col("seq")).alias("place"))
    users = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("line"), F.col("n_nationkey").alias("place"))
    made = artifacts.render("# Recent\n{{ blocks.recent }}\n# Nations\n{{ blocks.nations }}", {"recent": artifacts.Block(lines, 200), "nations": artifacts.Block(users, 60)})
    return s.createDataFrame([(made.text, made.digest, len(made.manifest["recent"]), len(made.manifest["nations"]))], "text string, digest string, n_recent int, n_nations int")


@query("answer_evidence")
def answer_evidence(s, d):
    """What an answer may cite: a hybrid search, and the edges near an anchor."""
    hits = search_hybrid(s, d).select(F.concat(F.lit("record-"), F.col("id").cast("string")).alias("handle"), F.col("rank").cast("bigint").alias("rank"), F.lit("search").alias("source"))
    edges = graph_edges(s, d)
    near = graph.citations(graph.traverse(edges, "supplier-1", 2, 10, "both"), edges)
    return hits.unionByName(near.select(F.col("edge_id").alias("handle"), F.col("first_use").cast("bigint").alias("rank"), F.lit("graph").alias("source")))


@query("catalog_listing")
def catalog_listing(s, d):
    made = catalog.Catalog.load(EXAMPLE)
    rows = [(family, c["name"], int(c["version"]), catalog.digest(c)) for family, items in made.families.items() for c in items.values()]
    return s.createDataFrame(rows, "family string, name string, version int, hash string")


EXAMPLE = """
collections:
  - name: activity
    mode: event
    schema: {type: object, required: [text], properties: {text: {type: string}, value: {type: number}}}
    fields: {value: {path: value, type: number, filter: true, sort: true}}
processors: [{name: importance, kind: score, scores: [importance]}]
derivations: [{name: profile, sources: [activity], target: profiles}]
views: [{name: top_values, parameters: {floor: {type: number, default: 1}}, query: {mode: structured, where: {value: {gte: "{{ params.floor }}"}}}}]
"""


def _load() -> None:
    """The queries of the other modules add themselves."""
    import importlib

    for name in ("derivation", "serving", "storage"):
        importlib.import_module(f"ledgerlens.queries.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
