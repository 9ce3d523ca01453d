"""Shapes that readers get, context and artifacts, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import cursors, heads, packing, predicates, projection, ranking
from ledgerlens.plans import context
from ledgerlens.registry import LOG, query, stamp
from ledgerlens.sources.records import Scope, activity, scan, table

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


def _records(s: SparkSession, d: str) -> DataFrame:
    """Events as full records: with a text, parents and the run that made them."""
    n = F.col("id")
    log = activity(s, d)
    run = F.when(n % 3 == 0, n - 3)
    return log.select(
        "*", F.concat(F.lit("value of "), "entity", F.lit(" is "), F.col("k").cast("string"), F.lit(" "), F.repeat(F.lit("and so on "), (n % 60).cast("int"))).alias("text"),
        run.alias("run_id"), F.when(n % 3 == 0, F.array(n - 3, n - 2, n - 1)).otherwise(F.array(n - 1)).alias("derived_from"), (n % 4).cast("int").alias("depth"), F.lit(1).alias("collection_version"),
        F.create_map(F.lit("importance"), F.col("k").cast("double")).alias("scores"), F.create_map(F.lit("topic"), F.col("type")).alias("annotations"),
    )


REC = LOG + ", rec AS (SELECT *, 'value of ' || entity || ' is ' || k || ' ' || repeat('and so on ', CAST(id % 60 AS INT)) AS text, CASE WHEN id % 3 = 0 THEN id - 3 END AS run_id, CASE WHEN id % 3 = 0 THEN [id - 2, id - 1] ELSE [id - 1] END AS cited FROM log)"
SHORT = "CASE WHEN length(text) <= {n} THEN text ELSE left(text, {a}) || chr(10) || '...[middle omitted]...' || right(text, {b}) END"


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("record_summary", REC + f" SELECT id, seq, key, ready, tombstone, coalesce(run_id, -1) AS run_id, {SHORT.format(n=500, a=238, b=239)} AS text, {ISO.format('occurred_at')} AS occurred_at FROM rec")
def record_summary(s, d):
    return projection.summary(_records(s, d)).select("id", "seq", "key", "ready", "tombstone", F.coalesce("run_id", F.lit(-1)).alias("run_id"), "text", "occurred_at")


@query("record_version", REC + " SELECT id, seq, entity, depth, array_to_string(cited, ',') AS citations FROM (SELECT *, CAST(id % 4 AS INT) AS depth FROM rec)")
def record_version(s, d):
    return projection.version(_records(s, d), with_entity=True).select("id", "seq", "entity", "depth", _joined("citations"))


@query("belief_view", REC + " SELECT collection, key, id, text, array_to_string(cited, ',') AS citations FROM (SELECT * FROM rec WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1) WHERE NOT tombstone")
def belief_view(s, d):
    return projection.belief(heads.document(_records(s, d))[0]).select("collection", "key", "id", "text", _joined("citations"))


@query("retraction_view", REC + " SELECT collection, key, id, seq FROM (SELECT * FROM rec WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1) WHERE tombstone")
def retraction_view(s, d):
    return projection.retraction(heads.document(_records(s, d))[1])


@query("hit_projection", REC + f", r AS (SELECT *, row_number() OVER (ORDER BY value DESC, occurred_at DESC, seq DESC, CAST(id AS VARCHAR)) AS rank FROM rec WHERE status = 'active' AND ready AND NOT tombstone QUALIFY rank <= 100) SELECT id, rank, value AS score, text, entity, {ISO.format('occurred_at')} AS occurred_at, CASE WHEN version = 2 THEN k ELSE -1 END AS amount, type AS topic FROM r")
def hit_projection(s, d):
    ranked = ranking.numbered(scan(_records(s, d), Scope()), ranking.by_relevance("value"), 100).withColumn("score", F.col("value")).withColumn("rank", F.col("rank").cast("bigint"))
    made = projection.hits(ranked, ("text", "entity", "occurred_at"), {"amount": F.when(F.col("version") == 2, F.col("k"))}, ("topic",))
    return made.select("id", "rank", "score", "text", "entity", "occurred_at", F.coalesce("fields.amount", F.lit(-1)).alias("amount"), F.col("annotations.topic").alias("topic"))


@query("map_records", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS amount, event_type AS key, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE 'u' || user_id END AS owner, 'copied' AS origin FROM events")
def map_records(s, d):
    e = table(s, d, "events")
    content = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct(F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("name")).alias("user"), F.lit("x").alias("gone")))
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), content.alias("content"))
    made = projection.map_records(rows, keep=("gone",), set_={"amount": {"from": "$.k", "cast": "bigint"}, "owner": {"from": "$.user.name", "default": "none"}, "origin": {"const": "copied"}}, drop=("gone",))
    return made.select("id", F.get_json_object("content", "$.amount").cast("bigint").alias("amount"), "key", F.get_json_object("content", "$.owner").alias("owner"), F.get_json_object("content", "$.origin").alias("origin"))


@query("context_heads", REC + ", h AS (SELECT * FROM rec WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1) SELECT id, entity FROM h WHERE NOT tombstone ORDER BY k DESC NULLS LAST, seq DESC LIMIT 200")
def context_heads(s, d):
    return context.context_heads(_records(s, d)).select("id", "entity")


@query("block_heads_all_lanes", LOG + " SELECT id, status FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1) WHERE NOT tombstone")
def block_heads_all_lanes(s, d):
    return context.block_heads(activity(s, d), "all").select("id", "status")


@query("context_sections")
def context_sections(s, d):
    """Sections for one entity: its document, what a search finds, what is recent; as a table of (section, ids, tokens)."""
    rows = _records(s, d)
    line = lambda df, place: df.select("id", F.substring("text", 1, 200).alias("line"), place.alias("place"))
    sections = {
        "document": line(context.context_heads(rows, "user-1"), -F.col("seq")),
        "search": line(rows.where(F.col("text").contains("user-2")).orderBy(F.desc("seq")).limit(200), -F.col("seq")),
        "recent": line(rows.orderBy(F.desc("seq")).limit(200), -F.col("seq")),
    }
    made = context.assemble(sections, 2000, consumer=False)
    return s.createDataFrame([(k, len(v["ids"]), v["tokens"]) for k, v in made.sections.items()], "section string, n int, tokens long")


@query("touch_on_read", LOG + ", t AS (SELECT id, TIMESTAMP '2024-01-15' AS read_at FROM log WHERE id % 6 = 0) SELECT id, strftime(greatest(occurred_at, coalesce(read_at, occurred_at)), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM log LEFT JOIN t USING (id)")
def touch_on_read(s, d):
    log = activity(s, d).withColumn("last_accessed", F.col("occurred_at"))
    reads = log.where("id % 6 = 0").select("id", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("read_at"))
    return context.touched(reads, log).select("id", stamp("last_accessed").alias("last_accessed"))


@query("artifact_snapshots", REC + ", made AS (SELECT entity AS artifact, string_agg(type, ',' ORDER BY seq) AS text, list(id ORDER BY id)[1:255] AS inputs FROM rec WHERE id % 9 = 0 GROUP BY entity) SELECT 'snapshots' AS collection, artifact AS key, 'draft' AS status, sha256(text) AS digest, CAST(len(inputs) AS INT) AS n FROM made WHERE CAST(substr(artifact, 6) AS BIGINT) % 2 = 1")
def artifact_snapshots(s, d):
    rows = _records(s, d).where("id % 9 = 0").groupBy(F.col("entity").alias("artifact")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda x: x["type"]), ",").alias("text"), F.array_sort(F.collect_list("id")).alias("inputs"), F.lit("h").alias("definition_hash"))
    even = F.substring("artifact", 6, 20).cast("long") % 2 == 0
    current = rows.where(even).select(F.lit("snapshots").alias("collection"), F.lit("active").alias("status"), F.col("artifact").alias("key"), F.sha2("text", 256).alias("digest"), F.lit(1).alias("seq"))
    made = context.artifact_snapshot(rows, current, "snapshots", reviewed=True)
    return made.select("collection", "key", "status", "digest", F.size("derived_from").alias("n"))


@query("learning_targets", REC + ", h AS (SELECT * FROM rec WHERE status = 'active' AND id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY entity, collection, key ORDER BY seq DESC) = 1) SELECT entity, min(run_id // 3000) AS base_run, count(*) AS heads FROM h WHERE NOT tombstone GROUP BY entity HAVING count(DISTINCT run_id // 3000) = 1")
def learning_targets(s, d):
    now = context.block_heads(_records(s, d).where("id % 3 = 0")).withColumn("run_id", F.floor(F.col("run_id") / 3000))
    return context.learning_target(now).select("entity", "base_run", "heads")


@query("feedback_signals", LOG + " SELECT id AS use_id, entity, 'Feedback rating from user on brief' || CASE WHEN id % 2 = 0 THEN ': good' ELSE '' END AS text FROM log WHERE id % 50 = 0")
def feedback_signals(s, d):
    log = activity(s, d).where("id % 50 = 0")
    uses = log.select(F.col("id").alias("use_id"), F.lit("brief").alias("artifact"), F.lit("d").alias("digest"), "entity")
    signals = log.select(F.col("id").alias("use_id"), F.lit("rating").alias("kind"), F.lit("user").alias("source"), F.when(F.col("id") % 2 == 0, "good").alias("label"), F.col("value").alias("score"))
    return context.feedback(uses, signals).select("use_id", "entity", "text")


@query("artifact_uses_expired", LOG + " SELECT id AS use_id FROM log WHERE id % 8 = 0 AND occurred_at <= TIMESTAMP '2024-01-10' ORDER BY occurred_at, id LIMIT 60")
def artifact_uses_expired(s, d):
    uses = activity(s, d).where("id % 8 = 0").select(F.col("id").alias("use_id"), F.col("occurred_at").alias("expires_at"))
    return context.expired_uses(uses, "2024-01-10 00:00:00", 60).select("use_id")


@query("cursor_upsert", LOG + ", c AS (SELECT entity AS consumer, 's' || (count(*) % 2) AS scope_hash, max(seq) FILTER (id % 2 = 0) AS position FROM log WHERE id % 3 <> 0 GROUP BY entity), u AS (SELECT entity AS consumer, 's1' AS scope_hash, max(seq) FILTER (id % 5 = 0) AS position, entity LIKE '%7' AS force FROM log WHERE id % 5 < 3 GROUP BY entity), j AS (SELECT coalesce(c.consumer, u.consumer) AS consumer, c.scope_hash AS a, u.scope_hash AS b, c.position AS p, u.position AS q, force FROM c FULL JOIN u USING (consumer)), v AS (SELECT *, CASE WHEN b IS NULL THEN 'untouched' WHEN a IS NULL THEN 'created' WHEN a <> b THEN 'scope_differs' WHEN force OR q > p THEN 'moved' ELSE 'kept' END AS verdict FROM j) SELECT consumer, coalesce(a, b) AS scope_hash, CASE WHEN verdict IN ('created', 'moved') THEN q ELSE p END AS position, verdict FROM v")
def cursor_upsert(s, d):
    log = activity(s, d)
    known = log.where("id % 3 <> 0").groupBy(F.col("entity").alias("consumer")).agg(F.concat(F.lit("s"), (F.count("*") % 2).cast("string")).alias("scope_hash"), F.max(F.when(F.col("id") % 2 == 0, F.col("seq"))).alias("position"))
    updates = log.where("id % 5 < 3").groupBy(F.col("entity").alias("consumer")).agg(F.lit("s1").alias("scope_hash"), F.max(F.when(F.col("id") % 5 == 0, F.col("seq"))).alias("position")).withColumn("force", F.col("consumer").endswith("7"))
    return cursors.upsert(known, updates)


@query("cursor_rebind", LOG + " SELECT entity, CASE WHEN entity LIKE '%1' THEN 'new' ELSE 'other' END AS contract_hash, CASE WHEN entity LIKE '%1' THEN 0 ELSE max(seq) END AS watermark FROM log GROUP BY entity")
def cursor_rebind(s, d):
    marks = activity(s, d).groupBy("entity").agg(F.max("seq").alias("watermark")).withColumn("contract_hash", F.when(F.col("entity").endswith("1"), "old").otherwise("other"))
    return cursors.rebind(marks, "old", "new", carry=False).drop("rebound")


@query("delta_of_cursor", LOG + " SELECT seq, entity FROM log WHERE seq > 250 ORDER BY seq LIMIT 30")
def delta_of_cursor(s, d):
    scope = {"collections": ["activity"], "statuses": ["active", "draft"]}
    stored = {"position": 250, "scope_hash": cursors.scope_hash({"statuses": ["draft", "active"], "collections": ["activity"]})}
    return cursors.delta_of(activity(s, d), stored, scope, 30).select("seq", "entity")


@query("bounded_page", "WITH r AS (SELECT conv_id, turn, sum(strlen('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}') + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used, strlen('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}') + 1 AS own FROM conversations) SELECT conv_id, turn, CASE WHEN own > 30 THEN 'oversize' WHEN used <= 90 THEN 'in' ELSE 'later' END AS place FROM r")
def bounded_page(s, d):
    return packing.paged(table(s, d, "conversations"), ["turn", "role"], 90, [F.col("turn")], ("conv_id",), most_item=30).select("conv_id", "turn", "place")


@query("typed_order", LOG + " SELECT id, k FROM log WHERE k > 1 AND version IN (1) AND status = 'active' AND ready AND NOT tombstone")
def typed_order(s, d):
    """A scope with pinned versions and a predicate whose legality is checked against each of them."""
    declared = {1: {"k": {"type": "integer", "filter": True, "sort": True}}}
    kinds = predicates.legal({"k": {"gt": 1}}, declared, order=("k",))
    return predicates.where(scan(activity(s, d), Scope(versions={"activity": (1,)})), {"k": {"gt": 1}}, kinds).select("id", "k")


@query("public_score_of_all", LOG + ", live AS (SELECT * FROM log WHERE status = 'active' AND ready AND NOT tombstone), b AS (SELECT min(value) AS low, max(value) AS high FROM live) SELECT id, round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 1 END, 6) AS score FROM live, b")
def public_score_of_all(s, d):
    return ranking.scored_publicly(scan(activity(s, d), Scope()), "value").select("id", F.round("score", 6).alias("score"))
