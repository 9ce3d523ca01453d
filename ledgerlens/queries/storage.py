"""Ingest, erasure and retention, evolution of stored data, audits, graphs over declared roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import json_schema
from ledgerlens.operators import enrich, extract, graph, lifecycle, provenance, storage, triggers
from ledgerlens.plans import artifacts
from ledgerlens.plans.search import Source, run_source
from ledgerlens.registry import LOG, RUNS, _runs, query
from ledgerlens.session import spread
from ledgerlens.sources.records import activity, append, batch_depths, ingest, table

# Ingest: a batch of copies, changed copies, and new rows of which two share a key.
BATCH = LOG + """, old AS (SELECT id, CAST(value AS VARCHAR) AS content, 'd' || id AS dedupe_key FROM log),
batch AS (SELECT id, CASE WHEN id % 4 = 1 THEN 'other' WHEN id % 12 = 7 THEN 'x' ELSE 'c' || (id // 8) END AS content, CASE WHEN id % 4 < 2 THEN 'd' || id ELSE 'n' || (id // 4) END AS dedupe_key, id % 4 = 0 AS same FROM log),
judged AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'duplicate' WHEN id % 4 = 1 THEN 'conflict' WHEN id % 4 = 2 THEN 'inserted' WHEN first IS NULL OR first = id THEN 'inserted' WHEN content = first_content THEN 'duplicate' ELSE 'conflict' END AS verdict
  FROM (SELECT *, min(id) OVER (PARTITION BY dedupe_key) AS first, arg_min(content, id) OVER (PARTITION BY dedupe_key) AS first_content FROM batch))"""


def _plain(s: SparkSession, d: str) -> DataFrame:
    return activity(s, d).select("id", "seq", "collection", "type", "status", F.col("value").cast("string").alias("content"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("dedupe_key"))


def _batch(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    content = F.when(n % 4 == 0, F.col("content")).when(n % 4 == 1, "other").when(n % 12 == 7, "x").otherwise(F.concat(F.lit("c"), F.floor(n / 8).cast("string")))
    key = F.when(n % 4 < 2, F.col("dedupe_key")).otherwise(F.concat(F.lit("n"), F.floor(n / 4).cast("string")))
    one = [F.when(n % 4 < 2, F.col(c)).otherwise("new").alias(c) for c in ("type", "status")]
    return _plain(s, d).select("id", "collection", *one, content.alias("content"), key.alias("dedupe_key"))


@query("ingest_dedupe", BATCH + " SELECT id, verdict FROM judged")
def ingest_dedupe(s, d):
    return ingest(_plain(s, d), _batch(s, d)).select("id", "verdict")


@query("ingest_append", BATCH + ", fresh AS (SELECT id FROM judged WHERE verdict = 'inserted' AND id % 4 = 2) SELECT id, CAST((SELECT max(seq) FROM log) + row_number() OVER (ORDER BY id) AS BIGINT) AS seq, true AS fresh FROM fresh UNION ALL SELECT id, seq, false FROM log")
def ingest_append(s, d):
    log = _plain(s, d)
    judged = ingest(log, _batch(s, d).where("id % 4 = 2")).withColumn("ordinal", F.col("id"))
    made = append(log.withColumn("fresh", F.lit(False)), judged.withColumn("fresh", F.lit(True)), most=None)
    return made.select("id", "seq", "fresh")


@query("ingest_conflict_is_atomic", LOG + " SELECT id, seq FROM log")
def ingest_conflict_is_atomic(s, d):
    log = _plain(s, d)
    return append(log, ingest(log, _batch(s, d)).withColumn("ordinal", F.col("id")), most=None).select("id", "seq")


SCHEMA = {
    "type": "object", "required": ["text", "value"], "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 8, "pattern": "^user"}, "value": {"type": "number", "maximum": 50}, "kind": {"type": "string", "enum": ["click", "view", "error"]}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}},
}


def _contents(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    tags = F.when(n % 5 == 0, F.lit('["a",1]')).when(n % 7 == 0, F.lit('["a","b","c"]')).otherwise(F.lit('["a"]'))
    shown = F.when(n % 11 == 0, F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("k").cast("string"))
    value = F.when(n % 13 != 0, F.concat(F.lit(',"value":'), shown)).otherwise(F.lit(""))
    more = F.when(n % 17 == 0, F.lit(',"more":true')).otherwise(F.lit(""))
    json = F.concat(F.lit('{"text":"'), F.col("entity"), F.lit('","kind":"'), F.col("type"), F.lit('","tags":'), tags, value, more, F.when(n % 19 == 0, F.lit("")).otherwise(F.lit("}")))
    return activity(s, d).select("id", json.alias("content"))


@query("schema_violations", LOG + """ SELECT id, CASE WHEN id % 19 = 0 THEN 'json' ELSE array_to_string(list_filter([CASE WHEN id % 13 = 0 THEN 'required:$.value' END, CASE WHEN length(entity) < 8 THEN 'minLength:$.text' END,
 CASE WHEN id % 13 <> 0 AND id % 11 = 0 THEN 'type:$.value' END, CASE WHEN id % 13 <> 0 AND id % 11 <> 0 AND k > 50 THEN 'maximum:$.value' END, CASE WHEN type NOT IN ('click', 'view', 'error') THEN 'enum:$.kind' END, CASE WHEN id % 5 = 0 THEN 'items:$.tags' END, CASE WHEN id % 5 <> 0 AND id % 7 = 0 THEN 'maxItems:$.tags' END, CASE WHEN id % 17 = 0 THEN 'additional:$' END], lambda x: x IS NOT NULL), ',') END AS faults FROM log""")
def schema_violations(s, d):
    return json_schema.checked(spread(_contents(s, d)), "content", SCHEMA).select("id", F.array_join("faults", ",").alias("faults"))


@query("ingest_depths", LOG + ", b AS (SELECT id + 1000000 AS id, entity, key, status, unnest([id, id - 7]) AS parent FROM log WHERE id % 3 = 0), h AS (SELECT id, entity, key, status FROM log QUALIFY row_number() OVER (PARTITION BY entity, collection, key, status ORDER BY seq DESC) = 1), f AS (SELECT b.id, max(p.id % 6 + CASE WHEN b.parent = h.id THEN 0 ELSE 1 END) AS depth, bool_or(p.id IS NULL) AS missing FROM b LEFT JOIN h USING (entity, key, status) LEFT JOIN log p ON p.id = b.parent GROUP BY b.id) SELECT id, CAST(coalesce(depth, 0) AS INT) AS depth, CASE WHEN missing THEN 'parent_missing' WHEN depth > 4 THEN 'depth_limit' END AS fault FROM f")
def ingest_depths(s, d):
    log = activity(s, d).withColumn("depth", (F.col("id") % 6).cast("int"))
    batch = log.where("id % 3 = 0").withColumn("derived_from", F.array(F.col("id"), F.col("id") - 7)).withColumn("id", F.col("id") + 1_000_000).withColumn("seq", F.col("seq") + 1_000_000)
    return batch_depths(log, batch)


# Erasure and retention.
RUNLINKS = LOG + """, rows0 AS (SELECT id, collection, occurred_at, entity, key, status, tombstone, seq, CASE WHEN id % 5 = 0 THEN id - 5 END AS run_id, [id // 3] AS parents FROM log),
links AS (SELECT id AS child, unnest(parents) AS parent FROM rows0 WHERE id % 2 = 1)"""


def _lineage(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    return activity(s, d).withColumn("run_id", F.when(n % 5 == 0, n - 5)).withColumn("derived_from", F.when(n % 2 == 1, F.array(F.floor(n / 3)))).withColumn("created_at", F.col("occurred_at") + F.expr("INTERVAL 2 DAY"))


@query("erasure_with_runs", RUNLINKS + ", seeds AS (SELECT id FROM rows0 WHERE id IN (10, 25, 70) UNION SELECT run_id FROM rows0 WHERE id IN (10, 25, 70) AND run_id IS NOT NULL), reach(id) AS (SELECT id FROM seeds UNION SELECT l.child FROM reach r JOIN links l ON l.parent = r.id) SELECT id FROM reach")
def erasure_with_runs(s, d):
    log = _lineage(s, d)
    return provenance.erasure_scope(log, log.where("id IN (10, 25, 70)")).select("id")


@query("erasure_chain", LOG + ", links AS (SELECT id AS child, id - 1 AS parent FROM log WHERE id % 200 <> 0), reach(id) AS (SELECT id FROM log WHERE id = 0 UNION SELECT l.child FROM reach r JOIN links l ON l.parent = r.id) SELECT id FROM reach")
def erasure_chain(s, d):
    """All rows are in chains of 200, each row citing the one before it: the closure of a first row is its chain."""
    log = activity(s, d)
    edges = log.where("id % 200 <> 0").select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    return provenance.closure(edges, log.where("id = 0").select("id")).select("id")


@query("lineage_depth_chain", LOG + " SELECT id, CAST(id % 110 AS INT) AS depth FROM log")
def lineage_depth_chain(s, d):
    """All rows are in chains of 110."""
    log = activity(s, d)
    edges = log.where("id % 110 <> 0").select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    return provenance.depths(log.select("id"), edges)


@query("retention_closure", RUNLINKS + ", slots AS (SELECT entity, key, status FROM (SELECT * FROM rows0 QUALIFY row_number() OVER (PARTITION BY entity, key, status ORDER BY seq DESC) = 1) WHERE tombstone AND occurred_at + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31'), own AS (SELECT id, run_id FROM rows0 SEMI JOIN slots USING (entity, key, status)), seeds AS (SELECT id FROM own UNION SELECT run_id FROM own WHERE run_id IS NOT NULL), reach(id) AS (SELECT id FROM seeds UNION SELECT l.child FROM reach r JOIN links l ON l.parent = r.id) SELECT id FROM reach SEMI JOIN rows0 USING (id)")
def retention_closure(s, d):
    log, slot = _lineage(s, d), ("entity", "key", "status")
    return provenance.purge(log, provenance.expired_slots(log, slot, "2024-01-31 00:00:00", time="created_at"), slot)


@query("erasure_digests", LOG + ", ids AS (SELECT type AS collection, CAST(id AS VARCHAR) AS id, left(sha256(CAST(id AS VARCHAR)), 2) AS part FROM log WHERE id % 3 = 0), p AS (SELECT collection, part, count(*) AS n, sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)) AS digest FROM ids GROUP BY ALL) SELECT collection, CAST(sum(n) AS BIGINT) AS erased, sha256(string_agg(digest, '' ORDER BY part)) AS digest FROM p GROUP BY collection")
def erasure_digests(s, d):
    return storage.erasure_digests(activity(s, d).where("id % 3 = 0").select(F.col("type").alias("collection"), "id"))


@query("ancestry_faults", LOG + ", l AS (SELECT id AS child, CASE WHEN id % 50 = 0 THEN id + 1 WHEN id % 51 = 0 THEN id ELSE id // 2 END AS parent, 't' || (id % 2) AS tenant FROM log WHERE id > 3) SELECT l.child, bool_or(l.parent = l.child) AS cycle, bool_or(p.seq >= c.seq) AS bad_order, bool_or(p.id IS NOT NULL AND 't' || (p.id % 2) <> l.tenant) AS foreign_tenant, bool_or(p.id IS NULL) AS missing FROM l JOIN log c ON c.id = l.child LEFT JOIN log p ON p.id = l.parent GROUP BY l.child")
def ancestry_faults(s, d):
    n = F.col("id")
    log = activity(s, d).withColumn("workspace", F.concat(F.lit("t"), (n % 2).cast("string")))
    edges = log.where("id > 3").select(n.alias("child"), F.when(n % 50 == 0, n + 1).when(n % 51 == 0, n).otherwise(F.floor(n / 2)).alias("parent"))
    return provenance.ancestry_faults(edges, log)


# Evolution and audits.
@query("hash_rewrite", LOG + " SELECT id, CASE WHEN version = 1 AND id % 4 = 1 THEN 'new' ELSE 'h' || (id % 4) END AS hash FROM log")
def hash_rewrite(s, d):
    rows = activity(s, d).withColumn("hash", F.concat(F.lit("h"), (F.col("id") % 4).cast("string")))
    return storage.rewrite_hash(rows, "activity", 1, "h1", "new").select("id", "hash")


@query("rewrite_offenders", LOG + " SELECT id, CASE WHEN k > 60 THEN 'maximum:$.k' || CASE WHEN id % 10 = 0 THEN ',annotation:mood' ELSE '' END ELSE 'annotation:mood' END AS faults FROM log WHERE k > 60 OR id % 10 = 0")
def rewrite_offenders(s, d):
    e = table(s, d, "events")
    n = F.col("event_id")
    rows = e.select(n.alias("id"), F.col("props").alias("content"), F.when(n % 10 == 0, F.create_map(F.lit("mood"), F.lit("x"))).otherwise(F.create_map(F.lit("topic"), F.lit("x"))).alias("annotations"))
    return storage.rewrite_offenders(rows, {"k": {"type": "integer", "maximum": 60}}, ("mood",)).select("id", F.array_join("faults", ",").alias("faults"))


@query("vector_cutover", "SELECT vec_id AS id, CASE WHEN vec_id % 5 <> 0 THEN label + 100 ELSE -1 END AS vector, label AS old_vector, vec_id % 5 = 0 AS pending FROM embeddings")
def vector_cutover(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("v1").alias("space"), F.col("label").alias("vector"))
    staged = rows.where("id % 5 <> 0").select("id", (F.col("vector") + 100).alias("vector"))
    return storage.cutover(rows, staged, "v2").select("id", F.coalesce("vector", F.lit(-1)).alias("vector"), "old_vector", "pending")


@query("vector_audit", LOG + " SELECT 's' || (id % 3) AS vector_space, 'm' || (id % 2) AS vector_model, count(*) AS n, min(id) AS first_id FROM log WHERE NOT (id % 3 = 0 AND id % 2 = 0) GROUP BY ALL")
def vector_audit(s, d):
    n = F.col("id")
    rows = activity(s, d).select("id", F.concat(F.lit("s"), (n % 3).cast("string")).alias("vector_space"), F.concat(F.lit("m"), (n % 2).cast("string")).alias("vector_model"))
    return storage.vector_audit(rows, "s0", "m0")


@query("processor_audit", LOG + ", m AS (SELECT id, 'topic' AS name, 'h' || (id % 3) AS hash FROM log UNION ALL SELECT id, 'gone', 'x' FROM log WHERE id % 7 = 0 UNION ALL SELECT id, 'mood', NULL FROM log WHERE id % 9 = 0) SELECT name, CASE name WHEN 'gone' THEN 'unknown' ELSE 'hash' END AS fault, count(*) AS n, min(id) AS first_id FROM m WHERE name = 'gone' OR name = 'topic' AND hash <> 'h1' GROUP BY ALL")
def processor_audit(s, d):
    n = F.col("id")
    none = F.create_map().cast("map<string,string>")
    rows = activity(s, d).select("id", F.create_map(F.lit("topic"), F.lit("v")).alias("annotations"), F.create_map(F.lit("topic"), F.concat(F.lit("h"), (n % 3).cast("string"))).alias("annotation_meta"), F.map_concat(F.when(n % 7 == 0, F.create_map(F.lit("gone"), F.lit("x"))).otherwise(none), F.when(n % 9 == 0, F.create_map(F.lit("mood"), F.lit("x"))).otherwise(none)).alias("terminal"))
    return storage.processor_audit(rows, {"topic": "h1", "mood": "m1"})


@query("contract_audit", LOG + " SELECT collection, version, 'h' || (id % 4) AS hash, count(*) AS n, min(id) AS first_id FROM log WHERE NOT (version = 1 AND id % 4 < 3) GROUP BY ALL")
def contract_audit(s, d):
    rows = activity(s, d).withColumn("hash", F.concat(F.lit("h"), (F.col("id") % 4).cast("string")))
    return storage.contract_audit(rows, s.createDataFrame([("activity", 1, f"h{k}") for k in range(3)], "collection string, version int, hash string"))


@query("job_status", LOG + ", j AS (SELECT id AS job, CASE WHEN id % 3 > 0 THEN occurred_at END AS started_at, CASE WHEN id % 3 = 2 THEN occurred_at + INTERVAL 90 SECOND END AS done_at, CASE WHEN id % 30 = 20 THEN 'bad' END AS error FROM log WHERE id % 10 = 0), r AS (SELECT id // 10 * 10 AS job, list(id ORDER BY id DESC) AS runs FROM log WHERE id % 10 IN (1, 2) GROUP BY ALL) SELECT job, CASE WHEN done_at IS NOT NULL THEN CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END WHEN started_at IS NOT NULL THEN 'running' ELSE 'waiting' END AS state, coalesce(date_diff('second', started_at, done_at), -1) AS seconds, coalesce(array_to_string(runs, ','), '') AS runs FROM j LEFT JOIN r USING (job)")
def job_status(s, d):
    n, log = F.col("id"), activity(s, d)
    started = F.when(n % 3 > 0, F.col("occurred_at"))
    done = F.when(n % 3 == 2, F.col("occurred_at") + F.expr("INTERVAL 90 SECOND"))
    jobs = log.where("id % 10 = 0").select(n.alias("job"), started.alias("started_at"), done.alias("done_at"), F.when(n % 30 == 20, "bad").alias("error"), F.lit(1).alias("attempts"))
    runs = log.where("id % 10 IN (1, 2)").select((F.floor(n / 10) * 10).alias("job"), n.alias("run"), "seq")
    return storage.job_status(jobs, runs).select("job", "state", F.coalesce("seconds", F.lit(-1)).alias("seconds"), F.array_join(F.col("runs").cast("array<string>"), ",").alias("runs"))


@query("entity_page", LOG + " SELECT DISTINCT entity FROM log WHERE entity > 'user-12' ORDER BY entity LIMIT 60")
def entity_page(s, d):
    return storage.entity_page(activity(s, d), "user-12", 60)


@query("subset_faults", LOG + " SELECT id, type AS extra, CASE WHEN status <> 'active' THEN 'active' ELSE '' END AS missing FROM log WHERE type IN ('click', 'view') UNION ALL SELECT id, '', 'active' FROM log WHERE type NOT IN ('click', 'view') AND status <> 'active'")
def subset_faults(s, d):
    rows = activity(s, d).select("id", F.array("type", "status").alias("have"))
    made = storage.subset_faults(rows, "have", F.array(*map(F.lit, ("purchase", "signup", "error", "active", "draft"))), F.array(F.lit("active")))
    return made.select("id", F.array_join("extra", ",").alias("extra"), F.array_join("missing", ",").alias("missing"))


@query("owned_listing", "SELECT 'regions' AS family, r_name AS name, 1 AS version FROM region UNION ALL SELECT 'nations', n_name, n_nationkey % 3 + 1 FROM nation")
def owned_listing(s, d):
    families = {"regions": [{"name": r["r_name"]} for r in table(s, d, "region").collect()], "nations": [{"name": r["n_name"], "version": r["n_nationkey"] % 3 + 1} for r in table(s, d, "nation").collect()]}  # two dimension tables of fixed size
    return storage.listing(families, s).select("family", "name", "version")


# Graphs.
ORPHANS = """WITH nodes AS (SELECT 'customer' AS entity, 'c' || c_custkey AS key, c_custkey * 10 + 1 AS seq, c_custkey % 9 = 0 AS tombstone, c_custkey % 10 <> 3 AS ready FROM customer UNION ALL SELECT 'customer', 'c' || c_custkey, c_custkey * 10, false, true FROM customer),
cur AS (SELECT * FROM nodes WHERE ready QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1),
edges AS (SELECT 'customer' AS entity, 'c' || o_custkey AS subject, 'c' || (o_custkey + 1) AS object, CASE o_orderkey % 3 WHEN 0 THEN [o_custkey * 10] WHEN 1 THEN [o_custkey * 10 + 1] ELSE [] END AS cites, o_orderkey % 4 <> 0 AS ready FROM orders WHERE o_orderkey % 5 < 2),
live AS (SELECT e.* FROM edges e WHERE ready AND (NOT EXISTS (SELECT 1 FROM nodes n WHERE n.entity = e.entity AND n.key = e.subject AND list_contains(e.cites, n.seq)) OR EXISTS (SELECT 1 FROM cur n WHERE n.entity = e.entity AND n.key = e.subject AND NOT n.tombstone AND list_contains(e.cites, n.seq))))
SELECT key FROM cur n WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM live e WHERE e.entity = n.entity AND (e.subject = n.key OR e.object = n.key))"""


@query("graph_orphans_live", ORPHANS)
def graph_orphans_live(s, d):
    """Customers with two versions each, and orders as edges to the next customer that cite one version or none."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    n = F.col("c_custkey")
    key = F.concat(F.lit("c"), n.cast("string"))
    newer = c.select(F.lit("customer").alias("entity"), key.alias("key"), (n * 10 + 1).alias("seq"), (n % 9 == 0).alias("tombstone"), (n % 10 != 3).alias("ready"))
    nodes = newer.unionByName(c.select(F.lit("customer").alias("entity"), key.alias("key"), (n * 10).alias("seq"), F.lit(False).alias("tombstone"), F.lit(True).alias("ready"))).withColumn("id", F.col("seq"))
    m, form = F.col("o_custkey"), F.col("o_orderkey") % 3
    cites = F.when(form == 0, F.array(m * 10)).when(form == 1, F.array(m * 10 + 1)).otherwise(F.array().cast("array<bigint>"))
    edges = o.where("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("edge_id"), F.lit("customer").alias("entity"), F.concat(F.lit("c"), m.cast("string")).alias("subject"), F.concat(F.lit("c"), (m + 1).cast("string")).alias("object"), cites.alias("derived_from"), (F.col("o_orderkey") % 4 != 0).alias("ready"), F.lit(False).alias("tombstone"), F.lit("active").alias("status"))
    return graph.live_orphans(nodes, edges).select("key")


@query("graph_roles", LOG + " SELECT id AS edge_id, entity AS subject, type AS object, CASE WHEN version = 2 THEN 'k' || k END AS predicate FROM log WHERE status = 'active' AND ready AND NOT tombstone")
def graph_roles(s, d):
    content = F.to_json(F.struct(F.struct(F.col("entity").alias("who")).alias("from"), F.col("type").alias("to"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("how")))
    rows = activity(s, d).withColumn("content", content)
    roles = {"subject": {1: "$.from.who", 2: "$.from.who"}, "object": {1: "$.to", 2: "$.to"}, "predicate": {2: "$.how"}}
    return graph.edges_of(rows, roles).select(F.col("id").alias("edge_id"), "subject", "object", "predicate")


# Extraction from real texts.
@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"#]+)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l GROUP BY ALL""")
def page_links(s, d):
    return extract.page_links(table(s, d, "pages"))


@query("message_terms", r"""WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS term FROM conversations) SELECT role, term, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM w GROUP BY ALL""")
def message_terms(s, d):
    return extract.terms(table(s, d, "conversations"), r"[A-Z][a-z]{3,}", "role", "conv_id").withColumnRenamed("keys", "conversations")


@query("link_extract", "SELECT 'docs/doc-' || doc_id AS subject, 'companies/' || coalesce(source, 'none') AS object, 'works_at' AS predicate, 'bare-slug' AS link_source, 0.95::DOUBLE AS confidence, doc_id AS page FROM documents UNION ALL SELECT 'docs/doc-' || doc_id, 'docs/doc-' || (doc_id + 1), 'wikilink_basename', 'wikilink-resolved', 1.0, doc_id FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)")
def link_extract(s, d):
    return extract.relations(extract.noted(table(s, d, "documents")), ("docs", "people", "companies"))


@query("fact_extract", "SELECT doc_id AS id, 'docs/doc-' || doc_id AS key, CAST(1 AS INTEGER) AS ordinal, 'Source: ' || coalesce(source, 'none') AS fact FROM documents UNION ALL SELECT doc_id, 'docs/doc-' || doc_id, 2, 'Language: ' || coalesce(lang, 'none') || ' as labelled' FROM documents")
def fact_extract(s, d):
    return extract.facts(extract.noted(table(s, d, "documents")), "facts")


# Enrichment.
@query("json_annotations", LOG + " SELECT id, CASE WHEN id % 8 = 0 THEN 'json' WHEN k > 70 THEN 'maximum:$.level' ELSE '' END AS faults, CASE WHEN id % 8 <> 0 AND k <= 70 THEN CAST(k AS DOUBLE) END AS level FROM log")
def json_annotations(s, d):
    raw = F.when(F.col("id") % 8 == 0, F.lit("{bad")).otherwise(F.to_json(F.struct(F.col("k").alias("level"), F.col("type").alias("mood"))))
    made = enrich.json_annotation(activity(s, d).withColumn("raw", raw), "raw", {"type": "object", "required": ["level"], "properties": {"level": {"type": "integer", "maximum": 70}}}, {"level": "$.level"})
    return made.select("id", F.array_join("faults", ",").alias("faults"), F.col("scores")["level"].alias("level"))


@query("terminal_markers", LOG + " SELECT id, CASE WHEN id % 6 = 0 THEN 'mood' ELSE 'topic' END AS processor FROM log WHERE ready AND id % 12 <> 0 AND id % 5 <> 4")
def terminal_markers(s, d):
    log = activity(s, d).where("id % 5 <> 4")
    bindings = s.createDataFrame([("activity", "topic", 1), ("activity", "mood", 2)], "collection string, processor string, ordinal int")
    nothing = log.limit(0).select("id", F.lit("topic").alias("processor"))
    failed = log.where("id % 6 = 0").select("id", F.lit("topic").alias("processor")).unionByName(log.where("id % 12 = 0").select("id", F.lit("mood").alias("processor")))
    return enrich.optional_queue(log, bindings, nothing, failed).select("id", "processor")


@query("embedding_batches", "SELECT doc_id AS id, true AS has_vector FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, false FROM documents WHERE text IS NULL")
def embedding_batches(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("tombstone"))
    return enrich.embed(rows, enrich.HashEmbedder(16)).select("id", F.col("vector").isNotNull().alias("has_vector"))


@query("token_batches", "SELECT conv_id, turn, CASE WHEN strlen(text) > 0 THEN true ELSE true END AS dealt FROM conversations")
def token_batches(s, d):
    from ledgerlens.functions.render import tokens
    from ledgerlens.operators.packing import token_batches as deal

    rows = table(s, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("cost"))
    return deal(rows, "cost", 500, 4, [F.col("turn")], ("conv_id",)).select("conv_id", "turn", F.col("batch").isNotNull().alias("dealt"))


@query("pending_by_processor", RUNS + " SELECT entity, count(*) AS waiting FROM pend GROUP BY entity HAVING count(*) > 10")
def pending_by_processor(s, d):
    log = activity(s, d)
    return triggers.pending(log, triggers.watermarks(_runs(log))).groupBy("entity").agg(F.count("*").alias("waiting")).where("waiting > 10")


@query("promotion_rows", LOG + ", d AS (SELECT * FROM log WHERE status = 'draft' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1), a AS (SELECT entity, key, max(seq) AS seq, arg_max(k, seq) AS k FROM log WHERE status = 'active' GROUP BY ALL), b AS (SELECT entity, key, max(seq) AS base_seq FROM log WHERE status = 'active' AND id % 9 <> 0 GROUP BY ALL), v AS (SELECT d.entity FROM d LEFT JOIN a USING (entity, key) LEFT JOIN b USING (entity, key) GROUP BY d.entity HAVING NOT bool_and(a.seq IS NOT NULL AND d.k IS NOT DISTINCT FROM a.k) AND NOT bool_or(coalesce(a.seq, 0) > coalesce(b.base_seq, 0))) SELECT d.id AS promoted_from, d.entity, d.key, 'active' AS status, (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY d.entity, d.key) AS seq FROM d SEMI JOIN v USING (entity)")
def promotion_rows(s, d):
    log = activity(s, d)
    base = log.where("status = 'active' AND id % 9 <> 0").groupBy("entity", "key").agg(F.max("seq").alias("base_seq"))
    return lifecycle.promoted(log, lifecycle.promotion(log, base, "k")).select("promoted_from", "entity", "key", "status", "seq")


@query("all_references", LOG + " SELECT 'collection' AS kind, collection || '@' || version AS name, count(*) AS n FROM log GROUP BY ALL UNION ALL SELECT 'annotation', type, count(*) FROM log GROUP BY ALL UNION ALL SELECT 'derivation', CASE WHEN id % 50 = 0 THEN 'p' ELSE 'q' END, count(*) FROM log WHERE id % 25 = 0 GROUP BY ALL UNION ALL SELECT 'artifact', 'brief', count(*) FROM log WHERE id % 8 = 0")
def all_references(s, d):
    log = activity(s, d).withColumn("annotations", F.create_map("type", F.lit("x")))
    runs = log.where("id % 25 = 0").select(F.when(F.col("id") % 50 == 0, "p").otherwise("q").alias("processor"))
    return lifecycle.all_references(log, runs, log.where("id % 8 = 0").select(F.lit("brief").alias("artifact")))


@query("index_refresh", LOG + ", ch AS (SELECT * FROM log WHERE id % 40 = 1), t AS (SELECT DISTINCT entity, collection, key, status FROM ch), r AS (SELECT l.* FROM log l SEMI JOIN t USING (entity, collection, key, status) WHERE ready), x AS (SELECT id, true AS is_latest FROM r QUALIFY row_number() OVER (PARTITION BY entity, collection, key, status ORDER BY seq DESC) = 1 UNION ALL SELECT id, false FROM (SELECT * FROM r WHERE id % 40 <> 1 QUALIFY row_number() OVER (PARTITION BY entity, collection, key, status ORDER BY seq DESC) = 1)) SELECT id, bool_or(is_latest) AS is_latest FROM x GROUP BY id")
def index_refresh(s, d):
    log = activity(s, d)
    return lifecycle.index_refresh(log, log.where("id % 40 = 1"), ("entity", "collection", "key", "status"))


@query("artifact_staleness", LOG + ", a AS (SELECT entity AS artifact, min(seq) AS seen_seq, CASE WHEN entity LIKE '%3' THEN 'old' ELSE 'now' END AS hash FROM log GROUP BY ALL), m AS (SELECT entity, max(seq) AS top FROM log WHERE ready GROUP BY entity) SELECT artifact, CASE WHEN hash <> 'now' THEN 'definition' WHEN top > seen_seq THEN 'rows' ELSE 'fresh' END AS state FROM a LEFT JOIN m ON m.entity = a.artifact")
def artifact_staleness(s, d):
    log = activity(s, d)
    made = log.groupBy(F.col("entity").alias("artifact")).agg(F.min("seq").alias("seen_seq")).withColumn("hash", F.when(F.col("artifact").endswith("3"), "old").otherwise("now"))
    return artifacts.staleness(made, "now", log.where("ready").withColumnRenamed("entity", "artifact"))


@query("run_listing", RUNS + " SELECT seq, entity, outcome, high_seq FROM runs WHERE seq < 9000 AND outcome = 'ok' ORDER BY seq DESC LIMIT 40")
def run_listing(s, d):
    from ledgerlens import api

    return api.runs(_runs(activity(s, d)), before=9000, limit=40, outcome="ok").select("seq", "entity", "outcome", "high_seq")


@query("search_declared_fields", "WITH l AS (SELECT event_id AS id, event_id + 1 AS seq, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS amount FROM events WHERE event_id % 17 <> 0 AND event_id % 10 <> 0 AND event_id % 11 <> 0) SELECT id, amount FROM l WHERE amount > 3 ORDER BY amount DESC, seq, CAST(id AS VARCHAR) LIMIT 100")
def search_declared_fields(s, d):
    log = activity(s, d).join(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content")), "id")
    source = Source("structured", where={"amount": {"gt": 3}}, order_by=[("amount", "desc")], fields={"amount": ("integer", {2: "$.k"})}, k=100)
    return run_source(log, source).select("id", "amount")
