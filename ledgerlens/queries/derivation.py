"""Derivation inputs, candidates and commits of all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import derivation as dv
from ledgerlens.operators import triggers
from ledgerlens.registry import LOG, RUNS, _both, _runs, query
from ledgerlens.sources.records import activity

DRIVER = dv.Driver(max_records=40)
PREFIX = (
    RUNS
    + """, w AS (SELECT l.*, row_number() OVER (PARTITION BY l.entity ORDER BY l.seq) AS n FROM log l LEFT JOIN marks m USING (entity) WHERE status = 'active' AND l.seq > coalesce(m.watermark, 0)),
p AS (SELECT *, min(CAST(ready AS INT)) OVER (PARTITION BY entity ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS ok FROM w WHERE n <= 40),
o AS (SELECT e.entity, CASE WHEN s.n IS NULL THEN 'noop' WHEN s.n = 0 THEN 'wait' ELSE 'ok' END AS outcome, coalesce(s.n, 0) AS n, coalesce(s.high, m.watermark, 0) AS high_seq
      FROM (SELECT DISTINCT entity FROM log) e LEFT JOIN (SELECT entity, count(*) FILTER (ok) AS n, max(seq) FILTER (ok) AS high FROM p GROUP BY entity) s USING (entity) LEFT JOIN marks m USING (entity))"""
)


def _changes(s: SparkSession, d: str) -> dv.Inputs:
    return dv.changes_input(*_both(s, d), DRIVER)


@query("derive_changes_rows", PREFIX + " SELECT id, entity FROM p WHERE ok")
def derive_changes_rows(s, d):
    return _changes(s, d).rows.select("id", "entity")


@query("derive_changes_outcome", PREFIX + " SELECT entity, outcome, n, high_seq FROM o")
def derive_changes_outcome(s, d):
    return _changes(s, d).outcomes


SNAPSHOT = LOG + ", r AS (SELECT * FROM log WHERE status = 'active' AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at <= TIMESTAMP '2024-01-05')"
OUTCOME = "CASE WHEN count(*) > {most} THEN 'budget' WHEN NOT bool_and(ready) THEN 'wait' ELSE 'ok' END AS outcome, count(*) AS n, max(seq) AS high_seq"


@query("derive_snapshot_outcome", SNAPSHOT + f" SELECT entity, {OUTCOME.format(most=6)}, min(seq) AS from_seq FROM r GROUP BY entity")
def derive_snapshot_outcome(s, d):
    return dv.snapshot_input(activity(s, d), dv.Driver("snapshot", since="2024-01-03 00:00:00", until="2024-01-05 00:00:00", max_records=6)).outcomes


@query("derive_snapshot_recent", LOG + f", r AS (SELECT * FROM log WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) <= 4), o AS (SELECT entity, {OUTCOME.format(most=4)} FROM r GROUP BY entity) SELECT id FROM r SEMI JOIN (SELECT entity FROM o WHERE outcome = 'ok') k USING (entity)")
def derive_snapshot_recent(s, d):
    return dv.snapshot_input(activity(s, d), dv.Driver("snapshot", recent=4, max_records=4)).rows.select("id")


HEADS = LOG + ", h AS (SELECT * FROM log WHERE status = 'active' AND key IN ('click', 'view', 'purchase') QUALIFY row_number() OVER (PARTITION BY entity, collection, key, status ORDER BY seq DESC) = 1)"


@query("derive_current_outcome", HEADS + f" SELECT entity, {OUTCOME.format(most=100)} FROM h GROUP BY entity")
def derive_current_outcome(s, d):
    return dv.current_input(activity(s, d), dv.Driver(), ("click", "view", "purchase")).outcomes


@query("derive_current_rows", HEADS + " SELECT id, tombstone FROM h SEMI JOIN (SELECT entity FROM h GROUP BY entity HAVING bool_and(ready)) k USING (entity)")
def derive_current_rows(s, d):
    return dv.current_input(activity(s, d), dv.Driver(), ("click", "view", "purchase")).rows.select("id", "tombstone")


@query("derive_record_outcome", LOG + ", r AS (SELECT * FROM log WHERE key = 'click' AND status = 'active' AND version = 2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) = 1) SELECT e.entity, CASE WHEN r.ready IS NULL THEN 'none' WHEN r.ready THEN 'ok' ELSE 'wait' END AS outcome, CAST(r.ready IS NOT NULL AS BIGINT) AS n, coalesce(r.seq, 0) AS high_seq FROM (SELECT DISTINCT entity FROM log) e LEFT JOIN r USING (entity)")
def derive_record_outcome(s, d):
    return dv.record_input(activity(s, d), "activity", "click", version=2, kind="click").outcomes


EMIT = dv.Emission("activity", keys=("click", "error", "purchase", "signup", "view"), max_records=10)


def _log(s: SparkSession, d: str) -> DataFrame:
    return activity(s, d).withColumn("content", F.col("k").cast("string")).withColumn("depth", (F.col("id") % 4).cast("int"))


HEAD_SQL = """, now AS (SELECT * FROM log WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1),
x AS (SELECT e.entity, k.key, h.id AS head_id, CAST(h.k AS VARCHAR) AS head_content, CAST(h.id % 4 AS INT) AS head_depth, h.tombstone AS head_tombstone FROM (SELECT DISTINCT entity FROM log) e CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS key) k LEFT JOIN now h ON h.entity = e.entity AND h.key = k.key)"""


@query("derive_expected_heads", LOG + HEAD_SQL + " SELECT entity, key, coalesce(head_id, -1) AS head_id, coalesce(head_tombstone, false) AS head_tombstone FROM x")
def derive_expected_heads(s, d):
    return dv.expected_heads(_log(s, d), EMIT).select("entity", "key", F.coalesce("head_id", F.lit(-1)).alias("head_id"), F.coalesce("head_tombstone", F.lit(False)).alias("head_tombstone"))


#: One draft for each entity and type that its run read; some entities cite what they could not see or leave the text out.
DRAFTS = """, u AS (SELECT entity, CAST(substr(entity, 6) AS BIGINT) % 5 AS form FROM (SELECT DISTINCT entity FROM log)),
seen AS (SELECT entity, list(id ORDER BY id) AS ids FROM p WHERE ok GROUP BY entity),
d AS (SELECT p.entity, key, min(id) AS ordinal, CASE WHEN any_value(form) = 1 AND key = 'view' THEN NULL WHEN any_value(form) = 3 THEN CAST(max(k) AS VARCHAR) ELSE CAST(min(k) AS VARCHAR) END AS text,
      any_value(form) = 1 AND key = 'view' AS retract, CASE WHEN any_value(form) = 2 AND key = 'click' THEN [min(id) + 1000000] WHEN any_value(form) = 4 AND key = 'error' THEN [] ELSE [min(id), max(id)] END AS cited
      FROM p JOIN u USING (entity) WHERE ok GROUP BY p.entity, key),
c0 AS (SELECT d.*, x.key IS NOT NULL AS known, head_id, head_content, head_tombstone, head_depth, count(*) OVER (PARTITION BY d.entity, d.key) AS times FROM d LEFT JOIN x ON x.entity = d.entity AND x.key = d.key),
c1 AS (SELECT c0.*, CASE WHEN NOT known THEN 'key_unknown' WHEN retract AND text IS NOT NULL THEN 'retract_with_content' WHEN NOT retract AND coalesce(text = '', true) THEN 'no_content' WHEN len(cited) = 0 THEN 'citations' WHEN len(list_filter(cited, lambda c: NOT list_contains(ids, c))) > 0 THEN 'citation_hidden' WHEN len(list_distinct(cited)) < len(cited) THEN 'citation_repeated' END AS error,
       CASE WHEN head_id IS NULL THEN CASE WHEN retract THEN 'unchanged' ELSE 'added' END WHEN NOT retract AND head_content IS NOT DISTINCT FROM text AND NOT head_tombstone THEN 'unchanged' WHEN retract AND head_tombstone THEN 'unchanged' WHEN retract THEN 'removed' ELSE 'changed' END AS change
       FROM c0 LEFT JOIN seen USING (entity)),
c AS (SELECT *, count(error) OVER (PARTITION BY entity) = 0 AS accepted FROM c1)"""


def _drafts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dv.Inputs]:
    inputs = _changes(s, d)
    form = F.substring("entity", 6, 20).cast("long") % 5
    grouped = inputs.rows.groupBy("entity", "key").agg(F.min("id").alias("ordinal"), F.min("k").cast("string").alias("low"), F.max("k").cast("string").alias("high"), F.max("id").alias("last"))
    gone = (form == 1) & (F.col("key") == "view")
    cited = F.when((form == 2) & (F.col("key") == "click"), F.array(F.col("ordinal") + 1_000_000)).when((form == 4) & (F.col("key") == "error"), F.array().cast("array<bigint>")).otherwise(F.array("ordinal", "last"))
    drafts = grouped.select("entity", "key", "ordinal", F.when(gone, None).when(form == 3, F.col("high")).otherwise(F.col("low")).alias("text"), gone.alias("retract"), cited.alias("citations"))
    visible = inputs.rows.groupBy("entity").agg(F.collect_set("id").alias("ids"))  # max_records at most
    return drafts, visible, inputs


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, dv.Inputs]:
    drafts, visible, inputs = _drafts(s, d)
    return dv.compile_candidates(drafts, dv.expected_heads(_log(s, d), EMIT), visible, EMIT), inputs


@query("derive_candidates", PREFIX + HEAD_SQL + DRAFTS + " SELECT entity, key, error, change, accepted FROM c")
def derive_candidates(s, d):
    return _candidates(s, d)[0].select("entity", "key", "error", "change", "accepted")


COMMIT = """, depths AS (SELECT entity, ordinal, greatest(max(CASE WHEN head_id IS NULL OR parent <> head_id THEN parent % 4 + 1 END), any_value(head_depth)) AS depth FROM (SELECT entity, ordinal, head_id, head_depth, unnest(cited) AS parent FROM c WHERE accepted) GROUP BY entity, ordinal),
go AS (SELECT * FROM o WHERE outcome IN ('ok', 'noop') AND entity NOT IN (SELECT entity FROM c WHERE NOT accepted)),
rows0 AS (SELECT go.entity, '_system' AS collection, 'run' AS type, CAST(NULL AS VARCHAR) AS key, true AS ready, 0 AS depth, CASE WHEN n.entity IS NULL THEN 'noop' ELSE 'ok' END AS result, high_seq, -1 AS ordinal FROM go LEFT JOIN (SELECT DISTINCT entity FROM c) n USING (entity)
  UNION ALL SELECT c.entity, 'activity', 'derived', c.key, false, coalesce(t.depth, 1), NULL, go.high_seq, c.ordinal FROM c JOIN go USING (entity) LEFT JOIN depths t ON t.entity = c.entity AND t.ordinal = c.ordinal)
SELECT entity, collection, type, key, ready, CAST(depth AS INT) AS depth, result, high_seq, (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY entity, ordinal) AS seq FROM rows0"""


@query("derive_commit", PREFIX + HEAD_SQL + DRAFTS + COMMIT)
def derive_commit(s, d):
    log = _log(s, d)
    found, inputs = _candidates(s, d)
    made = dv.commit(log, dv.output_depths(found, log.select("id", "depth")), inputs.outcomes, EMIT, "profile")
    return made.select("entity", "collection", "type", "key", "ready", "depth", "result", "high_seq", "seq")


@query("derive_basis_unmoved", LOG + HEAD_SQL + ", later AS (SELECT * FROM now), old AS (SELECT * FROM log WHERE status = 'active' AND occurred_at <= TIMESTAMP '2024-01-28' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC) = 1), y AS (SELECT e.entity, k.key, o.id AS was, n.id AS now_id FROM (SELECT DISTINCT entity FROM log WHERE occurred_at <= TIMESTAMP '2024-01-28') e CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS key) k LEFT JOIN old o ON o.entity = e.entity AND o.key = k.key LEFT JOIN later n ON n.entity = e.entity AND n.key = k.key) SELECT entity, bool_and(was IS NOT DISTINCT FROM now_id) AS unmoved FROM y GROUP BY entity")
def derive_basis_unmoved(s, d):
    log = _log(s, d)
    then = log.where(F.col("occurred_at") <= F.lit("2024-01-28").cast("timestamp_ntz"))
    return dv.unmoved(log, dv.expected_heads(then, EMIT), EMIT)


@query("derive_successors", RUNS + " SELECT l.entity, count(*) AS waiting, min(l.seq) AS first_seq FROM log l LEFT JOIN marks m USING (entity) WHERE status = 'active' AND l.seq > coalesce(m.watermark, 0) GROUP BY l.entity")
def derive_successors(s, d):
    log = activity(s, d)
    return dv.successors(log, _runs(log), DRIVER)


@query("cite_visible", LOG + " SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) || ',' || CAST(id + 1 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS cited FROM log")
def cite_visible(s, d):
    n = F.col("id").cast("string")
    text = F.concat(F.lit("as [id="), n, F.lit("] and [id="), (F.col("id") + 1).cast("string"), F.lit("] say, [id="), n, F.lit("]"))
    visible = F.when(F.col("id") % 3 == 0, F.array((F.col("id") + 1).cast("string"), n)).otherwise(F.array(n))
    return activity(s, d).select("id", F.array_join(dv.cite_visible(text, visible), ",").alias("cited"))


@query("provenance_union", LOG + " SELECT entity, array_to_string(list_sort(list(DISTINCT parent)), ',') AS sources FROM (SELECT entity, unnest([id // 100, id // 200]) AS parent FROM log) GROUP BY entity")
def provenance_union(s, d):
    rows = activity(s, d).select("entity", F.array(F.floor(F.col("id") / 100), F.floor(F.col("id") / 200)).alias("derived_from"))
    return dv.provenance_union(rows, "entity").select("entity", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("own_outputs_ignored", LOG + ", r AS (SELECT id, entity, CASE WHEN id % 4 = 0 THEN 'profile' WHEN id % 4 = 1 THEN 'digest' END AS processor FROM log) SELECT id FROM r WHERE processor IS DISTINCT FROM 'profile'")
def own_outputs_ignored(s, d):
    n = F.col("id")
    log = activity(s, d).withColumn("run_id", F.when(n % 4 < 2, F.concat(F.lit("r"), n.cast("string"))))
    runs = log.where("run_id IS NOT NULL").select("run_id", F.when(n % 4 == 0, "profile").otherwise("digest").alias("processor"))
    return triggers.without_own_outputs(log, runs, "profile").select("id")


@query("debounce_due", LOG + " SELECT entity, strftime(greatest(max(occurred_at) + INTERVAL 60 SECOND, TIMESTAMP '2024-01-20'), '%Y-%m-%d %H:%M:%S') AS due, count(*) AS n FROM log WHERE ready GROUP BY entity")
def debounce_due(s, d):
    waiting = activity(s, d).select("entity").distinct().select("entity", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("due"))
    made = triggers.debounced(activity(s, d).where("ready"), 60, waiting)
    return made.select("entity", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"), "n")


@query("cron_jobs", RUNS + ", b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR)) AS bucket), due AS (SELECT bucket FROM b WHERE bucket > TIMESTAMP '2024-01-27' AND bucket <= TIMESTAMP '2024-01-28 13:00:00') SELECT entity, 'sweep:' || strftime(bucket, '%Y-%m-%d %H:%M') AS job FROM (SELECT DISTINCT entity FROM pend) CROSS JOIN due")
def cron_jobs(s, d):
    log, marks = _both(s, d)
    dirty = triggers.pending(log, marks).select("entity").distinct()
    return triggers.cron_jobs(dirty, "sweep", "0 */6 * * *", "2024-01-27 00:00:00", "2024-01-28 13:00:00")


@query("read_staleness", RUNS + ", e AS (SELECT DISTINCT entity FROM log), f AS (SELECT e.entity, m.last_success, EXISTS (SELECT 1 FROM pend p WHERE p.entity = e.entity) AS dirty FROM e LEFT JOIN marks m USING (entity)) SELECT entity, CASE WHEN last_success IS NULL THEN 'never_run' WHEN dirty THEN 'dirty' ELSE 'aged' END AS reason FROM f WHERE dirty OR last_success IS NULL OR last_success <= TIMESTAMP '2024-01-31' - INTERVAL 172800 SECOND")
def read_staleness(s, d):
    return triggers.stale_on_read(*_both(s, d), "2024-01-31 00:00:00", 172800)
