"""The record log: its schema, adapters from plain tables, scans by scope, and the append with its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, seq bigint, workspace string, collection string, collection_version int, collection_hash string, entity string, key string, type string,"
    " status string, content string, scores map<string,double>, annotations map<string,string>, enriched_at timestamp, run_id string, depth int,"
    " derived_from array<string>, dedupe_key string, occurred_at timestamp, created_at timestamp, last_accessed timestamp"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log: one slot for each user and event type; every tenth row is not ready, some are drafts or tombstones."""
    e = table(spark, folder, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("id"),
        (n + 1).alias("seq"),
        F.lit("activity").alias("collection"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("key"),
        F.col("event_type").alias("type"),
        F.when(n % 17 == 0, "draft").otherwise("active").alias("status"),
        (n % 10 != 0).alias("ready"),
        (n % 11 == 0).alias("tombstone"),
        F.col("ts").alias("occurred_at"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.when(n % 3 == 0, F.lit(2)).otherwise(F.lit(1)).alias("version"),
    )


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions, and parts from suppliers, as labelled edges."""
    name = lambda prefix, column: F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))
    edge = lambda df, s, o, p: df.select(s.alias("subject"), o.alias("object"), F.lit(p).alias("predicate"))
    c, s, n, li = (table(spark, folder, t) for t in ("customer", "supplier", "nation", "lineitem"))
    made = [
        edge(c, name("customer", "c_custkey"), name("nation", "c_nationkey"), "lives_in"),
        edge(s, name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "based_in"),
        edge(n, name("nation", "n_nationkey"), name("region", "n_regionkey"), "part_of"),
        edge(li.select("l_partkey", "l_suppkey").distinct(), name("part", "l_partkey"), name("supplier", "l_suppkey"), "supplied_by"),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.withColumn("edge_id", F.concat_ws("|", "predicate", "subject", "object"))


@dataclass(frozen=True)
class Scope:
    """What a scan may see. Empty sequences do not restrict."""

    entity: str | None = None
    collections: Sequence[str] = ()
    types: Sequence[str] = ()
    statuses: Sequence[str] = ("active",)
    keyed: str = "any"
    after: str | None = None
    before: str | None = None
    ready: bool = True
    tombstones: bool = False
    above: int | None = None
    current: bool = False
    workspace: str | None = None
    #: Versions of a collection that may be seen; other collections are not restricted.
    versions: Mapping[str, Sequence[int]] = field(default_factory=dict)
    depth: int | None = None
    system: bool = True


def scan(log: DataFrame, scope: Scope) -> DataFrame:
    """Rows of the log in the scope. Current versions are picked over the whole log first: newer rows hide older ones
    even if they are not ready or of another type."""
    from ledgerlens.operators.heads import SLOT, is_current

    if scope.workspace is not None:
        log = log.where(F.col("workspace") == scope.workspace)
    if scope.current:
        log = log.withColumn("__now", F.col("key").isNull() | is_current(SLOT)).where("__now").drop("__now")
    conditions: list[Column] = []
    for name, versions in scope.versions.items():
        conditions.append((F.col("collection") != name) | F.col("version").isin(list(versions)))
    if scope.depth is not None:
        conditions.append(F.col("depth") <= scope.depth)
    if not scope.system:
        conditions.append(~F.col("collection").startswith("_"))
    if scope.entity is not None:
        conditions.append(F.col("entity") == scope.entity)
    for column, values in (("collection", scope.collections), ("type", scope.types), ("status", scope.statuses)):
        if values:
            conditions.append(F.col(column).isin(list(values)))
    if scope.keyed != "any":
        conditions.append(F.col("key").isNotNull() if scope.keyed == "keyed" else F.col("key").isNull())
    if scope.after is not None:
        conditions.append(F.col("occurred_at") > F.lit(scope.after).cast(log.schema["occurred_at"].dataType))
    if scope.before is not None:
        conditions.append(F.col("occurred_at") < F.lit(scope.before).cast(log.schema["occurred_at"].dataType))
    if scope.ready:
        conditions.append(F.col("ready"))
    if not scope.tombstones:
        conditions.append(~F.col("tombstone"))
    if scope.above is not None:
        conditions.append(F.col("seq") > scope.above)
    for c in conditions:
        log = log.where(c)
    return log


IMMUTABLE = ("collection", "entity", "key", "type", "status", "content", "derived_from", "occurred_at")
#: Rows of a batch, and steps of derivation.
MOST_BATCH, MOST_DEPTH = 100, 4


class IllegalBatch(ValueError):
    """A batch that is too large, or has a row that cannot be written."""


def ingest(log: DataFrame, batch: DataFrame, schemas: Mapping[str, Mapping[str, Any]] | None = None, order: str = "id") -> DataFrame:
    """What becomes of each row of a batch: ``inserted``, ``duplicate`` (same dedupe key and content), ``conflict`` or
    ``invalid``, with ``faults`` where ``schemas`` (by collection) find any.

    The first row of a key in ``order`` decides for those after it in the batch, as a row of the log would.
    """
    from ledgerlens.functions.json_schema import checked

    digest = F.sha2(F.to_json(F.struct(*[c for c in IMMUTABLE if c in batch.columns])), 256)
    judged = checked(batch, "content", schemas, by="collection") if schemas else batch.withColumn("faults", F.array().cast("array<string>"))
    rows = judged.withColumn("digest", digest)
    old = log.where("dedupe_key IS NOT NULL").select("dedupe_key", digest.alias("old_digest")).groupBy("dedupe_key").agg(F.first("old_digest").alias("old_digest"))
    # Rows without a key or with faults decide nothing; the key of the others is shared by few rows.
    counted = F.col("dedupe_key").isNotNull() & (F.size("faults") == 0)
    first = rows.where(counted).groupBy("dedupe_key").agg(F.min(F.struct(F.col(order).alias("at"), "digest")).alias("first"))
    rows = rows.join(old, "dedupe_key", "left").join(first, "dedupe_key", "left")
    known = F.coalesce("old_digest", F.when(F.col(order) != F.col("first.at"), F.col("first.digest")))
    verdict = F.when(F.size("faults") > 0, "invalid").when(known.isNull(), "inserted").when(known == F.col("digest"), "duplicate").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("old_digest", "first")


def batch_depths(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, depth, fault) of rows with parents: one more than the deepest parent, or as deep where the parent is the
    current row of the same slot. ``fault``: ``parent_missing``, ``parent_order`` or ``depth_limit``."""
    from ledgerlens.operators.heads import SLOT, heads

    now = heads(log.where("key IS NOT NULL"), SLOT).select(*SLOT, F.col("id").alias("__head"))
    links = batch.select("id", "seq", *SLOT, F.explode("derived_from").alias("parent")).join(now, list(SLOT), "left")
    found = links.join(log.select(F.col("id").alias("parent"), F.col("depth").alias("__depth"), F.col("seq").alias("__seq")), "parent", "left")
    sums = found.groupBy("id").agg(
        F.max(F.col("__depth") + F.when(F.col("parent") == F.col("__head"), 0).otherwise(1)).alias("depth"), F.bool_or(F.col("__seq").isNull()).alias("missing"), F.bool_or(F.col("__seq") >= F.col("seq")).alias("later")
    )
    out = batch.select("id").join(sums, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    fault = F.when(F.col("missing"), "parent_missing").when(F.col("later"), "parent_order").when(F.col("depth") > MOST_DEPTH, "depth_limit")
    return out.select("id", F.col("depth").cast("int").alias("depth"), fault.alias("fault"))


def append(log: DataFrame, judged: DataFrame, order: str = "ordinal", most: int | None = MOST_BATCH) -> DataFrame:
    """The log with the inserted rows of a judged batch, numbered on from the log's end; nothing if a row conflicts or is
    invalid. ``most`` bounds the batch; None takes any number."""
    from ledgerlens.operators.numbering import numbered_on

    if most is not None and len(judged.select("verdict").head(most + 1)) > most:
        raise IllegalBatch(f"a batch has at most {most} rows")
    bad = judged.agg(F.max(F.col("verdict").isin("conflict", "invalid").cast("int")).alias("bad"))
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    fresh = judged.where("verdict = 'inserted'").crossJoin(F.broadcast(bad)).where("coalesce(bad, 0) = 0").crossJoin(F.broadcast(end))  # one row each
    kept = [c for c in log.columns if c in judged.columns and c not in ("seq", order)]  # no more than the log takes is held
    fresh = numbered_on(fresh.select(*kept, order, "end"), [F.col(order)], F.col("end"))
    return log.unionByName(fresh.select(*[c for c in log.columns if c in fresh.columns]), allowMissingColumns=True)
