"""Context for a task: sections with shares of a token budget, each row once, and the records that reads leave behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.render import tokens
from ledgerlens.operators.heads import heads

#: Shares of the budget, and rows that a section may offer.
SHARES = {"document": 0.30, "search": 0.40, "recent": 0.20, "delta": 0.10}
MOST_ROWS = 200


def context_heads(log: DataFrame, entity: str | None = None, collections: Sequence[str] = (), score: str = "importance", most: int = MOST_ROWS) -> DataFrame:
    """Current rows of an entity's keys without tombstones, the best by a score first; system collections apart."""
    rows = log.where("status = 'active' AND key IS NOT NULL AND NOT startswith(collection, '_')")
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if collections:
        rows = rows.where(F.col("collection").isin(list(collections)))
    now = heads(rows, ("entity", "collection", "key")).where(~F.col("tombstone"))
    return now.orderBy(F.col("scores")[score].desc_nulls_last(), F.desc("seq")).limit(most)


def block_heads(log: DataFrame, status: str = "active") -> DataFrame:
    """Current rows of (entity, collection, key) without tombstones; with ``all`` drafts and active rows are one lane."""
    rows = log.where("key IS NOT NULL")
    if status != "all":
        rows = rows.where(F.col("status") == status)
    return heads(rows, ("entity", "collection", "key")).where(~F.col("tombstone"))


@dataclass(frozen=True)
class Context:
    lines: list[str]
    ids: list
    sections: dict[str, dict]
    truncated: bool


def assemble(sections: Mapping[str, DataFrame], budget: int, consumer: bool = True, overhead: int = 0) -> Context:
    """Sections (id, line, place) packed in the order of ``SHARES``. A line that does not fit is skipped and later ones are
    tried; what a section leaves goes to the next; an id is used once. Without a consumer ``recent`` has delta's share.

    At most ``MOST_ROWS`` lines a section reach the driver.
    """
    available, carry, seen = max(0, budget - overhead), 0.0, set()
    out, ids, report, truncated = [], [], {}, False
    for name, share in SHARES.items():
        if name not in sections or name == "delta" and not consumer:
            continue
        share += SHARES["delta"] if name == "recent" and not consumer else 0.0
        room, used, own = available * share + carry, 0, []
        for r in sections[name].orderBy("place").limit(MOST_ROWS).select("id", "line", tokens(F.col("line")).alias("cost")).collect():
            if r["id"] in seen:
                continue
            if used + r["cost"] > room:
                truncated = True
                continue
            used += r["cost"]
            seen.add(r["id"])
            out.append(r["line"])
            own.append(r["id"])
        carry = room - used
        ids += own
        report[name] = {"ids": own, "tokens": used}
    return Context(out, ids, report, truncated)


def touched(reads: DataFrame, log: DataFrame) -> DataFrame:
    """(id, last_accessed): the log's access times with those of a batch of reads (id, read_at); rows are never rewritten."""
    last = reads.groupBy("id").agg(F.max("read_at").alias("__read"))
    return log.select("id", "last_accessed").join(last, "id", "left").select("id", F.greatest("last_accessed", "__read").alias("last_accessed"))


def artifact_snapshot(rendered: DataFrame, current: DataFrame, collection: str, reviewed: bool = False) -> DataFrame:
    """Rows that renders (artifact, text, inputs, definition_hash) add to a collection of snapshots.

    A render equal to the current snapshot of its artifact adds nothing; a reviewed one is a draft until it is promoted.
    """
    digest = F.sha2("text", 256)
    head = heads(current.where((F.col("collection") == collection) & (F.col("status") == "active")), ("key",)).select(F.col("key").alias("artifact"), F.col("digest").alias("__now"))
    fresh = rendered.withColumn("digest", digest).join(head, "artifact", "left").where(~F.col("digest").eqNullSafe(F.col("__now")))
    return fresh.select(F.lit(collection).alias("collection"), F.col("artifact").alias("key"), F.lit("draft" if reviewed else "active").alias("status"), "text", "digest", "definition_hash", F.slice("inputs", 1, 255).alias("derived_from"))


def learning_target(now: DataFrame) -> DataFrame:
    """(collection, base_run, heads): collections whose current rows were all made by one run."""
    found = now.groupBy("collection", "entity").agg(F.count_distinct("run_id").alias("runs"), F.min("run_id").alias("base_run"), F.count("*").alias("heads"), F.bool_or(F.col("run_id").isNull()).alias("loose"))
    return found.where("runs = 1 AND NOT loose").select("collection", "entity", "base_run", "heads")


def feedback(uses: DataFrame, signals: DataFrame) -> DataFrame:
    """Feedback records of signals (use_id, kind, source, label, score) on artifact uses (use_id, artifact, digest, entity)."""
    said = F.concat_ws(" ", F.lit("Feedback"), F.col("kind"), F.lit("from"), F.col("source"), F.lit("on"), F.col("artifact"))
    more = F.when(F.col("label").isNotNull(), F.concat(F.lit(": "), F.col("label"))).otherwise("")
    content = F.to_json(F.struct("artifact", "digest", "use_id", F.struct("kind", "source", "label", "score").alias("signal")))
    return signals.join(uses, "use_id").select("use_id", "entity", F.lit("learning_signals").alias("collection"), F.lit("signal").alias("type"), F.concat(said, more).alias("text"), content.alias("content"))


def expired_uses(uses: DataFrame, now: str, most: int) -> DataFrame:
    """The uses to purge: expired ones, the oldest first, a bounded page."""
    kind = uses.schema["expires_at"].dataType
    return uses.where(F.col("expires_at") <= F.lit(now).cast(kind)).orderBy("expires_at", "use_id").limit(most)
