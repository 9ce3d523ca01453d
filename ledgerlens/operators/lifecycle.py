"""Promotion, backfill, audits, reference counts, paging of outputs and index rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.heads import heads


def promotion(log: DataFrame, base: DataFrame, content: str) -> DataFrame:
    """(entity, verdict, n): whether an entity's complete draft set may become active.

    ``base`` (entity, key, base_seq) holds the active heads that the drafts were made from. ``conflict`` if one of them
    has moved on, ``already`` if every draft equals its active head, else ``promote``.
    """
    lane = lambda s: heads(log.where((F.col("status") == s) & F.col("key").isNotNull()), ("entity", "key"))
    draft = lane("draft").select("entity", "key", F.col(content).alias("__draft"))
    active = lane("active").select("entity", "key", F.col("seq").alias("__seq"), F.col(content).alias("__active"))
    pairs = draft.join(active, ["entity", "key"], "left").join(base, ["entity", "key"], "left")
    moved = F.coalesce(F.col("__seq"), F.lit(0)) > F.coalesce(F.col("base_seq"), F.lit(0))
    same = F.col("__seq").isNotNull() & F.col("__draft").eqNullSafe(F.col("__active"))
    sums = pairs.groupBy("entity").agg(F.count("*").alias("n"), F.bool_or(moved).alias("moved"), F.bool_and(same).alias("same"))
    return sums.select("entity", F.when(F.col("same"), "already").when(F.col("moved"), "conflict").otherwise("promote").alias("verdict"), "n")


def promoted(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows that promotions append: the current drafts of entities to promote, as active rows, numbered from the log's end."""
    from ledgerlens.operators.numbering import numbered_on

    draft = heads(log.where("status = 'draft' AND key IS NOT NULL"), ("entity", "key")).join(verdicts.where("verdict = 'promote'").select("entity"), "entity", "left_semi")
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__end"))
    rows = draft.withColumn("promoted_from", F.col("id")).withColumn("status", F.lit("active")).drop("seq").crossJoin(F.broadcast(end))  # one row
    return numbered_on(rows, [F.col("entity"), F.col("key")], F.col("__end")).drop("__end")


def all_references(log: DataFrame, runs: DataFrame, uses: DataFrame, annotations: str = "annotations") -> DataFrame:
    """(kind, name, n): rows of each collection version, rows with each annotation, runs of each derivation, uses of each
    artifact: what must be gone before a definition can be pruned."""
    counted = lambda rows, kind, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    versions = counted(log, "collection", F.concat_ws("@", "collection", F.col("version").cast("string")))
    return versions.unionAll(counted(log.select(F.explode(F.map_keys(annotations)).alias("a")), "annotation", F.col("a"))).unionAll(counted(runs, "derivation", F.col("processor"))).unionAll(counted(uses, "artifact", F.col("artifact")))


def index_refresh(log: DataFrame, changed: DataFrame, slot: Sequence[str]) -> DataFrame:
    """(id, is_latest): of each slot that changed rows (ids) touch, its newest ready row and the newest ready row without
    the changed ones: the rows whose place in an index may have moved."""
    touched = log.join(changed.select("id"), "id", "left_semi").where("key IS NOT NULL").select(*slot).distinct()
    ready = log.where("ready AND key IS NOT NULL").join(touched, list(slot), "left_semi")
    latest = heads(ready, slot).select("id", F.lit(True).alias("is_latest"))
    before = heads(ready.join(changed.select("id"), "id", "left_anti"), slot).select("id", F.lit(False).alias("is_latest"))
    return latest.unionAll(before).groupBy("id").agg(F.bool_or("is_latest").alias("is_latest"))


def backfill_page(rows: DataFrame, done: DataFrame, after: int, limit: int) -> DataFrame:
    """The next ``limit`` ready rows after a cursor that lack the annotation, oldest first; the cursor moves to the last."""
    return rows.where(F.col("ready") & (F.col("seq") > after)).join(done.select("id").distinct(), "id", "left_anti").orderBy("seq").limit(limit)


def contract_offenders(log: DataFrame, contracts: DataFrame, by: Sequence[str] = ("collection", "version", "hash")) -> DataFrame:
    """Stored contracts that the catalog does not have, with their rows and the first offender."""
    stored = log.groupBy(*by).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return stored.join(contracts, list(by), "left_anti")


def reference_counts(rows: DataFrame, annotations: str) -> DataFrame:
    """(name, n): rows that hold each annotation."""
    return rows.select(F.explode(F.map_keys(annotations)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def lineage_faults(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(child, bad_order, missing): whether a row cites one that is not older, or one that is not there."""
    there = rows.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    flags = edges.join(there, "parent", "left")
    return flags.groupBy("child").agg(F.bool_or(F.col("parent") >= F.col("child")).alias("bad_order"), F.bool_or(F.col("there").isNull()).alias("missing"))


def outputs_page(runs: DataFrame, rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """(run, place, id, found): a page of each run's outputs in array order; outputs that are gone are reported."""
    flat = runs.select("run", F.posexplode("outputs").alias("place", "id")).where((F.col("place") >= offset) & (F.col("place") < offset + limit))
    return flat.join(rows.select("id", F.lit(True).alias("found")), "id", "left").select("run", "place", "id", F.coalesce("found", F.lit(False)).alias("found"))


def attribute_name(field: Column) -> Column:
    """The hashed name of a field in an external index."""
    return F.concat(F.lit("f_"), F.substring(F.sha2(field, 256), 1, 16))


def index_rows(rows: DataFrame, current: Column) -> DataFrame:
    """Rows as an external index holds them."""
    return rows.select("id", "entity", current.alias("is_current"), F.col("key").isNotNull().alias("keyed"), "tombstone", attribute_name(F.concat_ws("/", "collection", "type")).alias("attribute"))
