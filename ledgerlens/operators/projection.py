"""What readers get of a record: search hits, detail, summary, version, belief and retraction shapes, and mapped copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.render import truncate_middle

HIT_CHARS, COMPACT_CHARS = 2000, 500
#: Fields that a hit may include.
INCLUDE = ("text", "scores", "collection", "collection_version", "entity", "type", "key", "status", "depth", "occurred_at", "created_at", "run_id")
#: Columns of each shape, in order.
DETAIL = ("id", "seq", "collection", "collection_version", "collection_hash", "entity", "key", "type", "status", "content", "tombstone", "scores", "annotations", "annotation_meta", "ready", "enriched_at", "run_id", "depth", "derived_from", "dedupe_key", "occurred_at", "created_at", "last_accessed")
SUMMARY = ("id", "seq", "collection", "key", "type", "status", "ready", "tombstone", "run_id", "text", "occurred_at", "created_at")
VERSION = ("id", "seq", "collection", "collection_version", "collection_hash", "key", "type", "status", "content", "tombstone", "ready", "run_id", "citations", "depth", "occurred_at", "created_at")
BELIEF = ("collection", "collection_version", "collection_hash", "key", "type", "text", "id", "run_id", "citations", "status", "depth", "ready", "occurred_at", "created_at")
RETRACTION = ("collection", "key", "id", "seq")


class IllegalProjection(ValueError):
    """A field that hits do not have."""


def citations() -> Column:
    """Direct provenance: the parents of a row without the run that made it."""
    return F.when(F.col("run_id").isNull(), F.col("derived_from")).otherwise(F.array_remove("derived_from", F.col("run_id")))


def iso(time: str, kind: Any = None) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def shaped(rows: DataFrame, shape: Sequence[str], most_chars: int | None = None) -> DataFrame:
    """Rows in a shape: times as text, citations computed; columns that the rows do not have are null."""
    out = []
    for c in shape:
        if c == "citations":
            made = citations() if {"derived_from", "run_id"} <= set(rows.columns) else F.lit(None)
        elif c == "text" and most_chars is not None:
            made = truncate_middle(F.col("text"), most_chars)
        elif c in ("occurred_at", "created_at", "enriched_at", "last_accessed") and c in rows.columns:
            made = iso(c)
        else:
            made = F.col(c) if c in rows.columns else F.lit(None)
        out.append(made.alias(c))
    return rows.select(*out)


def detail(rows: DataFrame) -> DataFrame:
    return shaped(rows, DETAIL)


def summary(rows: DataFrame) -> DataFrame:
    return shaped(rows, SUMMARY, COMPACT_CHARS)


def version(rows: DataFrame, with_entity: bool = False) -> DataFrame:
    return shaped(rows, (*VERSION, "entity") if with_entity else VERSION)


def belief(rows: DataFrame) -> DataFrame:
    return shaped(rows, BELIEF)


def retraction(rows: DataFrame) -> DataFrame:
    return shaped(rows, RETRACTION)


def hits(ranked: DataFrame, include: Sequence[str] = (), fields: Mapping[str, Column] | None = None, annotations: Sequence[str] = ()) -> DataFrame:
    """id, rank and score of ranked rows, rank_score and source_ranks where they have them, and what was asked for.

    ``fields``: columns that read declared fields (``predicates.versioned``); ``annotations``: names in the annotation map.
    """
    if unknown := set(include) - set(INCLUDE):
        raise IllegalProjection(f"hits do not include {sorted(unknown)}")
    out = [F.col(c) for c in ("id", "rank", "score", "rank_score", "source_ranks") if c in ranked.columns]
    for name in include:
        out.append((truncate_middle(F.col("text"), HIT_CHARS) if name == "text" else iso(name) if name.endswith("_at") else F.col(name)).alias(name))
    if fields:
        out.append(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("fields"))
    if annotations:
        out.append(F.struct(*[F.col("annotations")[n].alias(n) for n in annotations]).alias("annotations"))
    return ranked.select(*out)


def map_records(rows: DataFrame, keep: Sequence[str] = (), set_: Mapping[str, Mapping[str, Any]] | None = None, drop: Sequence[str] = (), carry_key: bool = True) -> DataFrame:
    """(id, key, content): the JSON content of rows, field by field.

    ``keep`` copies top-level fields; ``set_`` maps a field to {"from": path | "const": value, "default": value, "cast":
    type}; ``drop`` leaves fields out. Fields without a value are left out; a cast that fails gives the default.
    """
    out: dict[str, Column] = {}
    for name in keep:
        out[name] = F.get_json_object("content", f"$.{name}")
    for name, rule in (set_ or {}).items():
        made = F.lit(rule["const"]) if "const" in rule else F.get_json_object("content", rule["from"])
        if "cast" in rule:
            made = made.try_cast(rule["cast"])
        out[name] = F.coalesce(made, F.lit(rule["default"])) if "default" in rule else made
    fields = [c.alias(n) for n, c in out.items() if n not in drop]
    return rows.select("id", (F.col("key") if carry_key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct(*fields)).alias("content"))
