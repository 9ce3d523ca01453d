"""Cursors of consumers over the log: a position within a scope that moves forward only."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CursorError(ValueError):
    """A cursor that belongs to another scope."""


def scope_hash(scope: Mapping[str, Any]) -> str:
    """A digest of a scope; the order of names within it does not count."""
    known = {k: sorted(v) if isinstance(v, (list, tuple, set)) else v for k, v in scope.items()}
    return hashlib.sha256(json.dumps(known, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def delta_of(log: DataFrame, cursor: Mapping[str, Any] | None, scope: Mapping[str, Any], limit: int) -> DataFrame:
    """A page of the log's changes from a stored cursor on, which must have been made for this scope. Reading moves nothing."""
    if cursor is not None and cursor["scope_hash"] != scope_hash(scope):
        raise CursorError("the cursor belongs to another scope")
    return log.where(F.col("seq") > (cursor["position"] if cursor else 0)).orderBy("seq").limit(limit)


def upsert(cursors: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors (consumer, scope_hash, position) after updates (consumer, scope_hash, position, force), with ``verdict``.

    ``created``; ``moved`` forward, or anywhere by force; ``kept`` if the update is behind; ``scope_differs`` leaves the
    cursor as it is. One update a consumer.
    """
    new = updates.select("consumer", F.col("scope_hash").alias("__scope"), F.col("position").alias("__to"), "force")
    both = cursors.join(new, "consumer", "full_outer")
    differs = F.col("scope_hash").isNotNull() & F.col("__scope").isNotNull() & (F.col("scope_hash") != F.col("__scope"))
    verdict = F.when(F.col("__scope").isNull(), "untouched").when(F.col("scope_hash").isNull(), "created").when(differs, "scope_differs").when(F.col("force") | (F.col("__to") > F.col("position")), "moved").otherwise("kept")
    both = both.withColumn("verdict", verdict)
    to = F.when(F.col("verdict").isin("created", "moved"), F.col("__to")).otherwise(F.col("position"))
    return both.select("consumer", F.coalesce("scope_hash", "__scope").alias("scope_hash"), to.alias("position"), "verdict")


def rebind(marks: DataFrame, old_hash: str, new_hash: str, carry: bool) -> DataFrame:
    """Watermarks (entity, contract_hash, watermark) of a derivation whose source contract changed.

    ``carry`` keeps positions under the new contract; otherwise they begin at 0 again. Other contracts stay.
    """
    own = F.col("contract_hash") == old_hash
    moved = F.when(own, F.col("watermark") if carry else F.lit(0)).otherwise(F.col("watermark"))
    return marks.select("entity", F.when(own, new_hash).otherwise(F.col("contract_hash")).alias("contract_hash"), moved.alias("watermark"), own.alias("rebound"))
