"""Artifacts: blocks of rendered lines, packed under budgets, put into a template, with a digest and a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.render import tokens
from ledgerlens.operators.packing import packed_prefix
from ledgerlens.plans.catalog import filled

MOST_INPUTS = 255


@dataclass(frozen=True)
class Block:
    """Lines (id, line) in the order of the column ``place``, and a token budget."""

    lines: DataFrame
    budget: int


@dataclass(frozen=True)
class Artifact:
    text: str
    digest: str
    manifest: dict[str, list]


def render(template: str, blocks: Mapping[str, Block]) -> Artifact:
    """Each block is its longest prefix of lines within its budget; all blocks together have ``MOST_INPUTS`` inputs at most."""
    left, texts, manifest = MOST_INPUTS, {}, {}
    for name, block in blocks.items():
        first = block.lines.orderBy("place").limit(left)
        rows = packed_prefix(first, tokens(F.col("line")), block.budget, [F.col("place")]).orderBy("place").collect()
        left -= len(rows)
        texts[name] = "\n".join(r["line"] for r in rows)
        manifest[name] = [r["id"] for r in rows]
    text = str(filled(template, {"blocks": texts}))
    return Artifact(text, hashlib.sha256(text.encode()).hexdigest(), manifest)


def is_stale(artifact_hash: str, definition_hash: str, seen_seq: int, scope: DataFrame) -> bool:
    """Whether the definition changed, or the scope has rows past those seen."""
    return artifact_hash != definition_hash or (scope.agg(F.max("seq")).first()[0] or 0) > seen_seq


def staleness(made: DataFrame, definition_hash: str, scope: DataFrame) -> DataFrame:
    """(artifact, state) of rendered artifacts (artifact, hash, seen_seq): ``definition`` if it changed, ``rows`` if the
    artifact's scope (artifact, seq) has newer ones, else ``fresh``."""
    top = scope.groupBy("artifact").agg(F.max("seq").alias("__top"))
    state = F.when(F.col("hash") != definition_hash, "definition").when(F.col("__top") > F.col("seen_seq"), "rows").otherwise("fresh")
    return made.join(top, "artifact", "left").select("artifact", state.alias("state"))
