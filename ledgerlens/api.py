"""The engine's surface: one object over a log and a catalog, with the names under which readers and writers know it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import cursors, derivation, heads, lifecycle, projection, provenance, storage
from ledgerlens.plans import compat, context, search
from ledgerlens.plans.catalog import Catalog
from ledgerlens.sources import records


def runs(rows: DataFrame, before: int | None = None, limit: int = 50, outcome: str | None = None, entity: str | None = None) -> DataFrame:
    """A page of runs, newest first, by keyset."""
    if outcome is not None:
        rows = rows.where(F.col("outcome") == outcome)
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    return heads.timeline(rows, before, limit)


class Engine:
    """Reads give tables; writes give the table that the log becomes, which the caller stores."""

    def __init__(self, log: DataFrame, catalog: Catalog | None = None, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
        self.log, self.catalog, self.edges, self.nodes = log, catalog or Catalog(), edges, nodes

    # Reads.
    def record(self, identity: Any) -> DataFrame:
        return projection.detail(self.log.where(F.col("id") == identity))

    def timeline(self, before: int | None = None, limit: int = 50) -> DataFrame:
        return projection.summary(heads.timeline(self.log, before, limit))

    def entities(self, pattern: str | None = None, limit: int = 500) -> DataFrame:
        return heads.entity_directory(self.log, pattern).orderBy(F.desc("last_seq"), "entity").limit(limit)

    def document(self, entity: str, status: str = "active", most: int = 500) -> tuple[DataFrame, DataFrame]:
        live, gone = heads.document(self.log, entity, status, most)
        return projection.belief(live), projection.retraction(gone)

    def history(self, entity: str, key: str, before: int | None = None, limit: int = 50) -> DataFrame:
        return projection.version(heads.history(self.log, entity, key, before, limit))

    def delta(self, cursor: Mapping[str, Any] | None, scope: Mapping[str, Any], limit: int = 100) -> DataFrame:
        return projection.version(cursors.delta_of(self.log, cursor, scope, limit), with_entity=True)

    def search(self, sources: Mapping[str, search.Source], **options: Any) -> DataFrame:
        return search.search(self.log, {n: search.resolve(s, self.catalog) for n, s in sources.items()}, **options)

    def query_view(self, name: str, parameters: Mapping[str, Any], now: Column | None = None) -> DataFrame:
        return search.query_view(self.log, self.catalog, name, parameters, self.edges, self.nodes, now)

    def context(self, sections: Mapping[str, DataFrame], budget: int, consumer: bool = True) -> context.Context:
        return context.assemble(sections, budget, consumer)

    def listings(self) -> DataFrame:
        return storage.listing({f: list(items.values()) for f, items in self.catalog.families.items()}, self.log.sparkSession)

    # Writes.
    def ingest(self, batch: DataFrame, order: str = "ordinal", most: int | None = records.MOST_BATCH) -> tuple[DataFrame, DataFrame]:
        """(verdicts, the log with the batch); contents are checked against the schemas of the catalog's collections."""
        schemas = {c["name"]: c["schema"] for c in self.catalog.families.get("collections", {}).values() if c.get("schema")}
        judged = records.ingest(self.log, batch, schemas, order)
        return judged, records.append(self.log, judged, order, most)

    def erase(self, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the log without the seeds, their runs and all that descends from them; digests by collection)."""
        gone = provenance.erasure_scope(self.log, seeds)
        doomed = self.log.join(gone, "id", "left_semi")
        return self.log.join(gone, "id", "left_anti"), storage.erasure_digests(doomed)

    def promote(self, base: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
        verdicts = lifecycle.promotion(self.log, base, content)
        return verdicts, lifecycle.promoted(self.log, verdicts)

    def run_derivation(self, drafts: DataFrame, inputs: derivation.Inputs, emission: derivation.Emission, processor: str) -> DataFrame:
        """The rows that runs append, from what their tasks drafted."""
        visible = inputs.rows.groupBy("entity").agg(F.collect_set("id").alias("ids"))  # ``max_records`` an entity
        found = derivation.compile_candidates(drafts, derivation.expected_heads(self.log, emission), visible, emission)
        return derivation.commit(self.log, derivation.output_depths(found, self.log.select("id", "depth")), inputs.outcomes, emission, processor)

    def backfill(self, done: DataFrame, cursor: int, limit: int) -> tuple[DataFrame, int | None]:
        return storage.sweep_step(self.log, done, cursor, limit)

    def reindex_plan(self, since: int, slot: Sequence[str] = heads.SLOT) -> DataFrame:
        return provenance.reindex_scope(self.log, since, slot)

    # The catalog.
    def compat(self, new: Catalog) -> dict[str, compat.Judgement]:
        """What the changed collections of another catalog would do to stored rows."""
        own, other = (c.families.get("collections", {}) for c in (self.catalog, new))
        chain = {p["name"]: p["supersedes"] for p in new.families.get("processors", {}).values() if p.get("supersedes")}
        return {name: compat.judge(own[name], other[name], chain) for name in sorted(own.keys() & other.keys())}

    def prunable(self, runs_: DataFrame, uses: DataFrame) -> DataFrame:
        """(kind, name, n): what stored data still refers to; definitions that are not here can go."""
        return lifecycle.all_references(self.log, runs_, uses)
