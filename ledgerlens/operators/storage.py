"""Changes of stored data: hash rewrites and their proof, staged vectors, sweeps, audits and the read side of jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.json_schema import checked
from ledgerlens.operators.provenance import id_digests


def rewrite_hash(rows: DataFrame, collection: str, version: int, old: str, new: str) -> DataFrame:
    """Rows of a contract carried forward to its new hash."""
    own = (F.col("collection") == collection) & (F.col("version") == version) & (F.col("hash") == old)
    return rows.withColumn("hash", F.when(own, new).otherwise(F.col("hash")))


def rewrite_offenders(rows: DataFrame, properties: Mapping[str, Mapping[str, Any]], absent: Sequence[str] = ()) -> DataFrame:
    """(id, faults): rows that a new contract would not accept: values of newly declared properties that do not fit them,
    and annotations that must not be there yet."""
    rows = checked(rows, "content", {"type": "object", "properties": dict(properties)}, "__faults")
    faults = F.col("__faults")
    for name in absent:
        faults = F.concat(faults, F.when(F.array_contains(F.map_keys("annotations"), name), F.array(F.lit(f"annotation:{name}"))).otherwise(F.array().cast("array<string>")))
    return rows.select("id", faults.alias("faults")).where(F.size("faults") > 0)


def cutover(rows: DataFrame, staged: DataFrame, space: str) -> DataFrame:
    """Rows (id, space, vector) with the staged vectors of a new space, and the old ones beside them, so it can be undone.

    Rows without a staged vector are left without one. An error if a row is neither staged nor resolved without a vector.
    """
    new = staged.select("id", F.col("vector").alias("__new"), F.lit(True).alias("__there"))
    both = rows.join(new, "id", "left")
    return both.select("id", F.lit(space).alias("space"), F.col("__new").alias("vector"), F.col("space").alias("old_space"), F.col("vector").alias("old_vector"), F.col("__there").isNull().alias("pending"))


def undo_cutover(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("old_space").alias("space"), F.col("old_vector").alias("vector"))


def sweep_step(rows: DataFrame, done: DataFrame, cursor: int, limit: int) -> tuple[DataFrame, int | None]:
    """A page of a backfill and where its cursor goes: to the page's last row; to 0 for a confirming pass if the page is
    empty and the sweep did not begin at 0; None when a pass from 0 finds nothing."""
    from ledgerlens.operators.lifecycle import backfill_page

    page = backfill_page(rows, done, cursor, limit)
    last = page.agg(F.max("seq")).first()[0]
    return page, last if last is not None else 0 if cursor else None


def contract_audit(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """(collection, version, hash, n, first_id): stored contracts that the catalog does not have."""
    stored = rows.groupBy("collection", "version", "hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))  # one row a contract
    return stored.join(contracts, ["collection", "version", "hash"], "left_anti")


def vector_audit(rows: DataFrame, space: str, model: str) -> DataFrame:
    """(space, model, n, first_id): stored vectors of another space or model than the configured ones."""
    other = rows.where(F.col("vector_space").isNotNull() & ~(F.col("vector_space").eqNullSafe(F.lit(space)) & F.col("vector_model").eqNullSafe(F.lit(model))))
    return other.groupBy("vector_space", "vector_model").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def processor_audit(rows: DataFrame, known: Mapping[str, str]) -> DataFrame:
    """(name, fault, n, first_id): annotations, their metadata and terminal markers of processors that the catalog does not
    have, or has with another hash. ``rows``: annotations and terminal (maps by name), annotation_meta (name to hash)."""
    names = F.array_distinct(F.concat(F.map_keys("annotations"), F.map_keys("annotation_meta"), F.map_keys("terminal")))
    expected = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    flat = rows.select("id", "annotation_meta", F.explode(names).alias("name"))
    want = expected[F.col("name")]
    fault = F.when(want.isNull(), "unknown").when(F.col("annotation_meta")[F.col("name")].isNotNull() & (F.col("annotation_meta")[F.col("name")] != want), "hash")
    return flat.select("id", "name", fault.alias("fault")).where("fault IS NOT NULL").groupBy("name", "fault").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def job_status(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(job, state, attempts, seconds, runs): jobs with their timing and the runs that they made, newest first."""
    made = runs.where("job IS NOT NULL").groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "run")), asc=False), lambda x: x["run"]).alias("runs"))  # one or few runs a job
    state = F.when(F.col("done_at").isNotNull(), F.when(F.col("error").isNull(), "done").otherwise("failed")).when(F.col("started_at").isNotNull(), "running").otherwise("waiting")
    return jobs.join(made, "job", "left").select("job", state.alias("state"), "attempts", F.timestamp_diff("SECOND", F.col("started_at"), F.col("done_at")).alias("seconds"), F.coalesce("runs", F.array().cast(made.schema["runs"].dataType)).alias("runs"))


def erasure_digests(doomed: DataFrame) -> DataFrame:
    """(collection, erased, digest): what an erasure took from each collection."""
    return id_digests(doomed, ("collection",))


def contract_groups(log: DataFrame) -> DataFrame:
    """(collection, version, hash, n): the contracts that rows are stored under."""
    return log.groupBy("collection", "version", "hash").agg(F.count("*").alias("n"))


def subset_faults(rows: DataFrame, have: str, allowed: Column, required: Column | None = None) -> DataFrame:
    """(id, extra, missing): what an array column has beyond what is allowed, and lacks of what is required."""
    missing = F.array_except(required if required is not None else F.array().cast(rows.schema[have].dataType), F.col(have))
    return rows.select("id", F.array_except(F.col(have), allowed).alias("extra"), missing.alias("missing")).where("size(extra) > 0 OR size(missing) > 0")


def entity_page(log: DataFrame, after: str | None, limit: int = 500) -> DataFrame:
    """The next entities by name after a cursor."""
    rows = log.select("entity").distinct()
    return (rows if after is None else rows.where(F.col("entity") > after)).orderBy("entity").limit(limit)


def listing(families: Mapping[str, Sequence[Mapping[str, Any]]], spark) -> DataFrame:
    """(family, name, version, summary): the catalog's definitions as rows."""
    import json

    rows = [(f, str(d["name"]), int(d.get("version", 1)), json.dumps({k: v for k, v in d.items() if k not in ("name", "version")}, sort_keys=True, default=str)) for f, items in families.items() for d in items]
    return spark.createDataFrame(rows, "family string, name string, version int, summary string")
