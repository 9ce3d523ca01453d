"""Enrichment: write-once annotations, scores, readiness and the queues of what is still to do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.json_schema import checked
from ledgerlens.functions.render import truncate_middle

MODEL_BATCH, MOST_CHARS = 16, 8192


def marked_score(text: Column, name: str, low: float, high: float, default: float) -> Column:
    """A score read from a ``[name=number]`` mark, clamped to its scale; without a mark the default."""
    found = F.regexp_extract(text, rf"\[{name}=([-0-9.]+)\]", 1)
    value = F.when(found.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), found.cast("double"))
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value))).otherwise(F.lit(default))


def group_ready(rows: DataFrame, own: str = "complete", group: str = "run_id") -> DataFrame:
    """Rows of one run become ready together; rows without a run for themselves."""
    every = F.min(F.col(own).cast("int")).over(Window.partitionBy(group)) == 1
    return rows.withColumn("ready_now", F.when(F.col(group).isNull(), F.col(own)).otherwise(every))


def required_queue(rows: DataFrame, most: int = 32, most_of_run: int = 50) -> DataFrame:
    """Unready rows to work on: the whole run of the oldest, an error if that is over ``most_of_run`` rows; or, if the
    oldest has no run, the rows before the next run, ``most`` at most."""
    todo = rows.where(~F.col("ready"))
    oldest = todo.orderBy("seq").select("run_id").head()
    if oldest is not None and oldest["run_id"] is not None:
        run = todo.where(F.col("run_id") == F.lit(oldest["run_id"]))
        if len(run.select("run_id").head(most_of_run + 1)) > most_of_run:
            raise ValueError(f"the run {oldest['run_id']} has over {most_of_run} unready rows")
        return run
    running = F.max(F.col("run_id").isNotNull().cast("int")).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return todo.orderBy("seq").limit(most).withColumn("met_run", running).where("met_run = 0").drop("met_run")


def optional_queue(rows: DataFrame, bindings: DataFrame, done: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(id, processor): the first missing binding of each row, by its ordinal. ``failed``: work marked as terminal, which
    is not tried again."""
    want = rows.where("ready").select("id", "seq", "collection").join(bindings, "collection")
    missing = want.join(done if failed is None else done.unionByName(failed), ["id", "processor"], "left_anti")
    return missing.groupBy("id").agg(F.min_by("processor", "ordinal").alias("processor"), F.min("seq").alias("seq"))


def write_once(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id", "name")) -> DataFrame:
    """New annotations with ``verdict``: written, same or conflict."""
    before = old.select(*keys, F.col("value").alias("__old"), F.lit(True).alias("__there"))
    verdict = F.when(F.col("__there").isNull(), "written").when(F.col("__old").eqNullSafe(F.col("value")), "same").otherwise("conflict")
    return new.join(before, list(keys), "left").withColumn("verdict", verdict).drop("__old", "__there")


def json_annotation(rows: DataFrame, column: str, schema: Mapping[str, Any], score_fields: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with ``faults`` of a JSON answer under a schema, ``annotation`` where there are none, and ``scores``: numbers at
    the paths of ``score_fields``."""
    rows = checked(rows, column, schema)
    good = F.size("faults") == 0
    scores = [F.lit(x) if k else F.when(good, F.get_json_object(column, x).try_cast("double")) for pair in (score_fields or {}).items() for k, x in zip((1, 0), pair)]
    return rows.withColumn("annotation", F.when(good, F.col(column))).withColumn("scores", F.create_map(*scores) if scores else F.create_map().cast("map<string,double>"))


class Embedder(Protocol):
    """Vectors for a batch of texts; raises if the model cannot be reached."""

    size: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder for tests and offline use: bytes of SHA-256 counters, normalised."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{k}|{t}".encode("utf-8", "surrogatepass")).digest() for k in range(-(-self.size // 32)))[: self.size]
            v = np.frombuffer(raw, np.uint8).astype(float) / 127.5 - 1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


class BadVectors(ValueError):
    """A model's answer of wrong number or length, or with a value that is not finite."""


def checked_vectors(vectors: Sequence[Sequence[float]], n: int, size: int) -> list[list[float]]:
    if len(vectors) != n or any(len(v) != size or not np.isfinite(v).all() for v in vectors):
        raise BadVectors(f"{n} vectors of {size} finite numbers are wanted")
    return [list(map(float, v)) for v in vectors]


def embed(rows: DataFrame, embedder: Embedder, batch: int = MODEL_BATCH, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, vector, error): vectors of texts, in batches for the model; long texts lose their middle.

    Tombstones and rows without a text have no vector and no error. Where a batch fails its rows have the error, so that
    they can be annotated without a vector.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = [None] * len(part)
            errors: list = [None] * len(part)
            wanted = [k for k, (t, gone) in enumerate(zip(part["text"], part["tombstone"])) if isinstance(t, str) and not gone]
            for at in range(0, len(wanted), batch):
                own = wanted[at : at + batch]
                try:
                    made = checked_vectors(embedder([part["text"].iloc[k] for k in own]), len(own), embedder.size)
                except Exception as e:  # any fault of a model is an annotation, not the end of the job
                    made = [None] * len(own)
                    for k in own:
                        errors[k] = f"{type(e).__name__}: {e}"
                for k, v in zip(own, made):
                    vectors[k] = v
            yield pd.DataFrame({"id": part["id"], "vector": vectors, "error": errors})

    short = rows.select("id", truncate_middle(F.col("text"), most_chars).alias("text"), "tombstone")
    return short.mapInPandas(run, f"id {kind}, vector array<double>, error string")
