"""The incremental pass: what arrives is appended, and triggers are evaluated against state, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerlens.operators.heads import heads


def quiet_sessions(stream: DataFrame, after: str, late: str, time: str = "occurred_at") -> DataFrame:
    """(entity, started, ended, n): bursts of rows that end when nothing came for ``after``; rows later than ``late`` are dropped."""
    session = F.session_window(F.col("t"), after)
    rows = stream.select("entity", F.col(time).cast("timestamp").alias("t")).withWatermark("t", late)
    return rows.groupBy("entity", session).agg(F.count("*").alias("n"), F.max("t").alias("ended")).select("entity", F.col("session_window.start").alias("started"), "ended", "n")


def accumulate(stream: DataFrame, metric: str, threshold: float) -> DataFrame:
    """(entity, matched, amount) each time an entity's sum since its last firing reaches the threshold; then it starts anew."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, amount = state.get if state.exists else (0, 0.0)
        out = []
        for part in parts:
            for x in part.sort_values("seq")["x"].fillna(0.0):
                n, amount = n + 1, amount + float(x)
                if amount >= threshold:
                    out.append((key[0], n, amount))
                    n, amount = 0, 0.0
        state.update((n, amount))
        yield pd.DataFrame(out, columns=["entity", "matched", "amount"])

    rows = stream.where("ready").select("entity", "seq", F.col(metric).cast("double").alias("x"))
    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, matched long, amount double", "n long, amount double", "append", GroupStateTimeout.NoTimeout)


def pass_by_pass(stream: DataFrame, log_path: str, checkpoint: str, evaluate: Callable[[SparkSession, DataFrame, int], None]) -> StreamingQuery:
    """One pass a micro-batch: append its rows under its own number, so that a repeated batch replaces itself, then evaluate."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        evaluate(batch.sparkSession, batch.sparkSession.read.parquet(log_path), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_state(stream: DataFrame, state_path: str, checkpoint: str, slot: tuple[str, ...] = ("entity", "collection", "key", "status")) -> StreamingQuery:
    """Current heads and per-entity counts as state tables that each micro-batch carries on.

    A batch reads the state of the batch before and its own rows, never the log: its cost does not grow with history. State
    is written under the batch's number, so a repeated batch replaces what it wrote; older states are left to the caller.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        known = heads_state(spark, state_path, number - 1, rows.schema)
        newest = heads(known.unionByName(rows), slot)
        newest.write.mode("overwrite").parquet(f"{state_path}/heads/batch={number}")
        counts = rows.groupBy("entity").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
        if number:
            counts = counts.unionByName(spark.read.parquet(f"{state_path}/counts/batch={number - 1}")).groupBy("entity").agg(F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"))
        counts.write.mode("overwrite").parquet(f"{state_path}/counts/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heads_state(spark: SparkSession, state_path: str, number: int, schema: StructType) -> DataFrame:
    """The heads after a batch; before the first there are none."""
    return spark.createDataFrame([], schema) if number < 0 else spark.read.schema(schema).parquet(f"{state_path}/heads/batch={number}")


def index_sink(stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """An index that follows a stream of projected rows (``lifecycle.index_rows`` with a ``deleted`` flag): upserts and
    deletes by id. The batch's ids replace what the index had of them; versions are numbered by batch."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        if number:
            rows_before = spark.read.parquet(f"{index_path}/version={number - 1}")
            now = rows_before.join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows.where("NOT deleted").drop("deleted"))
        else:
            now = rows.where("NOT deleted").drop("deleted")
        now.write.mode("overwrite").parquet(f"{index_path}/version={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
