"""Trigger conditions against per-entity watermarks, in batch: each returns the entities that are due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.heads import heads, previous

AGGREGATES = {
    "count": lambda c: F.count("*").cast("double"),
    "sum": lambda c: F.sum(F.coalesce(c, F.lit(0.0))),
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "distinct_count": lambda c: F.count_distinct(c).cast("double"),
}


def watermarks(runs: DataFrame) -> DataFrame:
    """(entity, watermark, last_success) of successful runs: a run is the row of its entity's greatest high_seq."""
    ok = runs.where(F.col("outcome").isin("ok", "noop"))
    return ok.groupBy("entity").agg(F.max("high_seq").alias("watermark"), F.max_by("completed_at", F.struct("high_seq", "seq")).alias("last_success"))


def pending(log: DataFrame, marks: DataFrame, only_ready: bool = True) -> DataFrame:
    """Rows above their entity's watermark; entities without a run have 0."""
    rows = log.join(marks.select("entity", "watermark"), "entity", "left").withColumn("watermark", F.coalesce("watermark", F.lit(0)))
    return rows.where((F.col("seq") > F.col("watermark")) & (F.col("ready") if only_ready else F.lit(True)))


def on_write(log: DataFrame, marks: DataFrame, condition: Column) -> DataFrame:
    """(entity, n): entities with a pending row for which the condition holds."""
    return pending(log, marks).where(F.coalesce(condition, F.lit(False))).groupBy("entity").agg(F.count("*").alias("n"))


def accumulator(log: DataFrame, marks: DataFrame, metric: str, aggregate: str, threshold: float, comparison: str = "gte") -> DataFrame:
    """(entity, matched, amount): entities whose aggregate over pending rows passes the threshold; null never does."""
    if comparison == "gte" and threshold <= 0:
        raise ValueError("a gte threshold is positive")
    sums = pending(log, marks).groupBy("entity").agg(F.count("*").alias("matched"), AGGREGATES[aggregate](F.col(metric)).cast("double").alias("amount"))
    return sums.where(F.col("amount") >= threshold if comparison == "gte" else F.col("amount") <= threshold)


def transitions(log: DataFrame, slot: Sequence[str], content: str) -> DataFrame:
    """Keyed rows with ``change`` against the row before in the slot: added, removed, changed or unchanged."""
    gone = previous("tombstone", slot)
    keyed = log.where("key IS NOT NULL").withColumn("__gone", F.coalesce(gone, F.lit(True))).withColumn("__old", previous(content, slot))
    change = F.when(F.col("tombstone"), F.when(F.col("__gone"), "unchanged").otherwise("removed")).when(F.col("__gone"), "added").when(~F.col("__old").eqNullSafe(F.col(content)), "changed").otherwise("unchanged")
    return keyed.withColumn("change", change).drop("__gone", "__old")


def on_change(log: DataFrame, marks: DataFrame, slot: Sequence[str], content: str, kinds: Sequence[str]) -> DataFrame:
    """(entity, n): entities with a pending transition of one of the kinds."""
    return pending(transitions(log, slot, content), marks).where(F.col("change").isin(list(kinds))).groupBy("entity").agg(F.count("*").alias("n"))


def census(log: DataFrame, marks: DataFrame, floor: int, condition: Column | None = None) -> DataFrame:
    """(entity, live): entities with at least ``floor`` live heads and something pending. The condition is on heads."""
    slot = F.coalesce(F.col("key"), F.col("seq").cast("string"))
    now = heads(log.where("ready").withColumn("__slot", slot), ("entity", "__slot")).where(~F.col("tombstone"))
    live = (now if condition is None else now.where(F.coalesce(condition, F.lit(False)))).groupBy("entity").agg(F.count("*").alias("live")).where(F.col("live") >= floor)
    return live.join(pending(log, marks).select("entity").distinct(), "entity", "left_semi")


def lifecycle(log: DataFrame, marks: DataFrame, total: int | None = None) -> DataFrame:
    """(entity, n): a first record (no run yet), or at least ``total`` records; only entities with something pending."""
    rows = log.where("ready").groupBy("entity").agg(F.count("*").alias("n"), F.max("seq").alias("high"))
    rows = rows.join(marks.select("entity", "watermark"), "entity", "left").where("high > coalesce(watermark, 0)")
    return rows.where("watermark IS NULL" if total is None else F.col("n") >= total).select("entity", "n")


def deadlines(log: DataFrame, marks: DataFrame, field: str, offset_s: int) -> DataFrame:
    """(entity, due): the earliest ``field`` + offset after the last success."""
    due = F.col(field) + F.make_interval(secs=F.lit(offset_s))
    rows = log.where("ready AND NOT tombstone").join(marks.select("entity", "last_success"), "entity", "left").withColumn("due", due)
    return rows.where(F.col("last_success").isNull() | (F.col("due") > F.col("last_success"))).groupBy("entity").agg(F.min("due").alias("due"))


def quiet_periods(log: DataFrame, after_s: int, time: str = "occurred_at") -> DataFrame:
    """(entity, started, ended, n): bursts of rows parted by more than ``after_s`` seconds; a burst is settled at its end plus that."""
    order = Window.partitionBy("entity").orderBy(time, "seq")
    gap = F.timestamp_diff("SECOND", F.lag(time).over(order), F.col(time))
    cut = F.sum(F.when(gap.isNull() | (gap > after_s), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("burst", cut).groupBy("entity", "burst").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))


def cooled_down(marks: DataFrame, now: str, cooldown_s: int) -> DataFrame:
    """(entity, due): the later of now and the last success plus the cooldown."""
    kind = marks.schema["last_success"].dataType
    return marks.select("entity", F.greatest(F.lit(now).cast(kind), F.col("last_success") + F.make_interval(secs=F.lit(cooldown_s))).alias("due"))


def mailbox(requests: DataFrame) -> DataFrame:
    """One job for each (derivation, entity): reasons merged, the earliest and the latest time."""
    return requests.groupBy("derivation", "entity").agg(F.min("due").alias("earliest"), F.max("due").alias("latest"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def freshness(log: DataFrame, marks: DataFrame) -> DataFrame:
    """(entity, watermark, dirty, pending_unready): whether ready rows wait, and whether the first waiting row is unready."""
    rows = pending(log, marks, only_ready=False).groupBy("entity").agg(F.max_by("ready", F.struct((-F.col("seq")).alias("s"))).alias("first_ready"), F.max("ready").alias("some"))
    out = log.select("entity").distinct().join(marks.select("entity", "watermark"), "entity", "left").join(rows, "entity", "left")
    return out.select("entity", F.coalesce("watermark", F.lit(0)).alias("watermark"), F.coalesce("some", F.lit(False)).alias("dirty"), F.coalesce(~F.col("first_ready"), F.lit(False)).alias("pending_unready"))


def without_own_outputs(rows: DataFrame, runs: DataFrame, processor: str) -> DataFrame:
    """Rows that no run of this processor made; rows without a run, or whose run is gone, stay."""
    own = runs.where(F.col("processor") == processor).select("run_id")
    return rows.join(own, "run_id", "left_anti")


def debounced(arrivals: DataFrame, after_s: int, waiting: DataFrame, time: str = "occurred_at") -> DataFrame:
    """(entity, due, n): each arrival puts its entity's job off to ``after_s`` later, never to an earlier time than before."""
    last = arrivals.groupBy("entity").agg((F.max(time) + F.make_interval(secs=F.lit(after_s))).alias("__due"), F.count("*").alias("n"))
    return last.join(waiting, "entity", "left").select("entity", F.greatest("__due", "due").alias("due"), "n")


def cron_jobs(entities: DataFrame, name: str, schedule: str, after: str, until: str, most: int = 100) -> DataFrame:
    """(entity, job): a job for each entity and due bucket in (after, until], named so that a second sweep adds none."""
    import datetime as dt

    from ledgerlens.functions.schedule import Cron

    stamps = [f"{name}:{b:%Y-%m-%d %H:%M}" for b in Cron(schedule).buckets(dt.datetime.fromisoformat(after), dt.datetime.fromisoformat(until), most)]
    return entities.select("entity", F.explode(F.array(*map(F.lit, stamps)) if stamps else F.array().cast("array<string>")).alias("job"))


def stale_on_read(log: DataFrame, marks: DataFrame, now: str, max_staleness_s: int) -> DataFrame:
    """(entity, reason): entities that a read should refresh: never run, dirty, or last run too long ago."""
    dirty = pending(log, marks).select("entity").distinct().withColumn("dirty", F.lit(True))
    all_ = log.select("entity").distinct().join(marks.select("entity", "last_success"), "entity", "left").join(dirty, "entity", "left")
    limit = F.lit(now).cast(marks.schema["last_success"].dataType) - F.make_interval(secs=F.lit(max_staleness_s))
    reason = F.when(F.col("last_success").isNull(), "never_run").when(F.col("dirty"), "dirty").when(F.col("last_success") <= limit, "aged")
    return all_.select("entity", reason.alias("reason")).where("reason IS NOT NULL")


def backoff(attempts: Column) -> Column:
    """Seconds before the next attempt."""
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(4.0), attempts - 1))
