"""Current versions of keyed values, and the versions before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("entity", "collection", "key", "status")


def is_current(slot: Sequence[str] = SLOT) -> Column:
    """Whether no newer row is in the slot; rows of any readiness count."""
    return F.max("seq").over(Window.partitionBy(*slot)) == F.col("seq")


def heads(rows: DataFrame, by: Sequence[str], order: str = "seq") -> DataFrame:
    """The newest row of each slot. Spark limits each task to its first rows before the shuffle."""
    newest = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def previous(column: str, slot: Sequence[str] = SLOT) -> Column:
    """The value of ``column`` in the row before this one in its slot."""
    return F.lag(column).over(Window.partitionBy(*slot).orderBy("seq"))


def document(log: DataFrame, entity: str | None = None, status: str = "active", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(live heads, retractions) of keyed rows in one lane; unready rows count. More heads than ``most`` is an error."""
    rows = log.where((F.col("status") == status) & F.col("key").isNotNull())
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    now = heads(rows, ("entity", "collection", "key"))
    if most is not None and now.limit(most + 1).count() > most:
        raise ValueError(f"the document has more than {most} heads")
    return now.where(~F.col("tombstone")), now.where("tombstone")


def history(log: DataFrame, entity: str, key: str, before: int | None = None, limit: int = 50) -> DataFrame:
    """All versions of a key, newest first, below ``before``."""
    rows = log.where((F.col("entity") == entity) & (F.col("key") == key))
    if before is not None:
        rows = rows.where(F.col("seq") < before)
    return rows.orderBy(F.desc("seq")).limit(limit)


def timeline(log: DataFrame, before: int | None = None, limit: int = 50) -> DataFrame:
    """A page of rows, newest first, by keyset."""
    return (log if before is None else log.where(F.col("seq") < before)).orderBy(F.desc("seq")).limit(limit)


def delta(log: DataFrame, position: int, limit: int) -> DataFrame:
    """Rows after a cursor, oldest first; unready rows and tombstones too."""
    return log.where(F.col("seq") > position).orderBy("seq").limit(limit)


def entity_directory(log: DataFrame, pattern: str | None = None) -> DataFrame:
    rows = log if pattern is None else log.where(F.col("entity").ilike(pattern))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def ready_prefix(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows up to the first that is not ready. The cut is bounded before it is ordered in one place."""
    first = rows.orderBy("seq").limit(most)
    running = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("__ok", F.min(F.col("ready").cast("int")).over(running)).where("__ok = 1").drop("__ok")


def snapshot(rows: DataFrame, recent: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A frozen range of rows, oldest first: the newest ``recent``, or those within inclusive bounds."""
    kind = rows.schema["occurred_at"].dataType
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(since).cast(kind))
    if until is not None:
        rows = rows.where(F.col("occurred_at") <= F.lit(until).cast(kind))
    return rows if recent is None else rows.orderBy(F.desc("seq")).limit(recent)
