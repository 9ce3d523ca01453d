"""Provenance over ``derived_from``: closures, depth, stale citations, divergence, retention, audits and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.heads import heads
from ledgerlens.session import held


def parents(log: DataFrame, id_col: str = "id", column: str = "derived_from") -> DataFrame:
    return log.select(F.col(id_col).alias("child"), F.explode(column).alias("parent"))


#: Rows of a frontier that are sent to all tasks, and edges that are walked here; more are joined by shuffle.
SMALL = 10_000


def _few(edges: DataFrame) -> list[tuple] | None:
    """The edges (child, parent), if there are at most ``SMALL``."""
    rows = edges.limit(SMALL + 1).collect()
    return [(r["child"], r["parent"]) for r in rows] if len(rows) <= SMALL else None


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, distance): seeds and all that descends from them. Each round joins the frontier of the last one only.

    Ends at the fix point: ids that are known are not met again, so cycles end too. While what is known has at most
    ``SMALL`` rows it is held here, and a round is one pass over the edges without a shuffle of them; beyond that rounds
    are written tables.
    """
    spark, edges = seeds.sparkSession, held(edges.select("child", "parent"))
    schema = seeds.select(F.col("id"), F.lit(0).alias("distance")).schema
    first = seeds.select("id").distinct().limit(SMALL + 1).collect()
    n, near, known = 0, {r["id"] for r in first}, {r["id"]: 0 for r in first}
    if len(known) <= SMALL and (few := _few(edges)) is not None:
        children: dict = {}
        for child, parent in few:
            children.setdefault(parent, []).append(child)
        while near:
            n += 1
            near = {c for i in near for c in children.get(i, ())} - known.keys()
            known.update(dict.fromkeys(near, n))
        return spark.createDataFrame(list(known.items()), schema)
    while near and len(known) <= SMALL:
        n += 1
        frontier = spark.createDataFrame([(i,) for i in near], schema[:1]).withColumnRenamed("id", "parent")
        found = edges.join(F.broadcast(frontier), "parent").select("child").distinct().limit(SMALL + len(known) + 1).collect()
        near = {r["child"] for r in found} - known.keys()
        known.update(dict.fromkeys(near, n))
    if len(known) <= SMALL:
        return spark.createDataFrame(list(known.items()), schema)
    if n:  # the last round may not be whole: it is done again
        known = {i: d for i, d in known.items() if d < n}
        every = held(spark.createDataFrame(list(known.items()), schema))
        return _closed(edges, every, every.where(F.col("distance") == n - 1), n - 1)
    every = held(seeds.select(F.col("id"), F.lit(0).alias("distance")).distinct())
    return _closed(edges, every, every, 0)


def _closed(edges: DataFrame, known: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    while True:
        n += 1
        fresh = held(edges.join(frontier.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct().join(known, "id", "left_anti").withColumn("distance", F.lit(n)))
        if not fresh.head(1):
            return known
        known, frontier = known.unionByName(fresh), fresh
        if n % 16 == 0:
            known = held(known)


def erasure_scope(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): rows to erase: the seeds, the runs that made them, and all that descends from either."""
    own = seeds.select("id").union(seeds.where("run_id IS NOT NULL").select("run_id"))
    return closure(parents(log.where("derived_from IS NOT NULL")), own).select("id")


def ancestry_faults(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(child, cycle, bad_order, foreign_tenant, missing): what is wrong with a row's parents."""
    child = rows.select(F.col("id").alias("child"), F.col("seq").alias("__own"), F.col("workspace").alias("__tenant"))
    parent = rows.select(F.col("id").alias("parent"), F.col("seq").alias("__seq"), F.col("workspace").alias("__other"))
    found = edges.join(child, "child").join(parent, "parent", "left")
    foreign = F.col("__other").isNotNull() & (F.col("__other") != F.col("__tenant"))
    return found.groupBy("child").agg(F.bool_or(F.col("parent") == F.col("child")).alias("cycle"), F.bool_or(F.col("__seq") >= F.col("__own")).alias("bad_order"), F.bool_or(foreign).alias("foreign_tenant"), F.bool_or(F.col("__seq").isNull()).alias("missing"))


def id_digests(rows: DataFrame, by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """(by, erased, digest): the number of different ids of each group, and a digest of them.

    The digest is SHA-256 over the digests of 256 parts, in order: ids are parted by the first two hexadecimal letters of
    their own digest, and sorted within a part, each ended by a null sign. So no task holds all ids of a group.
    """
    own = rows.select(*by, F.col(id_col).cast("string").alias("id")).distinct().withColumn("part", F.substring(F.sha2("id", 256), 1, 2))
    parts = own.groupBy(*by, "part").agg(F.count("*").alias("n"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("id")), "\x00"), F.lit("\x00")), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("erased"), F.sha2(whole, 256).alias("digest"))


def erase(log: DataFrame, doomed: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(log without the closure, audit row): the audit has the count and a digest of the ids (``id_digests``)."""
    gone = doomed.select(F.col("id").alias(id_col)).distinct()
    return log.join(gone, id_col, "left_anti"), id_digests(gone, (), id_col)


def depths(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): 0 for roots, else one more than the deepest parent. Round n holds the rows with a path of n steps."""
    edges = held(edges.select("child", "parent"))
    if (few := _few(edges)) is not None:
        return _merged_depths(rows, edges, few)
    level = held(edges.select(F.col("child").alias("id")).distinct())
    longest = level.count()  # without a cycle no path has more steps than there are children
    found = rows.select("id", F.lit(0).alias("depth"))
    n = 0
    while level.head(1):
        n += 1
        if n > longest:
            raise ValueError("derived_from has a cycle: depths are not defined")
        found = found.unionByName(level.withColumn("depth", F.lit(n)))
        if n % 16 == 0:
            found = held(found.groupBy("id").agg(F.max("depth").alias("depth")))
        level = held(edges.join(level.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct())
    return found.groupBy("id").agg(F.max("depth").alias("depth"))


def _merged_depths(rows: DataFrame, edges: DataFrame, few: list[tuple]) -> DataFrame:
    """``depths`` where the edges are few: in the order in which parents come before children."""
    from graphlib import CycleError, TopologicalSorter

    above: dict = {}
    for child, parent in few:
        above.setdefault(child, set()).add(parent)
    try:
        order = list(TopologicalSorter(above).static_order())
    except CycleError:
        raise ValueError("derived_from has a cycle: depths are not defined") from None
    depth: dict = {}
    for i in order:
        depth[i] = max((depth[p] + 1 for p in above.get(i, ())), default=0)
    found = rows.sparkSession.createDataFrame([(i, depth[i]) for i in above], edges.select(F.col("child").alias("id"), F.lit(0).alias("depth")).schema)
    return rows.select("id", F.lit(0).alias("depth")).unionByName(found).groupBy("id").agg(F.max("depth").alias("depth"))


def stale_citations(log: DataFrame, edges: DataFrame, slot: Sequence[str]) -> DataFrame:
    """(child, parent, newer): live heads that cite a row of which a newer ready version exists."""
    live = heads(log.where("key IS NOT NULL"), slot).where(F.col("ready") & ~F.col("tombstone"))
    newest = log.where("ready AND key IS NOT NULL").groupBy(*slot).agg(F.max("seq").alias("newer"))
    cited = edges.join(live.select(F.col("id").alias("child")), "child", "left_semi")
    parent = log.where("key IS NOT NULL").select(F.col("id").alias("parent"), F.col("seq").alias("parent_seq"), *slot)
    return cited.join(parent, "parent").join(newest, list(slot)).where("newer > parent_seq").select("child", "parent", "newer")


def divergence(old: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys, change): added, changed, removed or unchanged."""
    a = old.select(*keys, F.col(content).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.col(content).alias("__new"), F.lit(True).alias("__in_new"))
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def expired_slots(log: DataFrame, slot: Sequence[str], horizon: str, time: str = "occurred_at", most: int | None = None) -> DataFrame:
    """Slots whose head is a tombstone made up to ``horizon``, oldest first."""
    kind = log.schema[time].dataType
    out = heads(log.where("key IS NOT NULL"), slot).where(F.col("tombstone") & (F.col(time) <= F.lit(horizon).cast(kind))).select(*slot, "seq")
    return out if most is None else out.orderBy("seq").limit(most)


def purge(log: DataFrame, slots: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Ids of every version of the slots, of the runs that made them, and of all that descends from either."""
    own = log.join(slots.select(*slot), list(slot), "left_semi")
    seeds = own.select("id")
    if "run_id" in log.columns:
        seeds = seeds.union(own.where("run_id IS NOT NULL").select("run_id"))
    if "derived_from" in log.columns:
        seeds = closure(parents(log), seeds).select("id")
    elif "run_id" not in log.columns:
        return seeds
    return log.select("id").join(seeds.distinct(), "id", "left_semi")


def coverage(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Counts of rows, of rows with a staged vector and of rows resolved without one."""
    joined = rows.select("id").join(staged.select("id", "has_vector"), "id", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if("has_vector").alias("embedded"), F.count_if(F.col("has_vector").isNull()).alias("pending"))


def vintage(rows: DataFrame, expected: Mapping[str, str], meta: str = "annotation_meta") -> DataFrame:
    """(name, n): annotations whose stored config hash is not the expected one."""
    wanted = rows.sparkSession.createDataFrame(list(expected.items()), "name string, wanted string")
    return rows.select(F.explode(meta).alias("name", "hash")).join(F.broadcast(wanted), "name").where("hash <> wanted").groupBy("name").agg(F.count("*").alias("n"))


def reindex_scope(log: DataFrame, since: int, slot: Sequence[str]) -> DataFrame:
    """Ids to index again: ready rows from ``since`` on, and the earlier heads of the slots they touch."""
    fresh = log.where((F.col("seq") > since) & F.col("ready"))
    touched = fresh.where("key IS NOT NULL").select(*slot).distinct()
    before = heads(log.where((F.col("seq") <= since) & F.col("ready")).join(touched, list(slot), "left_semi"), slot)
    return fresh.select("id").union(before.select("id")).distinct()
