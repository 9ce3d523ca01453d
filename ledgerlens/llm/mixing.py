"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in an order drawn from their ids, form blocks of ``block_rows`` rows. Block i (from 1) of a source
with weight w may not start before slot floor((i - 1) / w) and must be out by slot ceil(i / w); earliest deadline first
among the released blocks fills one slot after the other. These windows are the Pfair ones, so at every slot each source
is less than one block away from its target share. When a source is exhausted, a new phase begins in which the others
keep their weights in proportion; the bound holds within each phase, and every row is scheduled once.

Only counts reach the driver: one a source. The schedule has one entry a block and is made there; the parameter
``most_blocks`` is its resolution: a block has ``block_rows`` rows, or so many more that about ``most_blocks`` hold all
rows. The bound of less than one block holds for blocks of any size. Weights are exact fractions.

Defined cases: a null source is a source of its own; a source without a given weight, or with one that is not positive,
is scheduled after all others; null ids and repeated rows are rows like others, told apart by the columns ``ties``, and
rows that are equal in these too take each other's places; a source of one row and very many sources are sources like
others; an empty table gives no rows; extra columns are kept, except that existing columns named block, slot, release,
deadline and turn are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BLOCKS, BUCKET_ROWS = 500_000, 4096
ADDED = ("block", "slot", "release", "deadline", "turn")


def pfair(blocks: Mapping[str, int], weights: Mapping[str, Fraction]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block; blocks count from 0, slots and windows from 0."""
    out: list[tuple[str, int, int, int, int]] = []
    done = dict.fromkeys(blocks, 0)
    start = 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s] and weights[s] > 0} or {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        given = {s: weights[s] if weights[s] > 0 else Fraction(1) for s in left}
        total = sum(given.values())
        share = {s: w / total for s, w in given.items()}
        released = [(0, s, 1) for s in sorted(left)]
        heapq.heapify(released)
        ready: list[tuple[int, str, int, int]] = []
        slot = 0
        while True:
            while released and released[0][0] <= slot:
                at, s, i = heapq.heappop(released)
                heapq.heappush(ready, (math.ceil(i / share[s]), s, i, at))
            deadline, s, i, at = heapq.heappop(ready)
            out.append((s, done[s], start + slot, start + at, start + deadline))
            done[s] += 1
            slot += 1
            if i == left[s]:
                break
            heapq.heappush(released, (math.floor(i / share[s]), s, i + 1))
        start += slot
    return out


def target_weights(counts: Mapping[str, int], power: float = 0.5) -> dict[str, Fraction]:
    """Weights in proportion to a power of the sizes: under 1 it lifts small sources."""
    return {s: Fraction(n**power).limit_denominator(1_000_000) for s, n in counts.items()}


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = 256, ties: Sequence[str] = (), most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``df`` with block (within the source), slot, release, deadline (all slots from 0) and turn (place within the slot).

    Reading by (slot, turn) gives the mix. ``weights``: target by source; by default the square roots of the sizes.
    Places depend on ids, ties and source counts only; ``ties`` are columns that tell rows of one id apart.
    A source's place numbers come from counts of hashed buckets, so a source with a third of all rows is no hot spot.
    """
    spark = df.sparkSession
    rows = df.drop(*ADDED).withColumn("__source", F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))))
    counts = {r["__source"]: r["count"] for r in rows.groupBy("__source").count().collect()}
    if not counts:
        return df.drop(*ADDED).select("*", *[F.lit(0).cast("long").alias(c) for c in ADDED])
    if weights is None:
        target = target_weights(counts)
    else:
        named = {"n" if k is None else f"s{k}": Fraction(v).limit_denominator(1_000_000) for k, v in weights.items()}
        target = {s: max(Fraction(0), named.get(s, Fraction(0))) for s in counts}
    size = max(block_rows, -(-sum(counts.values()) // most_blocks))
    schedule = spark.createDataFrame(pfair({s: -(-n // size) for s, n in counts.items()}, target), "__source string, block long, slot long, release long, deadline long")

    buckets = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in counts.items()], "__source string, __buckets long")
    rows = rows.join(F.broadcast(buckets), "__source").withColumn("__order", F.xxhash64(id_col, *ties, F.lit("mixing")))
    rows = rows.withColumn("__bucket", F.pmod(F.col("__order"), F.col("__buckets"))).drop("__buckets")
    sums = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n")).select("__source", "__bucket", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__source", "__bucket").orderBy("__order", id_col, *ties)
    placed = rows.withColumn("__place", F.row_number().over(own) - 1).join(before, ["__source", "__bucket"])
    place = F.col("__before") + F.col("__place")
    placed = placed.withColumn("block", F.floor(place / F.lit(size)).cast("long")).withColumn("turn", (place % size).cast("long"))
    return placed.join(schedule, ["__source", "block"]).select(*[c for c in df.columns if c not in ADDED], *ADDED)


def in_mixed_order(mixed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The rows written in the order of the mix: partitions are ranges of slots, sorted. ``keep``: added columns that stay."""
    return mixed.repartitionByRange("slot", "turn").sortWithinPartitions("slot", "turn").drop(*[c for c in ADDED if c not in keep])
