"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

A document's set is its distinct runs of five lower-cased words. SuperMinHash gives element x, for each of the
``REGISTERS`` places, the rank of that place in a permutation drawn from x plus a random fraction; a register keeps the
least. Ranks of one element are correlated, so signatures vary less than independent hashes, and once every register
is below the next rank no later rank can matter: most documents stop after one or two.

1. Documents with equal sets are one node, named by their smallest id, before anything else is compared.
2. Bands of ``ROWS`` registers put nodes in buckets (a pair at similarity 0.75 misses all bands with probability 5e-6).
3. In each bucket every member is verified against one pivot on full sets: members - 1 pairs, not all pairs. The pivot
   is the member that meets most others over all buckets, so the middle of a group, which is similar to all of it.
4. Verified links are grouped. Members of a bucket that ended in one group need no more comparisons.
5. Where a bucket still spans groups, members outside its largest group are compared with the members of other groups,
   in blocks of ``BLOCK`` sets whose intersections are one matrix product; of the links found in a block only those
   leave it that join groups which were apart.
6. The links of 3 and 5 give the components.

Defined cases: null and empty texts have an empty set and are linked with nothing; texts under five words are one
shingle; rows that share an id are one document with several texts; rows with a null id are linked with nothing, their
component_id is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common
from ledgerlens.llm.components import connected_components

REGISTERS, ROWS, WORDS, BLOCK = 128, 4, 5, 256
#: Links need NUMERATOR / DENOMINATOR of the union at least.
NUMERATOR, DENOMINATOR = 75, 100
CHUNK = 4096


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run."""
    hashes = common.word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    return np.unique(common.rolled(hashes, min(size, len(hashes))))


def super_min_hash(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The signature: float64 registers. Level by level, all elements of a chunk at a time."""
    least = np.full(registers, np.inf)
    for at in range(0, len(elements), CHUNK):
        x = elements[at : at + CHUNK]
        rows, places = np.arange(len(x)), None
        for level in range(registers):
            if level > least.max():
                break
            x = common.mix(x + common.MULTIPLIER)
            fraction = (x >> np.uint64(11)) * 2.0**-53
            pick = level + ((x & np.uint64(0x7FF)).astype(np.int64) * (registers - level) >> 11)
            if level == 0:
                first = place = pick
            else:
                if places is None:
                    places = np.tile(np.arange(registers, dtype=np.int16), (len(x), 1))
                    places[rows, first] = 0
                    places[:, 0] = first
                place = places[rows, pick]
                places[rows, pick] = places[:, level]
                places[:, level] = place
            np.minimum.at(least, place, fraction + level)
    return least


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different bands apart."""
    x = signature.view(np.uint64).reshape(-1, ROWS)
    key = np.arange(len(x), dtype=np.uint64) * common.MULTIPLIER
    for k in range(ROWS):
        key = common.mix(key * common.MULTIPLIER + x[:, k])
    return key.view(np.int64)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign():

        def work(columns: dict[str, list]) -> dict[str, list]:
            sets = [shingles(t) for t in columns["text"]]
            return {
                "id": columns["id"],
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [bands(super_min_hash(s)).tolist() if len(s) > 2 else [] for s in sets],  # under 3, only equal sets reach 0.75
            }

        return work

    signed = common.materialise(common.map_rows(docs, "id long, n long, digest binary, bands array<long>", sign), "signatures")
    named = signed.where("id IS NOT NULL AND digest IS NOT NULL")
    # A table of its own, so that the join below reads two plain shuffles, of which adaptive execution splits a large group.
    nodes = common.materialise(named.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    members = common.materialise(named.join(nodes, "digest").select("id", "node", "bands", (F.col("id") == F.col("node")).alias("is_node")), "members")

    banded = members.where("is_node").select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("last"), F.count("*").alias("size")).where("low < last").select("key", "size")
    met = common.materialise(banded.join(shared, "key").distinct(), "met")
    # The pivot is the member that meets most others over all its buckets: the middle of a group links with all of it.
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = common.materialise(met.select("key", "node").join(weights, "node"), "weighed")
    pivots = common.materialise(weighed.groupBy("key").agg(F.min(F.struct(-F.col("weight"), "node")).alias("first")).select("key", F.col("first.node").alias("pivot")), "pivots")
    buckets = common.materialise(weighed.select("key", "node").join(pivots, "key"), "buckets")
    common.discard(met, weighed, pivots)

    sets = _sets(docs, buckets.select(F.col("node").alias("id")).distinct())
    pairs = buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = common.materialise(_verified(pairs, sets), "links")
    groups = connected_components(links)
    more = common.materialise(_residual(buckets, groups, sets), "more-links")
    if more.head(1):
        groups = connected_components(links.unionAll(more))

    of_id = members.select(F.col("id").alias("member"), "node").distinct()
    of_id = of_id.join(groups, "node", "left").groupBy("member").agg(F.min(F.coalesce("component", "node")).alias("component"))
    out = signed.join(of_id, signed["id"] == of_id["member"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, elements) of the documents in ``ids``: 8 bytes a shingle, for documents that share a bucket only."""

    def each():
        return lambda columns: {"id": columns["id"], "elements": [shingles(t).tobytes() for t in columns["text"]]}

    likely = common.keep_likely(docs, ids, "id").join(ids, "id", "left_semi")
    return common.materialise(common.map_rows(likely, "id long, elements binary", each).where("length(elements) > 0").distinct(), "sets")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    size = F.length("x"), F.length("y")
    full = full.where(DENOMINATOR * F.least(*size) >= NUMERATOR * F.greatest(*size))

    def each():
        def work(columns: dict[str, list]) -> dict[str, list]:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(columns["x"], columns["y"])]
            return {k: [v for v, yes in zip(columns[k], ok) if yes] for k in ("a", "b")}

        return work

    return common.map_rows(full.select("a", "b", "x", "y"), "a long, b long", each)


def _residual(buckets: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a bucket that are in different groups after the pivots' links."""
    grouped = buckets.where("node <> pivot").select("key", "node").join(groups, "node", "left")
    grouped = grouped.select("key", "node", F.coalesce("component", "node").alias("component"))
    counts = grouped.groupBy("key", "component").agg(F.count("*").alias("n"))
    spans = counts.groupBy("key").agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    open_ = grouped.join(spans, "key").withColumn("few", F.col("component") != F.col("main"))
    block = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    mine = F.xxhash64("node")
    left_blocks, all_blocks = block(F.col("all") - F.col("most")), block(F.col("all"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = open_.where("few").select("key", "node", "component", F.lit(0).alias("side"), F.pmod(mine, left_blocks).cast("int").alias("i"), every(all_blocks).alias("j"))
    right = open_.select("key", "node", "component", F.lit(1).alias("side"), every(left_blocks).alias("i"), F.pmod(mine, all_blocks).cast("int").alias("j"))
    work = left.unionByName(right).join(sets.withColumnRenamed("id", "node"), "node").select("key", "i", "j", "side", "node", "component", "elements")
    work = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return work.mapInArrow(_blocks, "a long, b long").distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (key, i, j): links between its two sides. Holds the sets of one block at a time."""

    def found(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
        out = []
        for at in range(0, len(a), BLOCK):
            for to in range(0, len(b), BLOCK):
                out += between(a[at : at + BLOCK], b[to : to + BLOCK])
        return spanning(out, {x[0]: x[1] for x in a + b})

    def between(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
        if len(a) * len(b) <= 8:
            return [(x[0], y[0]) for x in a for y in b if x[1] != y[1] and linked(x[2], y[2])]
        names, where, count = np.unique(np.concatenate([x[2] for x in a + b]), return_inverse=True, return_counts=True)
        size = np.array([len(x[2]) for x in a + b])
        owner = np.repeat(np.arange(len(size)), size)
        useful = count[where] > 1
        rank = np.cumsum(count > 1) - 1
        column, owner = rank[where[useful]], owner[useful]
        both = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, int((count > 1).sum()), 8192):
            part = (column >= low) & (column < low + 8192)
            m = np.zeros((len(size), 8192), np.float32)
            m[owner[part], column[part] - low] = 1
            both += m[: len(a)] @ m[len(a) :].T
        union = size[: len(a), None] + size[None, len(a) :] - both
        apart = np.array([x[1] for x in a])[:, None] != np.array([x[1] for x in b])[None, :]
        return [(a[i][0], b[j][0]) for i, j in zip(*np.nonzero((DENOMINATOR * both >= NUMERATOR * union) & apart))]

    def spanning(links: list[tuple[int, int]], component: dict[int, int]) -> list[tuple[int, int]]:
        """Of links only those that join what was apart: their number is that of the block's groups, not of its pairs."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for a, b in links:
            p, q = root(component[a]), root(component[b])
            if p != q:
                parent[p] = q
                out.append((a, b))
        return out

    def packed(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], names=["a", "b"])

    current, sides = None, ([], [])
    for batch in batches:
        for key, i, j, side, node, component, elements in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, i, j) != current:
                if links := found(*sides):
                    yield packed(links)
                current, sides = (key, i, j), ([], [])
            sides[side].append((node, component, np.frombuffer(elements, np.uint64)))
    if links := found(*sides):
        yield packed(links)
