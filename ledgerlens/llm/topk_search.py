"""Exact top-k search by a three-phase uniform threshold.

The components of a vector are dealt into ``LISTS`` runs; each run's partial inner products form one score list, and a
vector's score is the sum over the lists. For each block of queries:

1. every task gathers local scores: of about one row in ``LEADING`` (by a hash of the id) it sends its k best whole scores
   per query. The k-th best gathered score of a query is a safe cutoff, because k rows reach it;
2. the cutoffs are broadcast. A row can reach a cutoff only if at least one of its lists reaches the cutoff divided by the
   number of lists. A list's part is at most the product of the norms of its run in row and query, so rows whose runs are
   all too short for every query are skipped without a product. Entries that reach the uniform threshold are collected,
   and those whose known parts plus that threshold for each unknown part stay below the cutoff are pruned;
3. what remains is resolved exactly, and each task sends at most its k best per query to the final ranking.

The sample of phase 1 only sets cutoffs: a worse cutoff costs time, no answer is lost. All rows take part in phases 2 and
3. Queries are numbered in a written table and go in blocks of about ``QUERY_BYTES``, so a broadcast has a fixed size, and
a block is one pass over the rows. On vectors without long-tailed norms few rows can be skipped: then the thresholds only
bound what tasks keep and send.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part; vectors are compared
with queries of the same length only; a query's own id is no candidate, in repeated rows too, and repeated query rows are
answered once a row; ties go to the smaller id; fewer than k candidates give them all; null ids take no part; scores
beyond a long are clamped before they are ranked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import common

LISTS, LEADING, QUERY_BYTES = 4, 16, 32 << 20
#: Rows and queries that are scored at once, and scored pairs that a task holds before it keeps the best only.
ROWS, QUERIES, PAIRS = 256, 2048, 1 << 20
LONG = (1 << 63) - 1


def quantised(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, integer components and places of the valid rows of a batch (id, vector), by vector length."""
    ids, vectors = batch.column(0), batch.column(1)
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid &= bad[offsets[1:]] == bad[offsets[:-1]]
    if not valid.any():
        return
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[valid]):
        rows = np.flatnonzero(valid & (sizes == size))
        yield keys[rows], whole(values[offsets[:-1][rows][:, None] + np.arange(size)], scale), rows


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < 2**20:
        return scaled  # float64 holds every product and sum of up to 8192 components exactly
    return np.array([[int(np.floor(x)) * scale if abs(x) > 1e300 else int(np.floor(x * scale)) for x in row] for row in values], object)


def partial_scores(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """One matrix (query, row) for each list."""
    if queries.dtype == object or rows.dtype == object or queries.shape[1] > 8192:
        queries, rows = (np.array([[int(v) for v in r] for r in x], object) for x in (queries, rows))
    cuts = np.array_split(np.arange(queries.shape[1]), min(LISTS, queries.shape[1]))
    return [queries[:, c] @ rows[:, c].T for c in cuts]


class Best:
    """The k best (score, row) of every query, ties to the smaller id; holds about ``PAIRS`` pairs."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -LONG, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, PAIRS

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floor[query]
        self.parts.append((query[good], ids[good], score[good]))
        self.held += int(good.sum())
        if self.held > self.most:
            query, _, score = self.cut()
            full = np.flatnonzero(np.bincount(query, minlength=len(self.floor)) >= self.k)
            self.floor[full] = score[np.searchsorted(query, full, "right") - 1]
            self.most = max(PAIRS, 2 * self.held)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best, by query and from high to low."""
        query, ids, score = (np.concatenate([np.empty(0, np.int64), *(p[c] for p in self.parts)]) for c in range(3))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.parts = [(query[keep], ids[keep], score[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def clamped(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(-LONG, min(LONG, int(s))) for s in scores], np.int64)
    return scores.astype(np.int64)


def exact_top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row where ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    asked = common.materialise(rows.where("q AND id IS NOT NULL AND size(v) > 0").select("id", "v", F.monotonically_increasing_id().alias("slot")), "queries")
    count, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-count * 8 * (longest or 0) // QUERY_BYTES)
    answers = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("slot"), F.lit(blocks)) == block)
        found = _block(spark, rows.select("id", "v"), own, k, scale)
        if found is not None:
            answers = found if answers is None else answers.unionAll(found)
    if answers is None:
        answers = spark.createDataFrame([], "slot long, query_id long, vec_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def norms(matrix: np.ndarray) -> np.ndarray:
    """Norm of each list's run, rounded up: (row, list)."""
    cuts = np.array_split(np.arange(matrix.shape[1]), min(LISTS, matrix.shape[1]))
    floats = matrix.astype(np.float64)
    return np.stack([np.sqrt((floats[:, c] ** 2).sum(1)) for c in cuts], 1) * (1 + 1e-9)


def needed_lengths(queries: np.ndarray, cut: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each list the norm from which a run of a row can reach the threshold of one of the queries at least."""
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where((cut > 0)[:, None], cut[:, None] / min(LISTS, queries.shape[1]) / norms(queries), 0.0)
    return np.where(free[:, None], 0.0, np.nan_to_num(needed, nan=0.0, posinf=np.inf)).min(0)


def _block(spark, rows: DataFrame, own: DataFrame, k: int, scale: int) -> DataFrame | None:
    by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    slots: list[int] = []
    table = own.toArrow()
    for batch in table.to_batches():
        for ids, matrix, at in quantised(batch, scale):
            for i, row, slot in zip(ids, matrix, batch.column(2).to_numpy()[at].tolist()):
                by_size.setdefault(len(row), []).append((len(slots), int(i), row))
                slots.append(slot)
    if not slots:
        return None
    numbers = np.array(slots, np.int64)
    sent = spark.sparkContext.broadcast({n: [(np.array([x[0] for x in q[at : at + QUERIES]]), np.array([x[1] for x in q[at : at + QUERIES]]), np.stack([x[2] for x in q[at : at + QUERIES]])) for at in range(0, len(q), QUERIES)] for n, q in by_size.items()})

    def chunks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for ids, matrix, _ in quantised(pa.RecordBatch.from_arrays([x.slice(at, ROWS) if not isinstance(x, pa.ListArray) else pa.concat_arrays([x.slice(at, ROWS)]) for x in batch.columns], names=batch.schema.names), scale):
                    for part in sent.value.get(matrix.shape[1], ()):
                        yield ids, matrix, *part

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: per query, the k best whole scores among this task's leading rows."""
        best = Best(len(numbers), k)
        for ids, matrix, slot, query, queries in chunks(batches):
            total = sum(partial_scores(queries, matrix))
            q, r = np.nonzero(query[:, None] != ids[None, :])
            best.add(slot[q], ids[r], clamped(total[q, r]))
        slot, _, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(score, pa.int64())], names=["slot", "score"])

    leading = rows.where(F.pmod(F.xxhash64("id", F.lit("leading")), F.lit(LEADING)) == 0)
    ranked = Window.partitionBy("slot").orderBy(F.desc("score"))
    gathered = leading.mapInArrow(gather, "slot int, score long").withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k)
    cutoffs = np.zeros(len(numbers), np.int64)
    known = np.zeros(len(numbers), bool)
    for r in gathered.select("slot", "score").toLocalIterator():
        cutoffs[r["slot"]], known[r["slot"]] = r["score"], r["score"] > -LONG
    cuts = spark.sparkContext.broadcast((cutoffs, known))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: collect entries above the uniform threshold, prune by bounds, resolve the rest exactly."""
        best = Best(len(numbers), k)
        all_cuts, all_known = cuts.value
        lengths: dict[int, np.ndarray] = {}
        for ids, matrix, slot, query, queries in chunks(batches):
            cut, free = all_cuts[slot], ~all_known[slot]
            m = min(LISTS, matrix.shape[1])
            if int(slot[0]) not in lengths:
                lengths[int(slot[0])] = needed_lengths(queries, cut, free)
            long = (norms(matrix) >= lengths[int(slot[0])]).any(1)
            if not long.any():
                continue
            ids, matrix = ids[long], matrix[long]
            parts = partial_scores(queries, matrix)
            limit = np.array([int(c) for c in cut], object)[:, None] if parts[0].dtype == object else cut.astype(np.float64)[:, None]
            reach = [(m * p >= limit).astype(bool) for p in parts]
            bound = sum(np.where(r, m * p, limit) for r, p in zip(reach, parts))
            open_ = np.logical_or.reduce(reach) & (bound >= m * limit).astype(bool) | free[:, None]
            q, r = np.nonzero(open_ & (query[:, None] != ids[None, :]))
            if len(q):
                score = clamped(sum(p[q, r] for p in parts))
                good = free[q] | (score >= cut[q])
                best.add(slot[q[good]], ids[r[good]], score[good])
        slot, ids, score = best.cut()
        owner = np.zeros(len(numbers), np.int64)
        for parts in sent.value.values():
            for at, query, _ in parts:
                owner[at] = query
        yield pa.RecordBatch.from_arrays([pa.array(numbers[slot]), pa.array(owner[slot]), pa.array(ids.astype(np.int64)), pa.array(score)], names=["slot", "query_id", "vec_id", "score"])

    return rows.mapInArrow(resolve, "slot long, query_id long, vec_id long, score long")
