"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, each partition is sorted externally by Spark, and a stream over
the sorted rows compares neighbours byte for byte. The sort key is (first bytes, SHA-256, id), a content order in which
equal texts are adjacent; the id is part of the splitters, so a group of copies that holds a third of all rows is spread
over many partitions. Runs that cross a border are joined afterwards from one summary row a partition.

Defined cases: null text counts as empty and empty texts are equal to each other; rows that repeat an id and a text are
one more member each; null ids sort before all others and lose to any id; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common

#: Bytes of the text that lead the sort key, and sampled rows a partition for the splitters.
PREFIX, SAMPLES = 32, 64
LOWEST = -(1 << 63)


def _prepare(columns: dict[str, list]) -> dict[str, list]:
    norm = [(t or "").encode("utf-8", "surrogatepass").lower() for t in columns["text"]]
    return {"id": columns["id"], "norm": norm, "head": [x[:PREFIX] for x in norm], "sha": [hashlib.sha256(x).digest() for x in norm]}


def content_sort_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Per row of ``df``: id, keep_id, group_size, kept, text_sha256 of texts that are equal but for the case of A-Z.

    ``keep``: "smallest" or "largest" id of a group stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, parts = df.sparkSession, common.partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.count()
    every = max(1, total // (SAMPLES * parts))
    sampled = rows.where(F.rand(17) * every < 1)  # sets borders only; equal ids and equal rows are sampled like others
    keys = common.map_rows(sampled, "id long, norm binary, head binary, sha binary", lambda: _prepare).select("head", "sha", "id").collect()
    keys = sorted((bytes(k["head"]), bytes(k["sha"]), LOWEST if k["id"] is None else k["id"]) for k in keys)
    splitters = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def routed():
        def work(columns: dict[str, list]) -> dict[str, list]:
            out = _prepare(columns)
            out["part"] = [bisect.bisect_right(splitters, (h, s, LOWEST if i is None else i)) for h, s, i in zip(out["head"], out["sha"], out["id"])]
            return out

        return work

    ranged = common.map_rows(rows, "id long, norm binary, head binary, sha binary, part int", routed).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "head", "sha", F.col("id").asc_nulls_first())
    best = max if keep == "largest" else min

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal neighbours. A run's ids are held, 8 bytes a row, never its texts."""
        schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("edge", pa.int32())])
        last, sha, ids, part, run, ready = None, b"", [], -1, 0, []

        def close(edge: int) -> None:
            known = [i for i in ids if i is not None]
            ready.append((ids, part, run, best(known) if known else None, sha.hex(), edge))

        def flush() -> pa.RecordBatch:
            n = [len(x[0]) for x in ready]
            arrays = [[i for x in ready for i in x[0]]] + [np.repeat([x[k] for x in ready], n) for k in (1, 2)]
            arrays += [[v for x, k in zip(ready, n) for v in [x[3]] * k], np.repeat(n, n), [v for x, k in zip(ready, n) for v in [x[4]] * k], np.repeat([x[5] for x in ready], n)]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

        for batch in batches:
            for i, norm, digest, to in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if part == to and digest == sha and norm == last:
                    ids.append(i)
                    continue
                if ids:
                    close(int(run == 0) | 2 * int(part != to))
                run = run + 1 if part == to else 0
                last, sha, ids, part = norm, digest, [i], to
            if len(ready) > 2000:
                yield flush()
        if ids:
            close(int(run == 0) | 2)
        if ready:
            yield flush()

    runs = common.materialise(ranged.mapInArrow(neighbours, "id long, part int, run long, keep_id long, size long, sha string, edge int"), "runs")
    # One or two rows a partition: the first and the last run of each. Runs of one text that meet at borders become one group.
    edges = runs.where("edge > 0").groupBy("part", "run").agg(F.first("sha").alias("sha"), F.first("keep_id").alias("keep_id"), F.first("size").alias("size")).orderBy("part", "run").collect()
    joined: list[list] = []
    for e in edges:
        if joined and joined[-1][-1]["sha"] == e["sha"]:
            joined[-1].append(e)
        else:
            joined.append([e])
    fixes = []
    for group in (g for g in joined if len(g) > 1):
        known = [e["keep_id"] for e in group if e["keep_id"] is not None]
        fixes += [(e["part"], e["run"], best(known) if known else None, sum(x["size"] for x in group)) for e in group]
    out = runs
    if fixes:
        fixed = spark.createDataFrame(fixes, "part int, run long, keep_fixed long, size_fixed long")
        out = runs.join(F.broadcast(fixed), ["part", "run"], "left").withColumn("keep_id", F.when(F.col("size_fixed").isNotNull(), F.col("keep_fixed")).otherwise(F.col("keep_id"))).withColumn("size", F.coalesce("size_fixed", "size"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
