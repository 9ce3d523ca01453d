"""What the operators share: shared-folder tables, Arrow row mapping and a bounded membership filter."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_folder, spread

#: Rows of an Arrow batch that go to Python: long texts make a larger batch too large for a small executor.
BATCH_ROWS = 500
#: Bits of the membership filter (2 MB): it is a prefilter of fixed size; an exact join follows.
FILTER_BITS = 1 << 24


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose last reader is done: what is computed later must not depend on them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.__dict__["written_to"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def map_rows(df: DataFrame, schema: str, each: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Run ``each()(columns)`` on every Arrow batch; ``each`` is called once a task, for state such as automata and caches.

    Batches are cut to ``BATCH_ROWS`` rows, so memory is bounded by the longest texts and not by the partition.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return spread(df).mapInArrow(run, target)


def keep_likely(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys``: no false drop, few false keeps, no shuffle of ``df``.

    The filter has ``FILTER_BITS`` bits whatever the input, so what is sent has a fixed size. An exact join must follow.
    """
    position = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    rows = keys.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        at = (row["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(bits)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            at = batch.column(len(names)).to_numpy(zero_copy_only=False) - 1
            mask = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(mask.astype(bool))).select(range(len(names)))

    return df.select(*names, position.alias("__position")).mapInArrow(run, df.schema)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each run of ``size`` neighbours, by doubling: about 2 log2(size) passes over the array."""
    with np.errstate(over="ignore"):
        length, have, done, out = 1, hashes, 0, None
        while True:
            if size & length:
                if out is None:
                    out, done = have, length
                else:
                    n = len(hashes) - done - length + 1
                    out, done = mix(out[:n] * MULTIPLIER + have[done : done + n]), done + length
            if length * 2 > size:
                return out
            have = mix(have[:-length] * MULTIPLIER + have[length:])
            length *= 2


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Bytes of a text that are hashed at once, to the end of a word.
PIECE = 1 << 20
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SPACE = re.compile(rb"[\x20\x09-\x0d]")
with np.errstate(over="ignore"):
    BYTES = mix(mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER))
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, without a Python object a word.

    A word's hash is a polynomial of its bytes modulo 2^64, from differences of sums over the whole text, scrambled.
    """
    out, at = [], 0
    while at < len(text):
        found = SPACE.search(text, at + PIECE)
        stop = found.start() if found else len(text)
        out.append(_hashes_of_piece(np.frombuffer(text, np.uint8, stop - at, at)))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes_of_piece(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    with np.errstate(over="ignore"):
        if len(_powers[0]) < n:
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (BASE, INVERSE)]
        edges = np.diff(np.concatenate([[False], ~SPACES[raw], [False]]).view(np.int8))
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * _powers[1][:n])])
        return mix((sums[stop] - sums[start]) * _powers[0][start] + (stop - start).astype(np.uint64) * MULTIPLIER)
