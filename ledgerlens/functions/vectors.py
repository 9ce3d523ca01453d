"""Vector signals: cosine similarity in the JVM, and a deterministic embedding for offline use."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length or the lengths differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size)


#: Components up to which a product is written out, so that it is compiled; longer vectors go through Arrow batches.
WRITTEN_OUT = 128


def query_cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a literal query; its norm is taken once. Null where a vector has no length or another size."""
    q = [float(x) for x in query]
    norm = float(np.linalg.norm(q))
    if len(q) <= WRITTEN_OUT:
        part = [F.get(vector, F.lit(i)).cast("double") for i in range(len(q))]
        product = sum([p * F.lit(x) for p, x in zip(part[1:], q[1:])], part[0] * F.lit(q[0]))
        size = F.sqrt(sum([p * p for p in part[1:]], part[0] * part[0])) * F.lit(norm)
        return F.when((F.size(vector) == len(q)) & (size > 0), product / size)

    @F.pandas_udf("double")
    def similarity(vectors: pd.Series) -> pd.Series:
        good = vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
        out = np.full(len(vectors), np.nan)
        if good.any():
            m = np.stack(vectors[good].to_list()).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[good] = m @ np.array(q) / (np.linalg.norm(m, axis=1) * norm)
        return pd.Series(out).where(np.isfinite(out), None)

    return similarity(vector)


def deterministic_embedding(text: Column, size: int = 16, prefix: str = "ledgerlens-embedding") -> Column:
    """A unit vector drawn from SHA-256 of prefix, text and a counter; tombstones and null texts give null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float] | None:
            if t is None:
                return None
            raw = b"".join(hashlib.sha256(f"{prefix}\0{t}\0{i}".encode("utf-8", "surrogatepass")).digest() for i in range(-(-size // 32)))
            v = np.frombuffer(raw[:size], np.uint8) / 127.5 - 1
            n = np.linalg.norm(v)
            return (v / n if n else np.eye(1, size)[0]).astype(np.float32).tolist()

        return texts.map(one)

    return embed(text)
