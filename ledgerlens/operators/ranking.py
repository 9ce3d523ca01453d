"""The rank language: expressions over signals, compiled to columns; scores, fusion and orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DEPTH, MOST_NODES = 5, 16
#: Rank defaults by search mode.
DECAY_DAY = {"decay": {"of": {"age_hours": "last_accessed"}, "midpoint": 24, "exponent": 1}}
DEFAULTS: dict[str, dict[str, Any]] = {
    "hybrid": {"sum": [{"normalize": {"max": ["similarity", "text_match"]}}, DECAY_DAY]},
    "vector": {"sum": [{"normalize": "similarity"}, DECAY_DAY]},
    "text": {"sum": [{"normalize": "text_match"}, DECAY_DAY]},
    "recent": {"decay": {"of": {"age_hours": "occurred_at"}, "midpoint": 24, "exponent": 1}},
}


class IllegalRank(ValueError):
    """A rank expression that is too large, or of unknown shape."""


def _size(node: Any, depth: int = 1) -> int:
    if depth > MOST_DEPTH:
        raise IllegalRank(f"deeper than {MOST_DEPTH}")
    if isinstance(node, (str, int, float)):
        return 1
    ((kind, body),) = node.items()
    if kind in ("sum", "max"):
        return 1 + sum(_size(x, depth + 1) for x in body)
    if kind == "normalize":
        return 1 + _size(body, depth + 1)
    if kind in ("saturate", "decay", "product"):
        return 1 + _size(body["of"], depth + 1)
    return 1


def check_rank(node: Any, signals: set[str] | None = None, scores: set[str] | None = None) -> None:
    """An error for a rank that is too large, or uses a search signal that its mode does not have or an unknown score."""
    if _size(node) > MOST_NODES:
        raise IllegalRank(f"more than {MOST_NODES} nodes")
    if isinstance(node, str):
        if signals is not None and node in ("similarity", "text_match") and node not in signals:
            raise IllegalRank(f"{node} is not known in this mode")
        return
    if isinstance(node, (int, float)):
        return
    ((kind, body),) = node.items()
    if kind == "score":
        if scores is not None and body not in scores:
            raise IllegalRank(f"unknown score {body}")
    elif kind in ("sum", "max"):
        for x in body:
            check_rank(x, signals, scores)
    elif kind == "normalize":
        check_rank(body, signals, scores)
    elif kind in ("saturate", "decay", "product"):
        check_rank(body["of"], signals, scores)
    elif kind not in ("const", "age_hours"):
        raise IllegalRank(f"unknown rank {kind}")


def finite(score: Column) -> Column:
    """``score``, with an error for rows where it is not a finite number."""
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a rank is not finite")).cast("double")).otherwise(score)


def compile_rank(node: Any, now: Column | None = None, pool: Sequence[str] = ()) -> Column:
    """A column for a rank expression. ``pool``: columns that part the rows into candidate pools, for ``normalize``."""
    if _size(node) > MOST_NODES:
        raise IllegalRank(f"more than {MOST_NODES} nodes")
    return _compiled(node, now, pool)


def _compiled(node: Any, now: Column | None, pool: Sequence[str]) -> Column:
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    if isinstance(node, str):
        return F.coalesce(F.col(node).cast("double"), F.lit(0.0))
    ((kind, body),) = node.items()
    sub = lambda x: _compiled(x, now, pool)
    if kind == "const":
        return F.lit(float(body))
    if kind == "score":
        x = F.col("scores")[body].cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    if kind == "age_hours":
        return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col(body), now) / F.lit(3.6e9))
    if kind in ("sum", "max"):
        parts = [sub(x) for x in body]
        if len(parts) == 1:
            return parts[0]
        return F.greatest(*parts) if kind == "max" else sum(parts[1:], parts[0])
    if kind == "product":
        return F.lit(float(body["factor"])) * sub(body["of"])
    if kind in ("saturate", "decay"):
        x, m, e = F.greatest(F.lit(0.0), sub(body["of"])), float(body["midpoint"]), float(body.get("exponent", 1))
        share = F.pow(x, F.lit(e)), F.lit(m**e)
        return share[0] / (share[0] + share[1]) if kind == "saturate" else 1 / (1 + share[0] / share[1])
    if kind == "normalize":
        x, own = sub(body), Window.partitionBy(*pool)
        low, high = F.min(x).over(own), F.max(x).over(own)
        return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    raise IllegalRank(f"unknown rank {kind}")


def public_score(score: str = "rank_score", pool: Sequence[str] = ()) -> Column:
    """Min-max over the whole ranked pool, before any cut; equal scores are 1."""
    own = Window.partitionBy(*pool)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)


def scored_publicly(rows: DataFrame, score: str = "rank_score", pool: Sequence[str] = ()) -> DataFrame:
    """``public_score`` for pools without a cap: bounds are aggregated and joined, so no pool meets in one task."""
    bounds = rows.groupBy(*pool).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    both = rows.join(bounds, list(pool)) if pool else rows.crossJoin(F.broadcast(bounds))  # one row
    low, high = F.col("__low"), F.col("__high")
    return both.withColumn("score", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)).drop("__low", "__high")


def by_relevance(score: str = "rank_score", time: str = "occurred_at", seq: str = "seq", identity: str = "id") -> list[Column]:
    return [F.desc(score), F.desc(time), F.desc(seq), F.col(identity).cast("string").asc()]


def by_fields(order: Sequence[tuple[str, str]], seq: str = "seq", identity: str = "id") -> list[Column]:
    """Per-field directions with nulls last in both; ties by seq, then id."""
    return [F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last() for f, d in order] + [F.col(seq).asc(), F.col(identity).cast("string").asc()]


def numbered(rows: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows in order, numbered from 1: a bounded top-k before the single-partition window."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(sources: Mapping[str, tuple[DataFrame, float]], constant: float = 60.0, identity: str = "id") -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (id, rank): (id, fused)."""
    parts = [rows.select(identity, (F.lit(float(weight)) / (F.lit(float(constant)) + F.col("rank"))).alias("share")) for rows, weight in sources.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(identity).agg(F.sum("share").alias("fused"))


def round_robin(channels: Sequence[DataFrame], cap: int, identity: str = "id") -> DataFrame:
    """Channels of (id, rank) dealt one by one, each id once, the first ``cap``: (id, place)."""
    out = None
    for n, rows in enumerate(channels):
        part = rows.select(identity, F.struct(F.col("rank").alias("at"), F.lit(n).alias("channel")).alias("turn"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(identity).agg(F.min("turn").alias("turn")).orderBy("turn", identity).limit(cap)
    return first.select(identity, F.row_number().over(Window.orderBy("turn", identity)).alias("place"))
