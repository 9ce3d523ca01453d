"""Cuts under budgets: prefixes by tokens or bytes, and greedy packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_prefix(rows: DataFrame, cost: Column, budget: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The longest prefix, for each group of ``by``, whose costs fit the budget."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(running)).where(F.col("used") <= budget)


def byte_page(rows: DataFrame, columns: Sequence[str], budget: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The longest prefix whose compact JSON fits ``budget`` bytes, with ``used``; a comma parts the items."""
    size = F.octet_length(F.to_json(F.struct(*columns))) + 1
    return packed_prefix(rows, size, budget, order, by)


def paged(rows: DataFrame, columns: Sequence[str], budget: int, order: Sequence[Column], by: Sequence[str] = (), most_item: int | None = None) -> DataFrame:
    """All rows with their ``place``: ``in`` the page, ``later``, or ``oversize`` if an item alone is over its bound."""
    size = F.octet_length(F.to_json(F.struct(*columns))) + 1
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(size > (budget if most_item is None else most_item), "oversize").when(F.sum(size).over(running) <= budget, "in").otherwise("later")
    return rows.withColumn("place", place)


def checked_page(rows: DataFrame, columns: Sequence[str], budget: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``byte_page``, with an error for an item that no page can hold."""
    if rows.where(F.octet_length(F.to_json(F.struct(*columns))) + 1 > budget).head(1):
        raise ValueError(f"an item is larger than a page of {budget} bytes")
    return byte_page(rows, columns, budget, order, by)


def token_batches(rows: DataFrame, cost: str, budget: int, most: int, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows with ``batch``: runs in order, per group, of at most ``most`` rows that cost at most ``budget`` together; a row
    that is over the budget alone is a batch of its own. Groups are streamed, never held."""
    schema = rows.schema.add("batch", "long") if "batch" not in rows.columns else rows.schema

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, n, used = None, 0, 0, 0
        for part in parts:
            out = []
            for key, c in zip(part[list(by)].itertuples(index=False, name=None), part[cost]):
                if key != group:
                    group, batch, n, used = key, 0, 0, 0
                elif n == most or used + c > budget:
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + c
                out.append(batch)
            yield part.assign(batch=out)[[f.name for f in schema]]

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(deal, schema)


def greedy_pack(rows: DataFrame, cost: str, budget: int, order: str, by: str) -> DataFrame:
    """For each group: rows in order, those that do not fit the rest are skipped and later ones tried. Groups are bounded
    by the caller's candidate caps."""
    schema = rows.schema

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        left, keep = budget, []
        for c in group[cost]:
            fits = c <= left
            left -= c if fits else 0
            keep.append(bool(fits))
        return group[keep]

    return rows.groupBy(by).applyInPandas(pack, schema)


def carried_budgets(shares: Sequence[tuple[str, float]], total: int) -> Iterator[tuple[str, int]]:
    """Section budgets in order; the caller sends back what a section left unused."""
    spare = 0
    for name, share in shares:
        used = yield name, int(total * share) + spare
        spare = int(total * share) + spare - (used or 0)
