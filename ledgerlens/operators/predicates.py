"""Typed predicates on declared fields. A missing value fails every operator but ``exists``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
MOST_VALUES = 100


class IllegalPredicate(ValueError):
    """A predicate that the declared type of its field does not allow."""


def check(kind: str, op: str, value: Any) -> None:
    """Legality by declared type: ranges need numbers or times, array operators need arrays."""
    if op in RANGES and kind not in ("number", "integer", "datetime"):
        raise IllegalPredicate(f"{op} needs a number, integer or datetime field")
    if op in ("contains_any", "contains_all") and not kind.endswith("[]"):
        raise IllegalPredicate(f"{op} needs an array field")
    if op == "in" and not 0 < len(value) <= MOST_VALUES:
        raise IllegalPredicate(f"in takes 1 to {MOST_VALUES} values")
    if op != "exists" and kind in ("number", "integer") and any(isinstance(v, bool) for v in (value if isinstance(value, (list, tuple)) else [value])):
        raise IllegalPredicate("a boolean is no number")


def legal(conditions: Mapping[str, Mapping[str, Any]], declared: Mapping[int, Mapping[str, Mapping[str, Any]]], order: Sequence[str] = (), project: Sequence[str] = ()) -> dict[str, str]:
    """The kinds of the fields that a query uses, or an error.

    ``declared`` gives the fields of every version in scope: a field must be declared in each, with the same type and
    permissions. Filters, orders and projections each need their permission; a field of an optional annotation takes
    ``exists`` only.
    """
    kinds = {}
    for name in {*conditions, *order, *project}:
        found = [fields.get(name) for fields in declared.values()]
        if not found or any(f is None for f in found):
            raise IllegalPredicate(f"{name} is not declared in every version")
        if len({(f["type"], f.get("filter", False), f.get("sort", False), f.get("project", True), f.get("optional", False)) for f in found}) > 1:
            raise IllegalPredicate(f"{name} differs between versions")
        f = found[0]
        if name in conditions and not f.get("filter"):
            raise IllegalPredicate(f"{name} is not filterable")
        if name in order and (not f.get("sort") or f["type"].endswith("[]")):
            raise IllegalPredicate(f"{name} is not sortable")
        if name in project and not f.get("project", True):
            raise IllegalPredicate(f"{name} is not projected")
        for op, value in conditions.get(name, {}).items():
            if f.get("optional") and op != "exists":
                raise IllegalPredicate(f"{name} comes from an optional annotation: only exists")
            check(f["type"], op, value)
        kinds[name] = f["type"]
    return kinds


def compare(column: Column, op: str, value: Any) -> Column:
    """One operator on a column; null is false."""
    if op == "exists":
        return column.isNotNull() if value else column.isNull()
    if op == "eq":
        made = column == (F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value))
    elif op == "in":
        made = column.isin(list(value))
    elif op == "contains_any":
        made = F.arrays_overlap(column, F.array(*map(F.lit, value)))
    elif op == "contains_all":
        made = F.size(F.array_except(F.array(*map(F.lit, value)), column)) == 0
    elif op in RANGES:
        made = RANGES[op](column, F.lit(value))
    else:
        raise IllegalPredicate(f"unknown operator {op}")
    return F.coalesce(made, F.lit(False))


def where(rows: DataFrame, conditions: Mapping[str, Mapping[str, Any]], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Rows for which all operators on all fields hold."""
    parts = []
    for field, ops in conditions.items():
        for op, value in ops.items():
            if kinds is not None:
                check(kinds[field], op, value)
            parts.append(compare(F.col(field), op, value))
    return rows.where(reduce(Column.__and__, parts)) if parts else rows


def versioned(paths: Mapping[int, str], version: str = "version", content: str = "content", kind: str = "string") -> Column:
    """A declared field whose JSON path depends on the version of the row's collection; undeclared versions give null."""
    out = F.lit(None).cast(kind)
    for v, path in paths.items():
        out = F.when(F.col(version) == v, F.expr(f"try_cast(get_json_object({content}, '{path}') AS {kind})")).otherwise(out)
    return out


def superseded(columns: Sequence[str]) -> Column:
    """The newest of several annotations that is there, newest first."""
    return F.coalesce(*columns)
