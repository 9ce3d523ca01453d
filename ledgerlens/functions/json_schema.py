"""JSON schemas compiled to columns: what is wrong with a JSON text, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema types and how a variant's type begins.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def _is(value: Column, kind: str) -> Column:
    name = F.schema_of_variant(value)
    out = F.lit(False)
    for k in KINDS[kind]:
        out = out | name.startswith(k)
    return F.coalesce(out, F.lit(False))


def _rules(value: Column, schema: Mapping[str, Any], path: str) -> list[tuple[Column, str]]:
    """(condition, fault) for a value that is there."""
    out: list[tuple[Column, str]] = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds:
        fits = F.lit(False)
        for k in kinds:
            fits = fits | _is(value, k)
        out.append((~fits, f"type:{path}"))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "enum" in schema:
        out.append((~F.coalesce(text.isin([str(x) for x in schema["enum"]]), F.lit(False)), f"enum:{path}"))
    is_text, is_number = _is(value, "string"), _is(value, "number")
    for key, bad in (("minLength", lambda m: F.length(text) < m), ("maxLength", lambda m: F.length(text) > m), ("pattern", lambda m: ~text.rlike(m))):
        if key in schema:
            out.append((is_text & bad(schema[key]), f"{key}:{path}"))
    for key, bad in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m)):
        if key in schema:
            out.append((is_number & bad(schema[key]), f"{key}:{path}"))
    if schema.get("items", {}).get("type") or "minItems" in schema or "maxItems" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        if inner := schema.get("items", {}).get("type"):
            out.append((F.exists(items, lambda x: ~_is(x, inner)), f"items:{path}"))
        if "minItems" in schema:
            out.append((F.size(items) < schema["minItems"], f"minItems:{path}"))
        if "maxItems" in schema:
            out.append((F.size(items) > schema["maxItems"], f"maxItems:{path}"))
    own = schema.get("properties") or {}
    if own or schema.get("required") or schema.get("additionalProperties") is False:
        is_object = _is(value, "object")
        for name in schema.get("required", []):
            out.append((is_object & F.try_variant_get(value, f"$.{name}", "variant").isNull(), f"required:{path}.{name}"))
        for name, inner in own.items():
            there = F.try_variant_get(value, f"$.{name}", "variant")
            out += [(is_object & there.isNotNull() & bad, fault) for bad, fault in _rules(there, inner, f"{path}.{name}")]
        if schema.get("additionalProperties") is False:
            names = F.json_object_keys(F.to_json(value))
            out.append((is_object & (F.size(F.array_except(names, F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))) > 0), f"additional:{path}"))
    return out


def violations(content: Column, schema: Mapping[str, Any]) -> Column:
    """The faults of a JSON text under a schema, in the order of the schema; ``json`` if it does not parse. Empty: valid.

    Types, required and additional properties, enums, lengths, bounds, patterns and item types are checked.
    """
    return violations_of(F.try_parse_json(content), schema)


def violations_of(value: Column, schema: Mapping[str, Any]) -> Column:
    """``violations`` of a parsed value; null is a text that did not parse."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(fault)) for bad, fault in _rules(value, schema, "$")] or [F.lit(None).cast("string")])
    return F.when(value.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(found))


def checked(rows: DataFrame, column: str, schemas: Mapping[str, Mapping[str, Any]] | Mapping[str, Any], name: str = "faults", by: str | None = None) -> DataFrame:
    """``rows`` with the faults of a JSON column; each text is parsed once. With ``by``, ``schemas`` gives the schema for each
    value of that column, and rows of other values have no faults."""
    parsed = rows.withColumn("__json", F.try_parse_json(column))
    if by is None:
        return parsed.withColumn(name, violations_of(F.col("__json"), schemas)).drop("__json")
    out = F.array().cast("array<string>")
    for value, schema in schemas.items():
        out = F.when(F.col(by) == value, violations_of(F.col("__json"), schema)).otherwise(out)
    return parsed.withColumn(name, out).drop("__json")
