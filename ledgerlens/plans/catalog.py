"""The declarative catalog: versioned collections, fields, processors, derivations and views, checked at load."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

KINDS = ("string", "number", "integer", "boolean", "datetime")
CONTRACT = ("name", "version", "mode", "schema", "text_projection", "fields", "required_processors")
MODES = ("event", "keyed", "mixed")


class CatalogError(ValueError):
    """A definition that does not hold; ``code`` is stable."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def digest(definition: Mapping[str, Any]) -> str:
    """SHA-256 of sorted, compact JSON without non-finite numbers."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def contract_hash(collection: Mapping[str, Any]) -> str:
    return digest({k: collection.get(k) for k in CONTRACT})


def read_yaml(text: str) -> Any:
    """YAML with duplicate keys rejected."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: Any, node: Any, deep: bool = False) -> dict:
        seen = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(seen) != len(set(map(str, seen))):
            raise CatalogError("duplicate_key", f"line {node.start_mark.line + 1}")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(seen, node.value)}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return yaml.load(text, Loader)


def at_path(schema: Mapping[str, Any], path: str) -> Mapping[str, Any] | None:
    """The schema of a dotted path."""
    for part in path.split("."):
        schema = (schema.get("properties") or {}).get(part)
        if schema is None:
            return None
    return schema


def kind_of(schema: Mapping[str, Any]) -> str | None:
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None)
    if kind == "array":
        inner = kind_of(schema.get("items") or {})
        return f"{inner}[]" if inner else None
    return "datetime" if kind == "string" and schema.get("format") == "date-time" else kind


@dataclass
class Catalog:
    """Definitions by family and name@version."""

    families: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Catalog:
        made = cls()
        for family, items in (read_yaml(text) or {}).items():
            for item in items:
                key = f"{item['name']}@{item.get('version', 1)}"
                if key in made.families.setdefault(family, {}):
                    raise CatalogError("duplicate_definition", key)
                made.families[family][key] = {"version": 1, **item}
        made.check()
        return made

    @classmethod
    def load_folder(cls, folder: str) -> Catalog:
        """The definitions of all YAML files of a folder, in the order of their paths, as one catalog."""
        from pathlib import Path

        made = cls()
        for path in sorted(Path(folder).rglob("*.y*ml")):
            for family, items in (read_yaml(path.read_text()) or {}).items():
                for item in items:
                    key = f"{item['name']}@{item.get('version', 1)}"
                    if key in made.families.setdefault(family, {}):
                        raise CatalogError("duplicate_definition", f"{path.name}: {key}")
                    made.families[family][key] = {"version": 1, **item}
        made.check()
        return made

    def get(self, family: str, name: str) -> dict[str, Any]:
        """By name@version, or the active version of a name."""
        own = self.families.get(family, {})
        if "@" in name:
            if name not in own:
                raise CatalogError("unknown_definition", f"{family} {name}")
            return own[name]
        versions = [d for d in own.values() if d["name"] == name]
        active = [d for d in versions if d.get("active")] or sorted(versions, key=lambda d: d["version"])[-1:]
        if not active:
            raise CatalogError("unknown_definition", f"{family} {name}")
        return active[-1]

    def check(self) -> None:
        for c in self.families.get("collections", {}).values():
            self._collection(c)
        names = [s for p in self.families.get("processors", {}).values() for s in p.get("scores", [])]
        if len(names) != len(set(names)):
            raise CatalogError("score_not_unique", str(names))
        self._supersession()
        self._acyclic()
        for v in self.families.get("views", {}).values():
            self._view(v)
        from ledgerlens.plans import checks

        checks.check(self)

    def _collection(self, c: Mapping[str, Any]) -> None:
        schema = c.get("schema") or {}
        if c.get("mode", "event") not in MODES:
            raise CatalogError("unknown_mode", str(c.get("mode")))
        text = (schema.get("properties") or {}).get("text") or {}
        if schema.get("type") != "object" or text.get("type") != "string" or "text" not in schema.get("required", []):
            raise CatalogError("text_required", c["name"])
        for ref in re.findall(r"\{\{\s*([\w.]+)\s*\}\}", c.get("text_projection") or ""):
            if at_path(schema, ref.removeprefix("content.")) is None:
                raise CatalogError("projection_unknown", ref)
        for name, f in (c.get("fields") or {}).items():
            if f.get("annotation"):
                continue  # checked against the processor's schema
            found = at_path(schema, f["path"])
            if found is None:
                raise CatalogError("field_path_unknown", f"{name}: {f['path']}")
            if kind_of(found) != f["type"] and not (f["type"] == "number" and kind_of(found) == "integer"):
                raise CatalogError("field_type_differs", f"{name}: {f['type']} is {kind_of(found)}")
            if f["type"].endswith("[]") and f.get("sort"):
                raise CatalogError("array_not_sortable", name)

    def _supersession(self) -> None:
        chain = {p["name"]: p["supersedes"] for p in self.families.get("processors", {}).values() if p.get("supersedes")}
        known = {p["name"] for p in self.families.get("processors", {}).values()}
        if missing := set(chain.values()) - known:
            raise CatalogError("supersedes_unknown", str(sorted(missing)))
        if len(set(chain.values())) < len(chain):
            raise CatalogError("supersession_not_linear", str(chain))
        self._order({a: {b} for a, b in chain.items()}, "supersession_cycle")

    def _acyclic(self) -> None:
        """Automatic derivations must not feed each other in a circle, unless they ignore their own outputs."""
        derivations = self.families.get("derivations", {}).values()
        writes = {d["name"]: d.get("target") for d in derivations}
        reads = {d["name"]: set(d.get("sources", [])) for d in derivations}
        own = {d["name"] for d in derivations if d.get("ignore_own_outputs")}
        self._order({a: {b for b, t in writes.items() if t in reads[a] and not (a == b and a in own)} for a in writes}, "derivation_cycle")

    @staticmethod
    def _order(graph: Mapping[str, set[str]], code: str) -> list[str]:
        try:
            return list(TopologicalSorter(graph).static_order())
        except CycleError as e:
            raise CatalogError(code, str(e.args[1])) from None

    def _view(self, view: Mapping[str, Any]) -> None:
        declared = set(view.get("parameters") or {})
        used = set(re.findall(r"\{\{\s*params\.(\w+)\s*\}\}", json.dumps(view.get("query", {}))))
        if used - declared:
            raise CatalogError("parameter_unknown", str(sorted(used - declared)))

    def query_of(self, view: str, parameters: Mapping[str, Any]) -> Any:
        """The query of a named view with its parameters put in."""
        v = self.get("views", view)
        checked = {}
        for name, rule in (v.get("parameters") or {}).items():
            value = parameters.get(name, rule.get("default"))
            if value is None:
                raise CatalogError("parameter_missing", name)
            checked[name] = parameter(name, rule, value)
        if unknown := set(parameters) - set(checked):
            raise CatalogError("parameter_unknown", str(sorted(unknown)))
        return filled(v["query"], {"params": checked})


def parameter(name: str, rule: Mapping[str, Any], value: Any) -> Any:
    """A parameter that fits its rule."""
    kind = rule["type"]
    fits = {"string": str, "datetime": str, "number": (int, float), "integer": int, "boolean": bool, "string_array": list}[kind]
    if not isinstance(value, fits) or isinstance(value, bool) and kind != "boolean" or isinstance(value, float) and not math.isfinite(value):
        raise CatalogError("parameter_type", f"{name} is {kind}")
    if "enum" in rule and value not in rule["enum"]:
        raise CatalogError("parameter_enum", name)
    low, high = rule.get("min"), rule.get("max")
    size = len(value) if isinstance(value, (str, list)) else value
    if low is not None and size < low or high is not None and size > high:
        raise CatalogError("parameter_range", name)
    return value


def filled(node: Any, values: Mapping[str, Any]) -> Any:
    """Templates without expressions: a reference alone keeps its type, others become text."""
    if isinstance(node, dict):
        return {k: filled(v, values) for k, v in node.items()}
    if isinstance(node, list):
        return [filled(v, values) for v in node]
    if not isinstance(node, str):
        return node

    def look(path: str) -> Any:
        here: Any = values
        for part in path.split("."):
            if not isinstance(here, Mapping) or part not in here:
                raise CatalogError("reference_unknown", path)
            here = here[part]
        return here

    whole = re.fullmatch(r"\{\{\s*([\w.]+)\s*\}\}", node)
    return look(whole[1]) if whole else re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: str(look(m[1])), node)


def verdict(old: Mapping[str, Any], new: Mapping[str, Any]) -> str:
    """How a changed collection reads stored rows: invisible, additive or reinterpreting."""
    from ledgerlens.plans.compat import judge

    return judge(old, new).verdict


def valid(value: Any, schema: Mapping[str, Any]) -> bool:
    """The subset of JSON Schema that collections use."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    types = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
    if kinds and not any(isinstance(value, types[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str):
        return len(value) >= schema.get("minLength", 0) and len(value) <= schema.get("maxLength", math.inf) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return False
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            return False
        return all(valid(v, schema.get("items") or {}) for v in value)
    if isinstance(value, dict):
        own = schema.get("properties") or {}
        if not set(schema.get("required", [])) <= set(value) or schema.get("additionalProperties") is False and set(value) - set(own):
            return False
        return all(valid(v, own[k]) for k, v in value.items() if k in own)
    return True
