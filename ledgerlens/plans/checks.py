"""Checks of a catalog's definitions against each other, beyond those of single collections: each has a stable code."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from ledgerlens.operators.predicates import IllegalPredicate, legal
from ledgerlens.operators.ranking import DEFAULTS, IllegalRank, check_rank
from ledgerlens.plans.catalog import Catalog, CatalogError, at_path, filled, kind_of

#: Limits of a catalog.
MOST_SCORES, MOST_MODEL_SCORERS, MOST_RECORDS, MOST_TOKENS = 8, 4, 500, 100_000
NUMERIC = ("number", "integer")
SIGNALS = {"vector": {"similarity"}, "text": {"text_match"}, "hybrid": {"similarity", "text_match"}, "recent": set(), "structured": set()}
GRAPH_PARAMETERS = {"seed": "string", "direction": "string", "depth": "integer", "limit": "integer"}
EXAMPLES = {"string": "x", "datetime": "2024-01-01T00:00:00Z", "number": 1.0, "integer": 1, "boolean": True, "string_array": ["x"]}


def _need(holds: Any, code: str, message: str) -> None:
    if not holds:
        raise CatalogError(code, message)


def references(node: Any) -> Iterator[str]:
    """The paths in a template's ``{{ a.b }}``."""
    if isinstance(node, Mapping):
        for v in node.values():
            yield from references(v)
    elif isinstance(node, (list, tuple)):
        for v in node:
            yield from references(v)
    elif isinstance(node, str):
        yield from re.findall(r"\{\{\s*([\w.]+)\s*\}\}", node)


def fields_of(catalog: Catalog, names: Sequence[str]) -> dict[int, dict[str, dict[str, Any]]]:
    """The declared fields of every version of some collections, for ``predicates.legal``."""
    found = [c for c in catalog.families.get("collections", {}).values() if c["name"] in names or f"{c['name']}@{c['version']}" in names]
    return {k: c.get("fields") or {} for k, c in enumerate(found)}


def processors(catalog: Catalog) -> None:
    own = {p["name"]: p for p in catalog.families.get("processors", {}).values()}
    scores = [s for p in own.values() for s in p.get("scores", [])]
    _need(len(scores) <= MOST_SCORES, "too_many_scores", str(len(scores)))
    _need(sum(p.get("kind") == "llm" and bool(p.get("scores")) for p in own.values()) <= MOST_MODEL_SCORERS, "too_many_model_scorers", "")
    for p in own.values():
        if older := p.get("supersedes"):
            _need(own[older].get("kind") == p.get("kind"), "supersedes_other_kind", p["name"])
        for name, path in (p.get("score_fields") or {}).items():
            leaf = at_path(p.get("schema") or {}, path)
            _need(leaf is not None and kind_of(leaf) in NUMERIC, "score_field_not_numeric", f"{p['name']}.{name}")


def annotation_fields(catalog: Catalog) -> None:
    """Fields that read annotations: the processor must be there, and its schema must have the path with the type."""
    own = {p["name"]: p for p in catalog.families.get("processors", {}).values()}
    for c in catalog.families.get("collections", {}).values():
        for name, f in (c.get("fields") or {}).items():
            if a := f.get("annotation"):
                _need(a in own, "annotation_unknown", f"{c['name']}.{name}: {a}")
                leaf = at_path(own[a].get("schema") or {}, f["path"])
                _need(leaf is not None, "field_path_unknown", f"{c['name']}.{name}")
                _need(kind_of(leaf) == f["type"] or (f["type"] == "number" and kind_of(leaf) == "integer"), "field_type_differs", f"{c['name']}.{name}")


def rank_defaults(catalog: Catalog, defaults: Mapping[str, Any] = DEFAULTS) -> None:
    known = {s for p in catalog.families.get("processors", {}).values() for s in (*p.get("scores", []), *(p.get("score_fields") or {}))}
    for mode, rank in defaults.items():
        try:
            check_rank(rank, SIGNALS[mode], known)
        except IllegalRank as e:
            raise CatalogError("rank_default", f"{mode}: {e}") from None


def derivations(catalog: Catalog) -> None:
    for d in catalog.families.get("derivations", {}).values():
        name, driver, emit = d["name"], d.get("driver"), d.get("emit")
        if driver is None or emit is None:
            continue  # a short form, checked for circles only
        for c in (*driver.get("collections", []), *(s["collection"] for s in d.get("named_sources", {}).values() if "collection" in s), emit["collection"]):
            try:
                catalog.get("collections", c)
            except CatalogError:
                raise CatalogError("collection_unknown", f"{name}: {c}") from None
        _need(0 < driver.get("max_records", 1) <= MOST_RECORDS and 0 < driver.get("max_tokens", 1) <= MOST_TOKENS, "limit", name)
        target = catalog.get("collections", emit["collection"])
        keyed = bool(emit.get("keys") or emit.get("driver_key") or emit.get("dynamic_keys"))
        _need(target.get("mode", "event") == "mixed" or keyed == (target.get("mode", "event") == "keyed"), "emission_mode", name)
        values = {"input", "entity", *d.get("named_sources", {})}
        for task in d.get("tasks", []):
            for ref in references({k: v for k, v in task.items() if k not in ("name", "kind")}):
                _need(ref.split(".")[0] in values, "template_reference", f"{name}.{task['name']}: {ref}")
            values.add(task["name"])
        if emit.get("from"):
            _need(next(iter(references(emit["from"])), "").split(".")[0] in values, "template_reference", f"{name}.emit")
        _need(not d.get("ignore_own_outputs") or emit.get("driver_key"), "ignore_own_outputs", name)
        declared = fields_of(catalog, driver.get("collections", []))
        for t in d.get("triggers", []):
            _trigger(name, t, driver, declared, catalog)


def _trigger(name: str, t: Mapping[str, Any], driver: Mapping[str, Any], declared: Mapping[int, Mapping], catalog: Catalog) -> None:
    """Scopes are within the driver's (an empty list is all); ``at`` needs a time, accumulators a number."""
    if t["on"] in ("write", "quiet", "changed", "retraction"):
        for key in ("collections", "types", "statuses"):
            own, all_ = set(t.get(key, [])), set(driver.get(key, []))
            _need(not own or not all_ or own <= all_, "trigger_scope", f"{name}: {key}")
    find = lambda field: [f[field]["type"] if field in f else None for f in declared.values()]
    if t["on"] == "at":
        _need(find(t["field"]) and set(find(t["field"])) == {"datetime"}, "at_not_datetime", f"{name}: {t['field']}")
    if t["on"] == "accumulator" and t.get("field") and t.get("aggregate") not in ("count", "distinct_count"):
        _need(find(t["field"]) and set(find(t["field"])) <= set(NUMERIC), "metric_not_numeric", f"{name}: {t['field']}")
    if t.get("where"):
        _legal(f"{name}.where", t["where"], declared)
        needed = {f[w]["annotation"] for f in declared.values() for w in t["where"] if f.get(w, {}).get("annotation")}
        have = {p for c in driver.get("collections", []) for p in catalog.get("collections", c).get("required_processors") or []}
        _need(needed <= have, "where_not_required", f"{name}: {sorted(needed - have)}")


def _legal(where: str, conditions: Mapping[str, Any], declared: Mapping[int, Mapping], order: Sequence[str] = (), project: Sequence[str] = ()) -> None:
    try:
        legal(conditions, declared, order, project)
    except IllegalPredicate as e:
        raise CatalogError("field_use", f"{where}: {e}") from None


def views(catalog: Catalog) -> None:
    """Parameters get example values; then queries are checked like any search, graph or orphan view."""
    for v in catalog.families.get("views", {}).values():
        given = v.get("parameters") or {}
        example = {n: r["default"] if r.get("default") is not None else r["enum"][0] if r.get("enum") else r.get("min", EXAMPLES[r["type"]]) if r["type"] in NUMERIC else EXAMPLES[r["type"]] for n, r in given.items()}
        query = filled(v.get("query", {}), {"params": example})
        kind = v.get("kind", "search")
        if kind in ("graph", "graph_orphans"):
            _graph_view(catalog, v, given)
        elif "mode" in query:
            _need(query["mode"] in SIGNALS, "unknown_mode", f"{v['name']}: {query['mode']}")
            if scope := query.get("collections"):
                declared = fields_of(catalog, scope)
                _need(declared, "collection_unknown", f"{v['name']}: {scope}")
                _legal(v["name"], query.get("where", {}), declared, [f for f, _ in query.get("order_by", [])], query.get("fields", []))
            if query.get("rank") is not None:
                try:
                    check_rank(query["rank"], SIGNALS[query["mode"]])
                except IllegalRank as e:
                    raise CatalogError("rank", f"{v['name']}: {e}") from None


def _graph_view(catalog: Catalog, v: Mapping[str, Any], given: Mapping[str, Any]) -> None:
    wanted = GRAPH_PARAMETERS if v["kind"] == "graph" else {"limit": "integer"}
    _need({n: r["type"] for n, r in given.items()} == wanted, "graph_parameters", v["name"])
    edges = catalog.get("collections", v["edges"])
    _need(edges.get("mode", "event") == "event", "edges_not_events", v["edges"])
    for role in ("subject", "object", "predicate"):
        f = (edges.get("fields") or {}).get((v.get("roles") or {}).get(role, role))
        _need(f is not None and f["type"] == "string" and f.get("filter"), "role", f"{v['name']}: {role}")
    if v["kind"] == "graph_orphans":
        _need(catalog.get("collections", v["nodes"]).get("mode") in ("keyed", "mixed"), "nodes_not_keyed", v["nodes"])


def artifacts(catalog: Catalog) -> None:
    for a in catalog.families.get("artifacts", {}).values():
        for block, b in (a.get("blocks") or {}).items():
            family = "views" if "view" in b else "collections"
            try:
                catalog.get(family, b["view"] if "view" in b else b["collection"])
            except (CatalogError, KeyError):
                raise CatalogError("block_source", f"{a['name']}.{block}") from None
        for ref in references(a.get("template", "")):
            parts = ref.split(".")
            _need(len(parts) == 2 and parts[0] == "blocks" and parts[1] in (a.get("blocks") or {}), "template_reference", f"{a['name']}: {ref}")
        if target := a.get("snapshot"):
            _need(catalog.get("collections", target).get("mode") in ("keyed", "mixed"), "snapshot_target", f"{a['name']}: {target}")
        _need(not a.get("reviewed") or a.get("snapshot"), "reviewed_without_snapshot", a["name"])


def packages(catalog: Catalog) -> None:
    """Everything that a package's definitions refer to is listed in it; its tools point to what it lists."""
    for p in catalog.families.get("packages", {}).values():
        listed = {(f, n.split("@")[0]) for f, names in (p.get("contents") or {}).items() for n in names}
        for family, name in sorted(listed):
            for need in _needs(family, catalog.get(family, name)):
                _need(need in listed, "package_open", f"{p['name']}: {name} needs {need[0]} {need[1]}")
        for tool, t in (p.get("tools") or {}).items():
            _need((t["family"], t["target"]) in listed, "tool_target", f"{p['name']}.{tool}")


def _needs(family: str, d: Mapping[str, Any]) -> list[tuple[str, str]]:
    if family == "collections":
        names = [*(d.get("required_processors") or []), *(f["annotation"] for f in (d.get("fields") or {}).values() if f.get("annotation"))]
        return [("processors", n) for n in names]
    if family == "derivations":
        driver, emit = d.get("driver") or {}, d.get("emit") or {}
        return [("collections", n.split("@")[0]) for n in (*driver.get("collections", []), *([emit["collection"]] if emit else []))]
    if family == "views":
        return [("collections", n) for n in (*((d.get("query") or {}).get("collections") or []), *(d[k] for k in ("edges", "nodes") if k in d))]
    if family == "artifacts":
        return [("views", b["view"]) if "view" in b else ("collections", b["collection"]) for b in (d.get("blocks") or {}).values()]
    return []


def check(catalog: Catalog) -> None:
    """All checks, in the order in which definitions build on each other."""
    for part in (processors, annotation_fields, rank_defaults, derivations, views, artifacts, packages):
        if part is not rank_defaults or catalog.families.get("rank_defaults"):
            part(catalog)
