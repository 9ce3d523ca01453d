"""Catalog rules with their error codes."""

import pytest

from ledgerlens.plans.catalog import Catalog, CatalogError, contract_hash, digest, filled, parameter, valid, verdict

GOOD = """
collections:
  - {name: notes, version: 1, mode: keyed, schema: {type: object, required: [text], properties: {text: {type: string}, at: {type: string, format: date-time}, tags: {type: array, items: {type: string}}}}, fields: {at: {path: at, type: datetime, sort: true}}}
  - {name: notes, version: 2, active: true, mode: keyed, schema: {type: object, required: [text], properties: {text: {type: string}}}}
views: [{name: v, parameters: {n: {type: integer, min: 1, max: 5, default: 2}}, query: {k: "{{ params.n }}", note: "top {{ params.n }}"}}]
"""


def code(text):
    with pytest.raises(CatalogError) as e:
        Catalog.load(text)
    return e.value.code


def test_versions_and_views():
    c = Catalog.load(GOOD)
    assert c.get("collections", "notes")["version"] == 2 and c.get("collections", "notes@1")["version"] == 1
    assert c.query_of("v", {}) == {"k": 2, "note": "top 2"} and c.query_of("v", {"n": 5})["k"] == 5
    for bad in ({"n": 9}, {"n": "x"}, {"m": 1}, {"n": True}):
        with pytest.raises(CatalogError):
            c.query_of("v", bad)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a: 1\na: 2", "duplicate_key"),
        ("collections: [{name: x, schema: {type: object}}]", "text_required"),
        (GOOD.replace("path: at", "path: absent"), "field_path_unknown"),
        (GOOD.replace("type: datetime", "type: number"), "field_type_differs"),
        (GOOD.replace("path: at, type: datetime", "path: tags, type: 'string[]'"), "array_not_sortable"),
        (GOOD.replace("params.n }}\", note", "params.m }}\", note"), "parameter_unknown"),
        ("processors: [{name: a, supersedes: b}]", "supersedes_unknown"),
        ("processors: [{name: a, supersedes: b}, {name: b, supersedes: a}]", "supersession_cycle"),
        ("processors: [{name: a, scores: [s]}, {name: b, scores: [s]}]", "score_not_unique"),
        ("derivations: [{name: a, sources: [x], target: y}, {name: b, sources: [y], target: x}]", "derivation_cycle"),
        ("derivations: [{name: a, sources: [x], target: x}]", "derivation_cycle"),
    ],
)
def test_errors(text, expected):
    assert code(text) == expected


def test_own_outputs_may_be_ignored():
    Catalog.load("derivations: [{name: a, sources: [x], target: x, ignore_own_outputs: true}]")


def test_hashes_and_verdicts():
    a = Catalog.load(GOOD).get("collections", "notes@1")
    assert digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1}) and contract_hash(a) == contract_hash({**a, "active": True})
    more = {**a, "schema": {**a["schema"], "properties": {**a["schema"]["properties"], "extra": {"type": "string"}}}}
    assert verdict(a, {**a, "optional_processors": ["x"]}) == "invisible" and verdict(a, more) == "additive"
    assert verdict(more, a) == "reinterpreting" and verdict(a, {**a, "mode": "event"}) == "reinterpreting"


def test_templates_and_schemas():
    assert filled({"a": "{{ x.y }}", "b": "n={{x.y}}"}, {"x": {"y": [1]}}) == {"a": [1], "b": "n=[1]"}
    with pytest.raises(CatalogError):
        filled("{{ x.z }}", {"x": {}})
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"enum": [1, 2]}, "uniqueItems": True, "maxItems": 2}}}
    assert valid({"a": None}, schema) and valid({"a": 1, "b": [1, 2]}, schema)
    assert not any(valid(x, schema) for x in ({}, {"a": 0}, {"a": True}, {"a": 1, "c": 1}, {"a": 1, "b": [1, 1]}, {"a": 1, "b": [3]}))
    with pytest.raises(CatalogError):
        parameter("p", {"type": "number"}, float("inf"))


def test_a_folder_is_one_catalog(tmp_path):
    collections, views = GOOD.strip().split("views:")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "collections.yaml").write_text(collections)
    (tmp_path / "views.yml").write_text("views:" + views)
    c = Catalog.load_folder(str(tmp_path))
    assert c.get("views", "v")["name"] == "v" and len(c.families["collections"]) == 2
    (tmp_path / "z.yaml").write_text("views:" + views)
    with pytest.raises(CatalogError) as e:
        Catalog.load_folder(str(tmp_path))
    assert e.value.code == "duplicate_definition"
