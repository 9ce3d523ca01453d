"""Contracts, catalog checks, models, context and projections by small cases."""

import copy
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.functions import json_schema
from ledgerlens.operators import cursors, derivation, enrich, packing, predicates, projection, ranking, storage
from ledgerlens.operators.numbering import numbered_on
from ledgerlens import api
from ledgerlens.plans import checks, compat, context, models, search
from ledgerlens.plans.catalog import Catalog, CatalogError

BASE = {"name": "notes", "version": 1, "mode": "keyed", "schema": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "n": {"type": "number"}}}, "fields": {"n": {"path": "n", "type": "number"}}}


def changed(path, value):
    new = copy.deepcopy(BASE)
    at = new
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return new


@pytest.mark.parametrize(
    ("path", "value", "expected"),
    [
        (("active",), True, "invisible"),
        (("schema", "properties", "m"), {"type": "string"}, "additive"),
        (("fields", "m"), {"path": "n", "type": "number"}, "additive"),
        (("schema", "additionalProperties"), False, "reinterpreting"),
        (("schema", "required"), ["text", "n"], "reinterpreting"),
        (("schema", "required"), [], "reinterpreting"),
        (("schema", "title"), "x", "reinterpreting"),
        (("schema", "properties", "n", "minimum"), 1, "reinterpreting"),
        (("fields", "n", "path"), "text", "reinterpreting"),
        (("mode",), "event", "reinterpreting"),
        (("required_processors",), ["p"], "reinterpreting"),
    ],
)
def test_contract_changes(path, value, expected):
    assert compat.judge(BASE, changed(path, value)).verdict == expected


def test_what_a_contract_change_must_prove():
    more = changed(("schema", "properties", "m"), {"type": "string"})
    assert compat.judge(BASE, more).verify_keys == ("m",)
    closed, open_ = changed(("schema", "additionalProperties"), False), changed(("schema", "additionalProperties"), True)
    assert compat.judge(closed, open_).verdict == "additive"
    both = copy.deepcopy(closed)
    both["schema"]["properties"]["m"] = {"type": "string"}
    assert compat.judge(closed, both).verify_keys == ()
    old, new = changed(("fields", "n"), {"annotation": "a", "path": "x", "type": "number"}), changed(("fields", "n"), {"annotation": "b", "path": "x", "type": "number"})
    assert compat.judge(old, new).verdict == "reinterpreting"
    repointed = compat.judge(old, new, {"b": "a"})
    assert repointed.verdict == "additive" and repointed.absent_annotations == ("b",) and repointed.repointed == ("n",)
    assert not compat.same({"a": True}, {"a": 1})
    with pytest.raises(ValueError):
        compat.judge(BASE, {**BASE, "version": 2})


def catalog(**more):
    """A catalog that holds, with families replaced or added."""
    note = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "at": {"type": "string", "format": "date-time"}, "n": {"type": "number"}, "s": {"type": "string"}}}
    field = lambda path, kind: {"path": path, "type": kind, "filter": True, "sort": True}
    fields = {"at": field("at", "datetime"), "n": field("n", "number"), "s": field("s", "string"), "level": {"annotation": "topic", **field("level", "integer")}}
    role = {r: field(r, "string") for r in ("subject", "object", "predicate")}
    edge = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, **{r: {"type": "string"} for r in role}}}
    base = {
        "collections": [{"name": "events", "mode": "event", "schema": note, "fields": fields, "required_processors": ["topic"]}, {"name": "profiles", "mode": "keyed", "schema": note, "fields": fields}, {"name": "edges", "mode": "event", "schema": edge, "fields": role}],
        "processors": [{"name": "topic", "kind": "json", "schema": {"type": "object", "properties": {"level": {"type": "integer"}}}, "score_fields": {"level": "level"}}, {"name": "importance", "kind": "llm", "scores": ["importance"]}],
        "derivations": [{"name": "d", "driver": {"collections": ["events"], "max_records": 50}, "named_sources": {"old": {"collection": "profiles"}}, "tasks": [{"name": "t", "kind": "template", "prompt": "{{ input }} {{ old.text }}"}], "emit": {"collection": "profiles", "keys": ["k"], "from": "{{ t }}"}, "triggers": [{"on": "write", "types": ["a"], "where": {"level": {"gt": 1}}}, {"on": "at", "field": "at"}, {"on": "accumulator", "field": "n", "aggregate": "sum"}]}],
        "views": [{"name": "v", "parameters": {"low": {"type": "number", "default": 1}}, "query": {"mode": "structured", "collections": ["events"], "where": {"n": {"gte": "{{ params.low }}"}}, "order_by": [["n", "desc"]]}}, {"name": "g", "kind": "graph", "edges": "edges", "parameters": {"seed": {"type": "string"}, "direction": {"type": "string"}, "depth": {"type": "integer"}, "limit": {"type": "integer"}}}, {"name": "o", "kind": "graph_orphans", "edges": "edges", "nodes": "profiles", "parameters": {"limit": {"type": "integer"}}}],
        "artifacts": [{"name": "a", "blocks": {"b": {"view": "v"}, "c": {"collection": "profiles"}}, "template": "{{ blocks.b }} {{ blocks.c }}", "snapshot": "profiles", "reviewed": True}],
        "packages": [{"name": "p", "contents": {"collections": ["events", "profiles"], "processors": ["topic"], "views": ["v"], "artifacts": ["a"], "derivations": ["d"]}, "tools": {"x": {"family": "views", "target": "v"}}}],
        "rank_defaults": [{"name": "default"}],
    }
    base = {**base, **more}
    made = Catalog({f: {f"{d['name']}@{d.get('version', 1)}": {"version": 1, **d} for d in items} for f, items in base.items()})
    made.check()
    return made


def edited(family, name, path, value):
    own = copy.deepcopy([d for d in catalog().families[family].values()])
    at = next(d for d in own if d["name"] == name)
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return {family: own}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (("processors", "topic", ("score_fields", "level"), "absent"), "score_field_not_numeric"),
        (("processors", "importance", ("scores",), [f"s{k}" for k in range(9)]), "too_many_scores"),
        (("processors", "importance", ("supersedes",), "topic"), "supersedes_other_kind"),
        (("collections", "events", ("fields", "level", "annotation"), "gone"), "annotation_unknown"),
        (("collections", "events", ("fields", "level", "type"), "string"), "field_type_differs"),
        (("collections", "events", ("fields", "level", "path"), "gone"), "field_path_unknown"),
        (("derivations", "d", ("driver", "collections"), ["gone"]), "collection_unknown"),
        (("derivations", "d", ("driver", "max_records"), 5000), "limit"),
        (("derivations", "d", ("emit", "keys"), []), "emission_mode"),
        (("derivations", "d", ("tasks", 0, "prompt"), "{{ gone }}"), "template_reference"),
        (("derivations", "d", ("emit", "from"), "{{ gone }}"), "template_reference"),
        (("derivations", "d", ("ignore_own_outputs",), True), "ignore_own_outputs"),
        (("derivations", "d", ("driver", "types"), ["b"]), "trigger_scope"),
        (("derivations", "d", ("triggers", 1, "field"), "n"), "at_not_datetime"),
        (("derivations", "d", ("triggers", 2, "field"), "s"), "metric_not_numeric"),
        (("derivations", "d", ("triggers", 0, "where"), {"s": {"gt": 1}}), "field_use"),
        (("collections", "events", ("required_processors",), []), "where_not_required"),
        (("views", "v", ("query", "mode"), "psychic"), "unknown_mode"),
        (("views", "v", ("query", "collections"), ["gone"]), "collection_unknown"),
        (("views", "v", ("query", "where"), {"gone": {"eq": 1}}), "field_use"),
        (("views", "v", ("query", "rank"), "similarity"), "rank"),
        (("views", "g", ("parameters", "depth", "type"), "string"), "graph_parameters"),
        (("views", "g", ("edges",), "profiles"), "edges_not_events"),
        (("views", "g", ("roles",), {"subject": "text"}), "role"),
        (("views", "o", ("nodes",), "events"), "nodes_not_keyed"),
        (("artifacts", "a", ("blocks", "b", "view"), "gone"), "block_source"),
        (("artifacts", "a", ("template",), "{{ blocks.gone }}"), "template_reference"),
        (("artifacts", "a", ("snapshot",), "events"), "snapshot_target"),
        (("artifacts", "a", ("snapshot",), None), "reviewed_without_snapshot"),
        (("packages", "p", ("contents", "processors"), []), "package_open"),
        (("packages", "p", ("tools", "x", "target"), "g"), "tool_target"),
    ],
)
def test_catalog_checks(change, code):
    with pytest.raises(CatalogError) as e:
        catalog(**edited(*change))
    assert e.value.code == code


def test_rank_defaults_need_their_signals_and_scores():
    checks.rank_defaults(catalog(), {"text": "text_match", "recent": {"score": "importance"}})
    for bad in ({"recent": "similarity"}, {"text": {"score": "gone"}}):
        with pytest.raises(CatalogError):
            checks.rank_defaults(catalog(), bad)


def test_sources_are_resolved():
    good = search.Source("structured", search.Scope(collections=("events",)), where={"n": {"gt": 1}}, order_by=[("n", "asc")])
    assert search.resolve(good, catalog()) is good
    for bad in (search.Source("structured", search.Scope(collections=("gone",))), search.Source("structured", search.Scope(collections=("events",)), where={"s": {"gt": 1}}), search.Source("recent", rank={"score": "gone"})):
        with pytest.raises(ValueError):
            search.resolve(bad, catalog())


def test_legality_over_versions():
    n = {"type": "number", "filter": True}
    assert predicates.legal({"n": {"gt": 1}}, {1: {"n": n}, 2: {"n": n}}) == {"n": "number"}
    for declared, order in (({1: {"n": n}, 2: {}}, ()), ({1: {"n": n}, 2: {"n": {**n, "type": "string"}}}, ()), ({1: {"n": {**n, "filter": False}}}, ()), ({1: {"n": n}}, ("n",)), ({1: {"n": {**n, "optional": True}}}, ())):
        with pytest.raises(predicates.IllegalPredicate):
            predicates.legal({"n": {"gt": 1}}, declared, order)
    assert predicates.legal({"n": {"exists": True}}, {1: {"n": {**n, "optional": True}}})


def test_models():
    def bad(prompt):
        raise OSError("down")

    waits = []
    runtime = models.Runtime({"a": [("x", bad), ("y", models.Canned(["{}", '{"n": 1}', "no", "no"]))], "b": [("x", bad)]}, waits.append)
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}
    budget = models.Budget(4, 1000)
    assert models.json_call(runtime, "a", "p", schema, budget) == {"n": 1} and budget.calls == 2
    assert [a.target for a in runtime.audit] == ["x", "x", "y"] * 2 and waits == [2.0, 2.0]
    with pytest.raises(ValueError, match="twice"):
        models.json_call(runtime, "a", "p", schema, budget)
    with pytest.raises(models.BudgetExceeded):
        models.json_call(runtime, "a", "p", schema, budget)
    with pytest.raises(models.AttemptsExhausted):
        runtime.complete("b", "p")
    assert models.Canned()("a [importance=2] [x=1.5]") == '{"importance": 2.0, "x": 1.5}'


def test_tasks_and_sources():
    got = models.run_tasks([{"name": "f", "kind": "extract_facts", "input": "page", "config": {"heading": "facts"}}, {"name": "t", "kind": "template", "input": "f", "foreach": True, "config": {"text": "-{{ value }}-"}}], {"page": models.Sourced("## Facts\n- a\n- b", (7, 8))})
    assert got["t"] == models.Sourced(["-a-", "-b-"], (7, 8)) and len(models.task_hash("template")) == 64
    assert models.render("{{ a }} {{ b }}", {"a": models.Sourced("x", (1, 2)), "b": models.Sourced([1], (2, 3))}) == models.Sourced("x [1]", (1, 2, 3))
    with pytest.raises(ValueError):
        models.run_tasks([{"name": "t", "kind": "template", "input": "x", "foreach": True}], {"x": models.Sourced(list("abcdef"))})
    with pytest.raises(ValueError):
        models.task("template")(print)
    assert models.run_tasks([{"name": "r", "kind": "extract_relations", "input": "p", "config": {"directories": ["docs"]}}], {"p": models.Sourced("see docs/a and [x](docs/b)")})["r"].value == [["bare-slug", "docs/a"], ["markdown", "docs/b"]]


def test_model_and_search_tasks():
    runtime = models.Runtime({"m": [("x", models.Canned(['{"n": 2}']))]})
    steps = [{"name": "s", "kind": "search", "input": "q", "config": {"find": lambda q: [(1, f"{q} one"), (2, "two"), (3, "three")], "k": 2}}, {"name": "l", "kind": "llm", "input": "s", "config": {"runtime": runtime, "model": "m", "prompt": "Count {{ value }}", "schema": {"type": "object", "required": ["n"]}, "budget": models.Budget(1, 100)}}]
    got = models.run_tasks(steps, {"q": models.Sourced("x", (9,))})
    assert got["s"] == models.Sourced(["x one", "two"], (9, 1, 2)) and got["l"] == models.Sourced({"n": 2}, (9, 1, 2))


def test_answers_cite_what_they_saw():
    canned = models.Canned(['{"answer": "yes", "citations": ["a"]}', '{"answer": "no", "citations": ["z"]}'])
    runtime = models.Runtime({"m": [("x", canned)]})
    evidence = [("a", "one"), ("b", "two")]
    assert models.answer("so?", evidence, runtime, "m", models.Budget(1, 500)) == {"answer": "yes", "citations": ["a"], "shown": ["a", "b"]}
    with pytest.raises(models.HiddenCitation):
        models.answer("so?", evidence, runtime, "m", models.Budget(1, 500))
    with pytest.raises(ValueError):
        models.answer("", evidence, runtime, "m", models.Budget(1, 500))


def test_rerank(spark):
    rows = [{"id": k, "rank": k} for k in range(1, 6)]
    got = models.rerank(rows, lambda r: {1: 0.1, 2: 0.9, 3: 0.9}[r["id"]], 3)
    assert [(r["id"], r["rank"], r["rerank_score"]) for r in got] == [(2, 1, 0.9), (3, 2, 0.9), (1, 3, 0.1), (4, 4, -1.0), (5, 5, -2.0)]
    made = search.reranked(spark.createDataFrame(rows, "id long, rank int"), lambda r: -r["id"], 2).orderBy("rank").collect()
    assert [r["id"] for r in made] == [1, 2, 3, 4, 5]


def test_context_carries_and_skips(spark):
    lines = lambda rows: spark.createDataFrame([(i, "x" * n, k) for k, (i, n) in enumerate(rows)], "id int, line string, place int")
    made = context.assemble({"document": lines([(1, 80), (2, 4000), (3, 40)]), "search": lines([(1, 4), (4, 200)]), "recent": lines([(5, 4)]), "delta": lines([(6, 4)])}, 100)
    # 30 of 100 for the document: 20 fit, 1000 are skipped, 10 fit; 40 for the search: 50 do not fit
    assert made.ids == [1, 3, 5, 6] and made.truncated and made.sections["search"] == {"ids": [], "tokens": 0}
    without = context.assemble({"recent": lines([(5, 120)]), "delta": lines([(6, 4)])}, 100, consumer=False)
    assert without.ids == [5] and "delta" not in without.sections


def test_graph_boost_lifts_what_is_near(spark):
    rows = [(k, k, "c", f"key{k}", "t", "active", True, False, k) for k in range(1, 7)]
    log = spark.createDataFrame(rows, "id long, seq long, entity string, key string, type string, status string, ready boolean, tombstone boolean, value long").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("id").cast("int")))
    log = log.withColumn("collection", F.lit("c"))
    near = spark.createDataFrame([("key1", 0)], "node string, distance int")
    source = {"a": search.Source("structured", order_by=[("value", "desc")], k=2)}
    got = search.search(log, source, k=3, graph=search.GraphBoost(near, 1.0)).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 6, 5]


def test_ranks_that_are_not_finite_are_errors(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        df.select(ranking.finite(F.col("x"))).collect()
    assert df.where("x = 1").select(ranking.finite(F.col("x")).alias("y")).first()["y"] == 1.0


def test_hits_include_only_known_fields(spark):
    with pytest.raises(projection.IllegalProjection):
        projection.hits(spark.range(1), ("secret",))


def test_json_violations(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "object", "required": ["c"], "properties": {"c": {"type": "boolean"}}}, "d": {"type": "array", "items": {"type": "number"}, "minItems": 1}}, "additionalProperties": False}
    cases = {'{"a": 1}': [], '{"a": 0}': ["minimum:$.a"], "{}": ["required:$.a"], '{"a": "1"}': ["type:$.a"], '{"a": 1, "b": {}}': ["required:$.b.c"], '{"a": 1, "b": {"c": 1}}': ["type:$.b.c"], '{"a": 1, "d": []}': ["minItems:$.d"], '{"a": 1, "d": ["x"]}': ["items:$.d"], '{"a": 1, "e": 1}': ["additional:$"], "[]": ["type:$"], "{": ["json"]}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", json_schema.violations(F.col("c"), schema).alias("v")).collect()
    assert {r["c"]: r["v"] for r in rows} == cases


def test_emissions():
    assert derivation.Emission("c").effect == "append" and derivation.Emission("c", keys=("a",), complete=True).effect == "replace"
    assert derivation.Emission("c", driver_key=True, review=True).status == "draft" and derivation.Emission("c", driver_key=True).effect == "patch"
    for bad in ({"keys": ("a",), "driver_key": True}, {"dynamic_keys": True}, {"complete": True}):
        with pytest.raises(derivation.IllegalDerivation):
            derivation.Emission("c", **bad)
    a, b = derivation.Driver(types=("x", "y"), max_records=5), derivation.Driver(types=("y", "x"), max_records=9)
    assert a.contract() == b.contract() != derivation.Driver(types=("x",)).contract()


def draft(entity, ordinal, key=None, text="t", retract=False, cited=(1,)):
    return (entity, ordinal, key, text, retract, list(cited) if cited is not None else None)


def test_candidate_faults(spark):
    schema = "entity string, ordinal long, key string, text string, retract boolean, citations array<long>"
    visible = spark.createDataFrame([(e, [1, 2]) for e in "abcdefghi"], "entity string, ids array<long>")
    head = "entity string, key string, head_id long, head_content string, head_depth int, head_tombstone boolean"
    compiled = lambda rows, heads, emission: {(r["entity"], r["ordinal"]): (r["error"], r["change"], r["accepted"]) for r in derivation.compile_candidates(spark.createDataFrame(rows, schema), spark.createDataFrame(heads, head), visible, emission).collect()}
    events = [draft("a", 1), draft("b", 1, "k"), draft("c", 1, retract=True, text=None), draft("d", 1, text=None), draft("e", 1, cited=[]), draft("f", 1, cited=[3]), draft("g", 1, cited=[1, 1]), draft("h", 1, cited=None), draft("i", 1), draft("i", 2), draft("i", 3)]
    got = compiled(events, [], derivation.Emission("c", max_records=2))
    assert {e: x[0] for (e, n), x in got.items() if n == 1} == {"a": None, "b": "key_not_allowed", "c": "retract_event", "d": "no_content", "e": "citations", "f": "citation_hidden", "g": "citation_repeated", "h": "citations", "i": "too_many"}
    keyed = [("a", "x", 5, "t", 1, False), ("a", "y", 6, "o", 2, False), ("b", "x", None, None, None, None), ("b", "y", None, None, None, None), ("c", "x", 7, "o", 0, True), ("c", "y", 8, "o", 0, False)]
    rows = [draft("a", 1, "x"), draft("a", 2, "y"), draft("b", 1, "x"), draft("c", 1, "x", None, True, []), draft("c", 2, "y", None, True, []), draft("d", 1, "x"), draft("d", 2, "x"), draft("e", 1, "z"), draft("f", 1, None)]
    got = compiled(rows, keyed + [("d", "x", None, None, None, None)], derivation.Emission("c", keys=("x", "y"), complete=True))
    assert got["a", 1] == (None, "unchanged", True) and got["a", 2] == (None, "changed", True)
    assert got["b", 1] == ("incomplete", "added", False)
    assert got["c", 1] == (None, "unchanged", True) and got["c", 2] == (None, "removed", True)
    assert got["d", 1][0] == "key_repeated" and got["e", 1][0] == "key_unknown" and got["f", 1][0] == "key_missing"
    dynamic = derivation.Emission("c", dynamic_keys=True, max_active_keys=2)
    got = compiled([draft("a", 1, "z"), draft("c", 1, "z"), draft("c", 2, "y", None, True)], keyed, dynamic)
    assert got["a", 1][0] == "capacity" and got["c", 1] == (None, "added", True)


def test_token_batches(spark):
    rows = spark.createDataFrame([("a", k, c) for k, c in enumerate([3, 3, 3, 9, 1, 1, 1, 1])] + [("b", 0, 1)], "g string, at int, cost int")
    got = packing.token_batches(rows, "cost", 6, 3, [F.col("at")], ("g",)).orderBy("g", "at").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 3, 3, 3, 4, 0]


def test_pages_of_bytes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y" * 100)], "at int, t string")
    with pytest.raises(ValueError):
        packing.checked_page(rows, ["t"], 50, [F.col("at")])
    assert packing.checked_page(rows.limit(1), ["t"], 50, [F.col("at")]).count() == 1


def test_embedding_faults_are_annotations(spark):
    class Down(enrich.HashEmbedder):
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise OSError("down")
            return [[1.0]] if "short" in texts[0] else super().__call__(texts)

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
    rows = spark.createDataFrame([(1, "good", False), (2, None, False), (3, "gone", True), (4, "bad", False), (5, "short", False)], "id int, text string, tombstone boolean").coalesce(1)
    got = {r["id"]: r for r in enrich.embed(rows, Down(8), batch=1).collect()}
    assert len(got[1]["vector"]) == 8 and got[2]["vector"] is None and got[2]["error"] is None and got[3]["error"] is None
    assert got[4]["error"].startswith("OSError") and got[5]["error"].startswith("BadVectors")


def test_numbers_are_dense(spark):
    rows = spark.range(5000).withColumn("k", F.xxhash64("id"))
    got = numbered_on(rows, [F.col("k")], F.lit(10)).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["seq"])] == [r["id"] for r in sorted(got, key=lambda r: r["k"])]
    assert sorted(r["seq"] for r in got) == list(range(11, 5011))


def test_cursors_hold_to_their_scope(spark):
    log = spark.createDataFrame([(k,) for k in range(1, 9)], "seq long")
    mine = {"position": 5, "scope_hash": cursors.scope_hash({"types": ["a", "b"]})}
    assert [r["seq"] for r in cursors.delta_of(log, mine, {"types": ["b", "a"]}, 2).collect()] == [6, 7]
    with pytest.raises(cursors.CursorError):
        cursors.delta_of(log, mine, {"types": ["a"]}, 2)
    marks = spark.createDataFrame([("e", "h1", 7), ("f", "h2", 8)], "entity string, contract_hash string, watermark long")
    assert sorted(tuple(r)[:3] for r in cursors.rebind(marks, "h1", "h3", carry=True).collect()) == [("e", "h3", 7), ("f", "h2", 8)]


def test_sweeps_end_with_a_confirming_pass(spark):
    rows = spark.createDataFrame([(k, k, True) for k in range(1, 6)], "id long, seq long, ready boolean")
    none = rows.limit(0)
    page, cursor = storage.sweep_step(rows, none, 0, 3)
    assert page.count() == 3 and cursor == 3
    page, cursor = storage.sweep_step(rows, rows, cursor, 3)
    assert page.count() == 0 and cursor == 0
    assert storage.sweep_step(rows, rows, 0, 3)[1] is None


def test_cutover_can_be_undone(spark):
    rows = spark.createDataFrame([(1, "s1", 5), (2, "s1", 6)], "id int, space string, vector int")
    moved = storage.cutover(rows, spark.createDataFrame([(1, 50)], "id int, vector int"), "s2")
    assert {r["id"]: (r["space"], r["vector"], r["pending"]) for r in moved.collect()} == {1: ("s2", 50, False), 2: ("s2", None, True)}
    assert sorted(map(tuple, storage.undo_cutover(moved).collect())) == sorted(map(tuple, rows.collect()))


def test_named_views_and_the_local_index(spark):
    made = catalog()
    rows = [(k, k, "e", "events", f"k{k}", "t", "active", True, False, float(k), f"red fish {k}" if k % 2 else "blue", [float(k), 1.0]) for k in range(1, 7)]
    log = spark.createDataFrame(rows, "id long, seq long, entity string, collection string, key string, type string, status string, ready boolean, tombstone boolean, n double, text string, embedding array<double>").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r["id"] for r in search.query_view(log, made, "v", {"low": 3.0}).orderBy("rank").collect()] == [6, 5, 4, 3]
    packed = search.view_source(log, made, "v", {"low": 3.0}, 3, F.lit("12345678"))
    assert sorted(r["rank"] for r in packed.collect()) == [1]
    edges = spark.createDataFrame([("e1", "a", "b", "p"), ("e2", "b", "c", "p")], "edge_id string, subject string, object string, predicate string")
    paths = search.query_view(log, made, "g", {"seed": "a", "direction": "out", "depth": 2, "limit": 5}, edges=edges).collect()
    assert [r["nodes"] for r in paths] == [["a", "b"], ["a", "b", "c"]]
    index = search.LocalIndex(log)
    found = {(r["channel"], r["rank"]): r["id"] for r in index.candidates(2, vector=[1.0, 0.0], text="fish", where={"n": {"lt": 6}}).collect()}
    assert found["vector", 1] == 5 and found["text", 1] in (1, 3, 5)
    with pytest.raises(search.IllegalSearch):
        index.candidates(2)


def test_the_engine_reads_and_writes(spark):
    schema = "id string, seq long, entity string, collection string, version int, key string, type string, status string, ready boolean, tombstone boolean, content string, text string, run_id string, derived_from array<string>, depth int, dedupe_key string, annotations map<string,string>"
    row = lambda i, n, key, status="active", gone=False, run=None, parents=(), content='{"text":"a"}': (i, n, "e", "events", 1, key, "t", status, True, gone, content, f"text {i}", run, list(parents), 0, f"d{i}", {"topic": "x"})
    rows = [row("a", 1, "k"), row("b", 2, "k", parents=["a", "r"], run="r"), row("c", 3, "m", gone=True), row("d", 4, "n", "draft", content='{"text":"new"}'), row("r", 5, None), row("f", 6, "o", parents=["b"])]
    log = spark.createDataFrame(rows, schema).withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    engine = api.Engine(log, catalog())
    assert engine.record("b").first()["content"] == '{"text":"a"}' and engine.timeline(limit=2).count() == 2
    assert engine.entities("%E%").first()["n"] == 6
    live, gone = engine.document("e")
    assert sorted(r["id"] for r in live.collect()) == ["b", "f"] and [r["id"] for r in gone.collect()] == ["c"]
    assert [r["citations"] for r in engine.history("e", "k").collect()] == [["a"], []]
    assert [r["seq"] for r in engine.delta(None, {}, 2).collect()] == [1, 2]
    batch = log.where("id IN ('a', 'd')").withColumn("dedupe_key", F.concat(F.lit("new"), "id")).withColumn("id", F.concat(F.lit("z"), "id")).withColumn("ordinal", F.col("seq")).drop("seq")
    judged, after = engine.ingest(batch)
    assert {r["verdict"] for r in judged.collect()} == {"inserted"} and sorted(r["seq"] for r in after.collect())[-2:] == [7, 8]
    bad, same = engine.ingest(batch.withColumn("content", F.lit('{"n": "x"}')))
    assert {tuple(r["faults"]) for r in bad.collect()} == {("required:$.text", "type:$.n")} and same.count() == 6
    left, digests = engine.erase(log.where("id = 'b'"))
    assert sorted(r["id"] for r in left.collect()) == ["a", "c", "d"] and digests.first()["erased"] == 3
    verdicts, made = engine.promote(spark.createDataFrame([], "entity string, key string, base_seq long"))
    assert verdicts.first()["verdict"] == "promote" and [(r["promoted_from"], r["seq"]) for r in made.collect()] == [("d", 7)]
    assert engine.backfill(log.limit(0), 0, 2)[1] == 2 and engine.reindex_plan(3).count() >= 3
    assert engine.listings().where("family = 'views'").count() == 3
    assert {n: j.verdict for n, j in engine.compat(catalog(**edited("collections", "events", ("fields", "n", "path"), "n"))).items()} == {"events@1": "invisible", "profiles@1": "invisible", "edges@1": "invisible"}
    drafts = spark.createDataFrame([("e", 0, "k", "fresh", False, ["a"])], "entity string, ordinal long, key string, text string, retract boolean, citations array<string>")
    inputs = derivation.changes_input(log, spark.createDataFrame([], "entity string, watermark long"), derivation.Driver())
    rows = engine.run_derivation(drafts, inputs, derivation.Emission("events", keys=("k",)), "p").orderBy("seq").collect()
    assert [(r["type"], r["key"], r["depth"], r["seq"]) for r in rows] == [("run", None, 0, 7), ("derived", "k", 1, 8)]


def test_record_lines_with_scores(spark):
    from ledgerlens.functions import render

    rows = spark.createDataFrame([(1, "k", 0.5, False), (2, None, None, True)], "id int, key string, s double, gone boolean").withColumn("t", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    made = rows.select(render.record_line(F.col("id"), F.col("t"), F.lit("c/t"), F.col("key"), F.lit("a < b"), F.col("gone"), score=F.col("s")).alias("line")).collect()
    assert [r["line"] for r in made] == ["[id=1] 2024-01-02T03:04:05Z | c/t | key k | score 0.500 | a \\u003c b", "[id=2] 2024-01-02T03:04:05Z | c/t | retracted"]
    assert render.fence_overhead("x") == 3
