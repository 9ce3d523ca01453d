"""Operators on small literals: the numbers and rules that the engine promises."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.functions import render, text, vectors
from ledgerlens.operators import enrich, extract, graph, heads, packing, predicates, provenance, ranking, triggers
from ledgerlens.plans.search import IllegalSearch, Source, run_source
from ledgerlens.sources.records import IllegalBatch, Scope, append, ingest, scan

DAY = dt.datetime(2026, 7, 16, 12)


def log_of(spark, rows):
    """(seq, key, ready, tombstone, status, content) of one entity."""
    return spark.createDataFrame([(s, s, "e", "c", k, "t", st, r, t, DAY + dt.timedelta(hours=s), c) for s, k, r, t, st, c in rows], "id long, seq long, entity string, collection string, key string, type string, status string, ready boolean, tombstone boolean, occurred_at timestamp_ntz, content string")


def test_newer_unready_row_hides_the_older(spark):
    log = log_of(spark, [(1, "a", True, False, "active", "x"), (2, "a", False, False, "active", "y"), (3, "a", True, False, "draft", "z"), (4, "b", True, False, "active", "w"), (5, None, True, False, "active", "v")])
    assert sorted(r["seq"] for r in scan(log, Scope(current=True)).collect()) == [4, 5]
    live, gone = heads.document(log)
    assert sorted(r["seq"] for r in live.collect()) == [2, 4] and gone.count() == 0
    with pytest.raises(ValueError):
        heads.document(log, most=1)


def test_tombstones_are_retractions_and_transitions(spark):
    log = log_of(spark, [(1, "a", True, False, "active", "x"), (2, "a", True, True, "active", ""), (3, "a", True, False, "active", "x"), (4, "a", True, False, "active", "x"), (5, "a", True, False, "active", "y"), (6, "b", True, True, "active", "")])
    got = {r["seq"]: r["change"] for r in triggers.transitions(log, heads.SLOT, "content").collect()}
    assert got == {1: "added", 2: "removed", 3: "added", 4: "unchanged", 5: "changed", 6: "unchanged"}
    assert [r["key"] for r in heads.document(log)[1].collect()] == ["b"]


def test_ready_prefix_stops_at_the_first_unready(spark):
    log = log_of(spark, [(1, None, True, False, "active", ""), (2, None, True, False, "active", ""), (3, None, False, False, "active", ""), (4, None, True, False, "active", "")])
    assert [r["seq"] for r in heads.ready_prefix(log, 10).collect()] == [1, 2]
    assert heads.ready_prefix(log.where("seq > 2"), 10).count() == 0


def test_missing_values_fail_all_but_exists(spark):
    rows = spark.createDataFrame([(1, 5, ["a", "b"]), (2, None, None), (3, 7, [])], "id int, n int, tags array<string>")
    ids = lambda c: sorted(r["id"] for r in predicates.where(rows, c).collect())
    assert ids({"n": {"gt": 5}}) == [3] and ids({"n": {"exists": False}}) == [2] and ids({"n": {"in": [5, 7]}, "tags": {"contains_all": ["a"]}}) == [1]
    assert ids({"tags": {"contains_any": ["b", "z"]}}) == [1] and ids({"tags": {"eq": ["a", "b"]}}) == [1]
    for kind, op, value in (("string", "gt", "a"), ("string", "contains_any", ["a"]), ("integer", "eq", True), ("string", "in", [])):
        with pytest.raises(predicates.IllegalPredicate):
            predicates.check(kind, op, value)


def test_rank_numbers(spark):
    rows = spark.createDataFrame([(1, 2.0, DAY - dt.timedelta(hours=24)), (2, 6.0, DAY), (3, 10.0, DAY + dt.timedelta(hours=5))], "id int, x double, at timestamp_ntz")
    now = F.lit(DAY.isoformat()).cast("timestamp_ntz")
    value = lambda rank: [round(r["r"], 6) for r in rows.withColumn("r", ranking.compile_rank(rank, now)).orderBy("id").collect()]
    assert value({"decay": {"of": {"age_hours": "at"}, "midpoint": 24}}) == [0.5, 1.0, 1.0]
    assert value({"normalize": "x"}) == [0.0, 0.5, 1.0] and value({"normalize": {"const": 3}}) == [0.0] * 3
    assert value({"saturate": {"of": "x", "midpoint": 2, "exponent": 1}})[0] == 0.5
    assert value({"max": ["x", {"product": {"factor": 3, "of": {"const": 1}}}]}) == [3.0, 6.0, 10.0]
    deep = "x"
    for _ in range(5):
        deep = {"normalize": deep}
    with pytest.raises(ranking.IllegalRank):
        ranking.compile_rank(deep)
    with pytest.raises(ranking.IllegalRank):
        ranking.compile_rank({"median": "x"})


def test_public_scores(spark):
    rows = spark.createDataFrame([(1, 9.0), (2, 5.0), (3, 2.0)], "id int, rank_score double")
    assert [round(r["s"], 6) for r in rows.withColumn("s", ranking.public_score()).orderBy("id").collect()] == [1.0, round(3 / 7, 6), 0.0]
    assert rows.withColumn("rank_score", F.lit(4.0)).withColumn("s", ranking.public_score()).where("s = 1").count() == 3


def test_fusion_numbers(spark):
    a, b = (spark.createDataFrame([(i, r)], "id int, rank int") for i, r in ((7, 1), (7, 4)))
    assert round(ranking.fuse({"a": (a, 1.0), "b": (b, 1.1)}).first()["fused"], 6) == 0.033581


def test_round_robin_order(spark):
    make = lambda ids: spark.createDataFrame([(i, r) for r, i in enumerate(ids, 1)], "id int, rank int")
    got = ranking.round_robin([make([1, 2, 3]), make([2, 4]), make([5])], 4).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 2, 5, 4]


def brute_paths(edges, seed, depth, limit, direction):
    branch = next(b for b in itertools.count(1) if b**depth >= limit)
    walk = [([seed], [])]
    out = []
    for hop in range(1, depth + 1):
        grown = []
        for nodes, ids in walk:
            steps = [(o, e) for e, s, o in edges if s == nodes[-1] and direction != "in"] + [(s, e) for e, s, o in edges if o == nodes[-1] and direction != "out"]
            grown += [(nodes + [n], ids + [e]) for n, e in sorted(x for x in steps if x[0] not in nodes)[:branch]]
        out += [(hop, n, e) for n, e in grown]
        walk = grown
    return sorted(out)[: limit + 1]


@pytest.mark.parametrize(("seed", "direction"), [(1, "out"), (2, "in"), (3, "both")])
def test_traversal_equals_a_plain_walk(spark, seed, direction):
    rng = random.Random(seed)
    edges = [(f"e{k:03}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for k in range(60)]
    df = spark.createDataFrame([(*e, "p") for e in edges], "edge_id string, subject string, object string, predicate string")
    got = [(r["depth"], r["nodes"], r["edge_ids"]) for r in graph.traverse(df, "n1", 3, 20, direction).collect()]
    assert sorted(got) == brute_paths(edges, "n1", 3, 20, direction)
    assert graph.branch_limit(20, 2) == 5 and graph.branch_limit(20, 1) == 20
    assert graph.traverse(df, "absent", 2, 5, direction).count() == 0


PAGES = "id int, key string, title string, type string, body string"


def test_relations_of_pages(spark):
    body = "Ann works at [Acme](../companies/acme.md#x) and see [[Beta Corp|Beta]], [[companies/gamma]] or people/bob. `[[Beta Corp]]` ```\n[[Beta Corp]]\n``` [[No Such Page]] again people/bob"
    rows = [(1, "people/ann", "Ann", "person", body), (2, "companies/beta-corp", None, "company", None), (3, "notes/beta-corp", "x", "note", ""), (4, "m/1", "Standup", "meeting", "With people/ann and people/ann")]
    got = {(r["subject"], r["object"], r["predicate"], r["link_source"]) for r in extract.relations(spark.createDataFrame(rows, PAGES), ("people", "companies")).collect()}
    assert got == {
        ("people/ann", "companies/acme", "works_at", "markdown"), ("people/ann", "companies/beta-corp", "wikilink_basename", "wikilink-resolved"), ("people/ann", "notes/beta-corp", "wikilink_basename", "wikilink-resolved"),
        ("people/ann", "companies/gamma", "works_at", "markdown"), ("people/ann", "people/bob", "works_at", "bare-slug"), ("people/ann", "people/bob", "mentions", "bare-slug"), ("m/1", "people/ann", "attended", "bare-slug"),
    }


def test_declared_facts(spark):
    body = "# Facts\n- no, a title\n## Facts ##\n- One\n  more\n2) two\n~~~\n- no\n~~~\n- ONE more\n\n  no\ntext\n* " + "x" * 90 + "\n### Other\n- no"
    assert extract.declared_facts(body, "facts") == ["One more", "two", "x" * 79 + "…"]
    pages = spark.createDataFrame([(1, "b", None, None, body), (2, "a", None, None, None), (3, "a", None, None, "## FACTS\n+ last")], PAGES)
    lines, left = extract.fact_index(extract.facts(pages, "Facts"), 2)
    assert lines == ["Page facts index:", "a: last", "b: One more", "Index truncated: 2 declared facts omitted."] and left == 2


def test_closure_and_depth_of_a_diamond(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (9, 8)], "child long, parent long")
    ids = spark.createDataFrame([(k,) for k in range(1, 10)], "id long")
    assert sorted(r["id"] for r in provenance.closure(edges, ids.where("id = 2")).collect()) == [2, 4, 5]
    assert {r["id"]: r["depth"] for r in provenance.depths(ids, edges).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 0, 7: 0, 8: 0, 9: 1}


def test_ingest_is_all_or_nothing(spark):
    schema = "id long, seq long, entity string, key string, content string, dedupe_key string"
    log = spark.createDataFrame([(1, 1, "e", None, "x", "d1")], schema)
    good = spark.createDataFrame([(1, None, "e", None, "x", "d1"), (2, None, "e", None, "y", "d2")], schema).withColumn("ordinal", F.col("id"))
    bad = good.withColumn("content", F.lit("other"))
    assert {r["id"]: r["verdict"] for r in ingest(log, good).collect()} == {1: "duplicate", 2: "inserted"}
    assert sorted(r["seq"] for r in append(log, ingest(log, good)).collect()) == [1, 2]
    assert append(log, ingest(log, bad)).count() == 1
    twice = good.where("id = 2").unionByName(good.where("id = 2").withColumn("id", F.lit(3).cast("long")).withColumn("content", F.lit("z"))).withColumn("ordinal", F.col("id"))
    assert {r["id"]: r["verdict"] for r in ingest(log, twice).collect()} == {2: "inserted", 3: "conflict"}
    with pytest.raises(IllegalBatch):
        append(log, ingest(log, good), most=1)
    nothing = good.withColumn("dedupe_key", F.lit(None).cast("string"))
    assert {r["verdict"] for r in ingest(log, nothing).collect()} == {"inserted"}


def test_accumulators(spark):
    log = log_of(spark, [(s, None, s != 4, False, "active", "") for s in range(1, 6)]).withColumn("x", F.when(F.col("seq") != 2, F.col("seq").cast("double")))
    marks = spark.createDataFrame([("e", 1, DAY)], "entity string, watermark long, last_success timestamp_ntz")
    amount = lambda a, t: [(r["matched"], r["amount"]) for r in triggers.accumulator(log, marks, "x", a, t).collect()]
    assert amount("sum", 8) == [(3, 8.0)] and amount("avg", 4) == [(3, 4.0)] and amount("count", 3) == [(3, 3.0)] and amount("max", 6) == []
    with pytest.raises(ValueError):
        triggers.accumulator(log, marks, "x", "sum", 0)
    delays = spark.createDataFrame([(n,) for n in (1, 2, 3, 9)], "n int").select(triggers.backoff(F.col("n")).alias("s"))
    assert [r["s"] for r in delays.collect()] == [5.0, 20.0, 80.0, 300.0]


def test_render_rules(spark):
    rows = spark.createDataFrame([("x" * 10 + "y" * 40, DAY), ("é<&>", DAY + dt.timedelta(seconds=5, microseconds=7))], "t string, at timestamp_ntz")
    short = [r["s"] for r in rows.select(render.truncate_middle(F.col("t"), 40).alias("s")).collect()]
    assert len(render.SENTINEL) == 23 and short[0] == "x" * 8 + render.SENTINEL + "y" * 9 and short[1] == "é<&>"
    assert rows.select(render.escape_untrusted(F.col("t")).alias("s")).collect()[1]["s"] == "é\\u003c\\u0026\\u003e"
    assert [r["n"] for r in rows.select(render.tokens(F.col("t")).alias("n")).collect()] == [13, 2]
    assert [r["s"] for r in rows.select(render.domain_time(F.col("at")).alias("s")).collect()] == ["2026-07-16T12:00Z", "2026-07-16T12:00:05.000007Z"]


def test_prefixes_stop_and_greedy_packing_goes_on(spark):
    rows = spark.createDataFrame([("g", k, c) for k, c in enumerate([4, 9, 3, 2])], "g string, k int, cost int")
    assert [r["k"] for r in packing.packed_prefix(rows, F.col("cost"), 9, [F.col("k")], ("g",)).collect()] == [0]
    assert sorted(r["k"] for r in packing.greedy_pack(rows, "cost", 9, "k", "g").collect()) == [0, 2, 3]
    budgets = packing.carried_budgets([("a", 0.5), ("b", 0.5)], 100)
    assert next(budgets) == ("a", 50) and budgets.send(30) == ("b", 70)


def test_text_queries():
    query = text.Query('running "red fox" -hound')
    assert query.density("The red fox runs") == 0.0 and query.density("the red fox is running") > query.density("running far away from the old red fox") > 0
    assert query.density("running red fox hound") == 0.0 and text.Query("cat or dog").density("a dog") > 0
    assert text.stem("stories") == "story" and text.Query("the of").density("the of") == 0.0


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, "Risk [importance=2]"), (2, "Risk [importance=99]"), (3, None), (4, "[importance=x]")], "id int, t string")
    assert [r["s"] for r in rows.select(enrich.marked_score(F.col("t"), "importance", 0.0, 10.0, 5.0).alias("s")).collect()] == [2.0, 10.0, 5.0, 5.0]
    v = [r["v"] for r in rows.select(vectors.deterministic_embedding(F.col("t")).alias("v")).collect()]
    assert v[2] is None and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[0] != v[1]


def test_search_sources_are_checked(spark):
    for source in (Source("vector"), Source("near", k=3), Source("recent", k=101)):
        with pytest.raises(IllegalSearch):
            run_source(None, source)


def test_search_caps_before_conditions(spark):
    log = log_of(spark, [(s, None, True, False, "active", str(s % 2)) for s in range(1, 31)]).withColumn("last_accessed", F.col("occurred_at")).withColumn("embedding", F.array(F.lit(1.0)))
    now = F.lit(DAY.isoformat()).cast("timestamp_ntz")
    late = run_source(log, Source("recent", where={"content": {"eq": "0"}}, k=20, candidates=10), now).collect()
    early = run_source(log, Source("recent", where={"content": {"eq": "0"}}, k=20, candidates=10, prefilter=True), now).collect()
    assert len(late) == 5 and len(early) == 10


def test_schedules():
    from ledgerlens.functions.schedule import Cron

    start = dt.datetime(2026, 7, 16)
    assert [t.minute for t in Cron("*/20 3 * * *").buckets(start, start + dt.timedelta(hours=6))] == [0, 20, 40]
    assert len(list(Cron("* * * * *").buckets(start, start + dt.timedelta(days=1), 100))) == 100
    assert Cron("0 0 1 * 4").due(start) and not Cron("0 0 1 * *").due(start) and Cron("0 0 * * 7").due(dt.datetime(2026, 7, 19))
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)


def test_artifacts(spark):
    from ledgerlens.plans.artifacts import Block, is_stale, render as make

    lines = spark.createDataFrame([(k, "x" * 8, k) for k in range(5)], "id int, line string, place int")
    made = make("A {{ blocks.a }} B {{ blocks.b }}", {"a": Block(lines, 5), "b": Block(lines, 0)})
    assert made.text == "A " + "\n".join(["x" * 8] * 2) + " B " and made.manifest == {"a": [0, 1], "b": []}
    seen = spark.createDataFrame([(3,)], "seq long")
    assert not is_stale("h", "h", 3, seen) and is_stale("h", "h", 2, seen) and is_stale("h", "g", 9, seen)


def test_required_queue_takes_the_whole_run(spark):
    rows = lambda n: spark.createDataFrame([(k, k, "r" if k % 3 == 0 else None if k % 3 == 1 else "other", k % 20 == 19) for k in range(3 * n)], "id long, seq long, run_id string, ready boolean")
    expected = [k for k in range(0, 150, 3) if k % 20 != 19]
    assert len(expected) > 32 and sorted(r["id"] for r in enrich.required_queue(rows(50)).collect()) == expected
    with pytest.raises(ValueError, match="over 50"):
        enrich.required_queue(rows(60))
    plain = spark.createDataFrame([(k, k, "r" if k == 40 else None, False) for k in range(60)], "id long, seq long, run_id string, ready boolean")
    assert sorted(r["id"] for r in enrich.required_queue(plain).collect()) == list(range(32))
    assert sorted(r["id"] for r in enrich.required_queue(plain.where("id > 29")).collect()) == list(range(30, 40))
    assert enrich.required_queue(plain.limit(0)).count() == 0


@pytest.mark.parametrize("small", [10_000, 40, 0])
def test_closures_of_any_size_are_alike(spark, monkeypatch, small):
    """Held here, by frontiers sent to all tasks, or by joins: the same closure and depths."""
    monkeypatch.setattr(provenance, "SMALL", small)
    rng = random.Random(4)
    links = [(k, rng.randrange(max(0, k - 30), k)) for k in range(1, 150) for _ in range(2)] + [(200, 201), (201, 200)]
    children, found, near = {}, {3: 0, 200: 0}, [3, 200]
    for c, p in links:
        children.setdefault(p, []).append(c)
    while near:
        near = sorted({c for i in near for c in children.get(i, ()) if c not in found})
        found.update({c: max(found.values()) + 1 for c in near})
    edges = spark.createDataFrame(links, "child long, parent long").coalesce(2)
    got = provenance.closure(edges, spark.createDataFrame([(3,), (200,), (3,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(found)
    depth = {0: 0}
    for k in range(1, 150):
        depth[k] = 1 + max(depth[p] for c, p in links if c == k)
    made = provenance.depths(spark.range(150), edges.where("child < 150"))
    assert {r["id"]: r["depth"] for r in made.collect()} == depth
    with pytest.raises(ValueError, match="cycle"):
        provenance.depths(spark.range(4), edges.where("child >= 200")).count()


def test_closure_and_depth_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(110)], "child long, parent long").coalesce(1)
    ids = spark.range(111).coalesce(1)
    assert {r["id"]: r["distance"] for r in provenance.closure(edges, ids.where("id = 1")).collect()} == {k: k - 1 for k in range(1, 111)}
    assert {r["id"]: r["depth"] for r in provenance.depths(ids, edges).collect()} == {k: k for k in range(111)}


def test_depths_of_a_cycle_are_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "child long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        provenance.depths(spark.range(4), edges)
    assert sorted(r["id"] for r in provenance.closure(edges, spark.range(1, 2)).collect()) == [1, 2, 3]


def test_purge_takes_runs_and_descendants(spark):
    rows = [("a1", "a", "run1", []), ("a2", "a", None, []), ("run1", None, None, []), ("b", "b", None, ["run1"]), ("c", "c", None, ["b", "x"]), ("d", "d", "run2", ["y"]), ("run2", None, None, [])]
    log = spark.createDataFrame(rows, "id string, key string, run_id string, derived_from array<string>").coalesce(1)
    assert sorted(r["id"] for r in provenance.purge(log, log.where("key = 'a'").limit(1), ("key",)).collect()) == ["a1", "a2", "b", "c", "run1"]


def test_the_shared_folder_is_the_sessions_or_a_local_one():
    class Stub:
        def __init__(self, master, folder=None):
            self.values, self.made = {"spark.master": master, "spark.checkpoint.dir": folder}, None
            self.conf, self.sparkContext = self, self

        def get(self, key, default=None):
            return self.values.get(key) or default

        def getCheckpointDir(self):
            return self.made

        def setCheckpointDir(self, folder):
            self.made = folder + "/own"

    assert session.shared_folder(Stub("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    local = Stub("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local) == local.made
    with pytest.raises(ValueError):
        session.shared_folder(Stub("spark://x"))


def test_cover_density_is_a_sum_over_least_covers(spark):
    """Brute force: all ranges that hold every word, without a smaller one inside."""
    from math import log1p

    rng = random.Random(11)
    query = text.Query("red blue or green")
    for _ in range(200):
        words = [rng.choice(["red", "blue", "green", "grey", "pink"]) for _ in range(rng.randint(0, 12))]
        best = 0.0
        for group in ({"red", "blue"}, {"green"}):
            covers = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if group <= set(words[i : j + 1])]
            least = [(i, j) for i, j in covers if not any((a, b) != (i, j) and i <= a and b <= j for a, b in covers)]
            best = max(best, sum(1 / (1 + log1p(j - i)) for i, j in least))
        assert query.density(" ".join(words)) == pytest.approx(best)
    rows = spark.createDataFrame([(1, "Red and blue"), (2, "reds, blue!"), (3, "bluered"), (4, None), (5, "red"), (6, "greenery green")], "id int, text string")
    got = {r["id"]: r["score"] for r in text.cover_density(rows, "red blue or green").collect()}
    assert got == {i: pytest.approx(query.density(t)) for i, t in ((1, "red and blue"), (2, "reds blue"), (6, "greenery green"))}
