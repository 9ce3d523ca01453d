"""Exact, near and substring deduplication against brute force, with the edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark import cloudpickle

from ledgerlens.llm import common, exact_dedup, near_dup, substring_dedup
from ledgerlens.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    out = [(0, None), (1, ""), (2, " \t\x0b"), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, "x " * 30_000), (9, None)]
    for k in range(10, 120):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 30, 50, 51, 90, 200]))]
        if k > 30 and rng.random() < 0.6:
            old = (out[rng.randrange(len(out))][1] or "").split()[:400]
            at = rng.randrange(max(1, len(old) - 60))
            base = old[:] if rng.random() < 0.5 else base + old[at : at + rng.choice([49, 50, 75, 120])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
        out.append((k, " ".join(base)))
    return out + [(200, "A b"), (200, "A b"), (None, "A b"), (201, out[20][1]), (202, out[20][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, part string, node int").cache()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_equal_brute_force(docs, rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = max if keep == "largest" else min
    expected = []
    for text, ids in groups.items():
        stays = best(i for i in ids if i is not None)
        expected += [(i, stays, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.content_sort_groups(docs, keep=keep).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_exact_group_over_many_partitions(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(900)], "doc_id long, text string")
    got = exact_dedup.content_sort_groups(docs).where("group_size = 600").agg({"keep_id": "min", "kept": "max", "doc_id": "count"}).first()
    assert got["count(doc_id)"] == 600 and got["min(keep_id)"] == 1


def brute_sets(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_components_equal_brute_force(docs, rows):
    known = [(i, brute_sets(t)) for i, t in rows]
    ids = sorted({i for i, _ in known if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    expected = [(i, len(s), find(i) if i is not None else None, i is not None and find(i) == i) for i, s in known]
    got = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_chain_of_near_copies_is_one_component(spark):
    """Links that miss the bucket's smallest member are found among its other members."""
    rng = random.Random(2)
    base = [f"v{k}" for k in range(300)]
    texts = []
    for k in range(120):
        own = base[:]
        for at in rng.sample(range(300), rng.choice([0, 1, 2, 4, 6, 9])):
            own[at] = f"z{rng.randrange(10_000)}"
        texts.append((k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {i: brute_sets(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert got == {i: find(i) for i in sets}


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(0)
    for similarity in (0.5, 0.75, 0.9):
        found = []
        for _ in range(60):
            n = 300
            shared = int(2 * n * similarity / (1 + similarity))
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            found.append((near_dup.super_min_hash(x[:n]) == near_dup.super_min_hash(x[n - shared :])).mean())
        assert abs(np.mean(found) - similarity) < 0.02


def brute_repeats(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s : s + 50])
                first[key] = min(i, first.get(key, i))
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        yield i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_repeats_equal_brute_force(docs, rows):
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).drop("kept_text").collect()]
    expected = list(brute_repeats(rows))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 0


def test_anchor_is_the_least_phrase_of_each_window():
    x = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    phrases = common.rolled(x, substring_dedup.PHRASE)
    width = 50 - substring_dedup.PHRASE + 1
    place, found = substring_dedup.anchor_of_windows(x)
    assert (found == phrases).all() and place.tolist() == [k + int(phrases[k : k + width].argmin()) for k in range(151)]
    assert len(substring_dedup.anchor_of_windows(x[:50])[0]) == 1
    same = np.repeat(np.uint64(7), 200)  # of equal phrases the last one
    assert substring_dedup.anchor_of_windows(same)[0].tolist() == list(range(38, 189))


def test_word_hashes_are_those_of_the_words(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(common, "PIECE", 64)
    text = b" \t\n\x0b\x0c\r".join(bytes(rng.choices(b"ab\xc3\xa9\x1f\x85", k=rng.randint(1, 90))) for _ in range(300))
    words = text.split()
    got = common.word_hashes(b"  " + text + b" ")
    alone = {w: int(common.word_hashes(w)[0]) for w in words}
    assert got.tolist() == [alone[w] for w in words] and len(set(alone.values())) == len(alone)
    assert len(common.word_hashes(b"")) == len(common.word_hashes(b" \n")) == 0


def test_repeats_are_decided_by_the_automaton(docs, monkeypatch):
    """Without the automaton's hits no word goes: what hashes choose is only where to look."""

    class Blind(substring_dedup.Shard):
        def ready(self):
            pass

    monkeypatch.setattr(substring_dedup, "Shard", Blind)
    cloudpickle.register_pickle_by_value(substring_dedup)  # workers get the changed module
    try:
        assert sum(r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()) == 0
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)


def test_shard_finds_only_equal_words_of_smaller_documents():
    words = [b"w%d" % k for k in range(130)]
    shard = substring_dedup.Shard()
    shard.add(5, words[:90])
    shard.add(8, words[60:130])
    shard.ready()
    assert shard.marked(words, 9) == [(0, 130)] and shard.marked(words, 8) == [(0, 90)] and shard.marked(words, 5) == []
    assert shard.marked([b"new", *words[10:59], b"new"], 9) == []  # 49 words
    assert shard.marked([b"new", *words[10:60], b"new"], 9) == [(1, 51)]
    assert shard.marked(words[:40] + [b"other"] + words[41:130], 9) == [(60, 130)]
    assert shard.marked(words[:39] + [b"other"] + words[40:130], 9) == [(40, 130)]


def test_long_and_periodic_texts(spark):
    line = [f"l{k}" for k in range(7)]
    texts = [(1, " ".join(line * 40)), (2, " ".join(line * 3000)), (3, " ".join(["same"] * 20_000)), (4, " ".join(["same"] * 70)), (4, "same " * 49), (None, "same " * 60), (5, "")]
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).drop("kept_text").collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(texts), key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, 6), (7, 6)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1100))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.content_sort_groups(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_many_rows_without_ids_or_with_one_id(spark):
    """Borders are sampled by chance, not by id: such rows are spread, and groups that cross borders are joined."""
    rows = [(None, f"text {k % 7}") for k in range(3000)] + [(5, "Text 1")] * 1500 + [(5, "other")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.content_sort_groups(docs, keep="largest").collect()
    sizes = {f"text {k}": sum(t.lower() == f"text {k}" for _, t in rows) for k in range(7)} | {"other": 500}
    found = {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in got}
    assert len(got) == len(rows) and found == {(hashlib.sha256(t.encode()).hexdigest(), 5 if t in ("text 1", "other") else None, n) for t, n in sizes.items()}


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    other = list(words)
    for at in rng.sample(range(len(other)), 1500):
        other[at] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:3000])), (4, "w1 " * 40_000), (5, " ".join(words).upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1} and got[4][0] == 1
    assert got[1][0] == len(brute_sets(rows[0][1])) == got[5][0]
    repeats = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text").collect()]
    assert sorted(repeats) == sorted(brute_repeats(rows))
