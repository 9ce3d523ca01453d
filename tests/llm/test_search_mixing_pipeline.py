"""Top-k search and mixing against brute force, and the pipeline."""

import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import mixing, topk_search
from pyspark.sql import functions as F


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(400)]
    rows += [(500 + k, rows[0][1]) for k in range(40)]  # many equal vectors: ties to the smaller id
    rows += [(600, None), (601, []), (602, [float("nan")] * 8), (603, [None] + [1.0] * 7), (604, [1.0] * 5), (700, [1.0] * 5), (800, rows[3][1]), (800, rows[3][1]), (None, rows[1][1]), (900, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, slot string, rank int").repartition(5)
    valid = [(i, [int(np.floor(float(x) * 1024)) if abs(x) < 1e20 else int(float(np.float32(x))) * 1024 for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, a in valid:
        if q % 100 == 0:
            scored = sorted((-max(-topk_search.LONG, min(topk_search.LONG, sum(x * y for x, y in zip(a, b)))), i) for i, b in valid if i != q and len(b) == len(a))
            expected += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    got = [tuple(r) for r in topk_search.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(expected)
    assert topk_search.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_with_small_blocks_and_long_tailed_norms(spark, monkeypatch):
    """Many blocks, pairs cut often, rows skipped by their norms, and queries that repeat: still exact."""
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 64 * 8 * 10)
    rng = np.random.default_rng(5)
    rows = [(k // 2 * 2, (rng.normal(size=64) * (0.01 if k % 9 else 3.0)).astype(np.float32).tolist()) for k in range(1200)]
    got = [tuple(r) for r in topk_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 100 == 0, k=3).collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024)
    expected = []
    for at in np.flatnonzero(ids % 100 == 0):
        score = matrix @ matrix[at]
        best = [n for n in np.lexsort((ids, -score)) if ids[n] != ids[at]][:3]
        expected += [(int(ids[at]), r, int(ids[n]), int(score[n])) for r, n in enumerate(best, 1)]
    assert sorted(got) == sorted(expected)


def test_lengths_bound_what_can_reach_a_threshold():
    rng = np.random.default_rng(6)
    queries, rows = rng.normal(size=(20, 12)).round(2) * 100, rng.normal(size=(500, 12)).round(2) * rng.choice([1, 100], size=(500, 1))
    cut = np.sort(queries @ rows.T, 1)[:, -5].astype(np.int64)
    short = ~(topk_search.norms(rows) >= topk_search.needed_lengths(queries, cut, np.zeros(20, bool))).any(1)
    assert short.any() and ((queries @ rows[short].T) < cut[:, None]).all()
    assert not topk_search.needed_lengths(queries, cut, np.ones(20, bool)).any()


def test_best_keeps_the_first_of_ties(monkeypatch):
    monkeypatch.setattr(topk_search, "PAIRS", 50)
    rng = np.random.default_rng(7)
    best, every = topk_search.Best(4, 3), []
    for _ in range(30):
        q, i, s = rng.integers(0, 4, 20), rng.permutation(1000)[:20], rng.integers(0, 6, 20)
        best.add(q, i, s)
        every += zip(q.tolist(), (-s).tolist(), i.tolist())
    expected = [x for n in range(4) for x in sorted(e for e in every if e[0] == n)[:3]]
    assert [(a, -c, b) for a, b, c in zip(*(x.tolist() for x in best.cut()))] == expected


@pytest.mark.parametrize("seed", range(6))
def test_windows_and_deviation(seed):
    rng = random.Random(seed)
    blocks = {f"s{k}": rng.randint(1, 90) for k in range(rng.randint(1, 7))}
    weights = {s: Fraction(rng.randint(1, 20), 7) for s in blocks}
    plan = mixing.pfair(blocks, weights)
    assert sorted(t for _, _, t, _, _ in plan) == list(range(sum(blocks.values())))
    assert all(r <= t < d for _, _, t, r, d in plan)
    # until the first source is exhausted, each source is less than one block from its share
    total, done = sum(weights.values()), dict.fromkeys(blocks, 0)
    for s, _, t, _, _ in sorted(plan, key=lambda x: x[2]):
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * weights[x] / total) < 1 for x in blocks)
        if done[s] == blocks[s]:
            break


def test_mix_schedules_every_row_once(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 12}") for k in range(900)] + [(900, None), (901, None), (None, "hot"), (5, "hot")]
    df = spark.createDataFrame([(i, s, "t", 7) for i, s in rows], "doc_id long, source string, text string, slot int")
    got = mixing.mix(df, {"hot": 0.5, "s0": 0.3, "s3": 0.2}, block_rows=16).collect()
    assert len(got) == len(rows) and len({(r["slot"], r["turn"]) for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    last = max(r["slot"] for r in got if r["source"] in ("hot", "s0", "s3"))
    assert all(r["slot"] > last for r in got if r["source"] in (None, "s6", "s9"))
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34 !!", "en", "x", 8), (10_002, None, "en", "x", 0), (10_003, docs.first()["text"], None, None, None)], docs.schema)
    rows = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows.count(), stage(spark, rows, sf).cache()
        if name != "encoding":
            assert rows.columns == docs.columns
        if name == "language":
            assert rows.where("doc_id IN (10001, 10002)").count() == 0 and rows.count() == before - 2
        if name == "exact_dedup":
            assert rows.where("doc_id = 10003").count() == 0 and rows.select(F.lower("text")).distinct().count() == rows.count()
        if name in ("mixing", "encoding"):
            assert rows.count() == before
    assert rows.where("n_tokens > 0").count() == rows.count()


def test_pipeline_result_is_in_mixed_order(spark, tmp_path):
    """The places of run()'s rows are those of brute-force Pfair, with a hot source and two texts under one id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {lang: sorted({w for r in docs.where(F.col("lang") == lang).select("text").collect() for w in r["text"].split() if w.isalpha()}) for lang in ("en", "de")}
    rng = random.Random(5)
    sizes = {"hot": 1500, "a": 500, "b": 300, "c": 90}
    rows = [(s, lang, " ".join(rng.choices(words[lang], k=60))) for s, n in sizes.items() for lang in [rng.choice(("en", "de"))] for _ in range(n)]
    rows = [(max(k, 1), t, lang, s, len(t)) for k, (s, lang, t) in enumerate(rows)]
    spark.createDataFrame(rows, docs.schema).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    got = first.collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in second.collect()]
    assert [(r["slot"], r["turn"]) for r in got] == sorted({(r["slot"], r["turn"]) for r in got})
    counts = {s: sum(r["source"] == s for r in got) for s in sizes}
    assert all(counts[s] > 0.9 * sizes[s] for s in sizes)
    blocks, weights = {s: -(-n // 256) for s, n in counts.items()}, mixing.target_weights(counts)
    plan = {t: (s, b) for s, b, t, _, _ in mixing.pfair({f"s{s}": n for s, n in blocks.items()}, {f"s{s}": w for s, w in weights.items()})}
    assert {r["slot"] for r in got} == set(plan) and all(f"s{r['source']}" == plan[r["slot"]][0] for r in got)
    filled = {t: sum(r["slot"] == t for r in got) for t in plan}
    assert all(filled[t] == min(256, counts[s[1:]] - 256 * b) for t, (s, b) in plan.items())
    total, done = sum(weights.values()), dict.fromkeys(blocks, 0)
    for t in sorted(plan):
        s = next(r["source"] for r in got if r["slot"] == t)
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * weights[x] / total) < 1 for x in blocks)
        if done[s] == blocks[s]:
            break


def test_pipeline_with_odd_rows_equals_brute_force(spark, tmp_path):
    """Null and repeated ids, rows that are equal, ties, no text, and columns named like the operators' results."""
    import hashlib

    import tiktoken

    from ledgerlens.llm import bpe

    rng = random.Random(8)
    base = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' AND n_chars > 400").limit(12).collect()]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(1, base[1]), (1, base[1]), (None, base[1]), (None, base[2]), (None, base[2]), (3, base[4].upper()), (90, base[5] + " tail"), (None, base[6] + " tail"), (91, base[7].lower()), (1, "so this is the other text of the one with that and the same")]
    rows += [(None, "the cat and the dog were there with all of the others"), (None, "the cat and the dog were there with all of the others"), (92, None), (93, ""), (94, "12 !!")]
    rng.shuffle(rows)
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string, kept string, component_id string, Turn int, text_sha256 string, decoded_sha256 string"
    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 5 == 0 else "s", len(t or ""), "a", "b", "c", "d", 4, "e", "f") for i, t in rows], columns).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out, found = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path)).cache()
        found[name] = out.collect()
        if name != "encoding":
            assert out.columns == docs.columns and all(r["score"] == "a" and r["slot"] == "b" and r["Turn"] == 4 for r in found[name])
    assert len(found["language"]) == len(rows) - 3
    norm = lambda t: t.encode().lower().decode()
    groups = {}
    for i, t in rows:
        if t and t != "12 !!":
            groups.setdefault(norm(t), []).append((i is None, i))
    exact = sorted((min(g), t) for t, g in groups.items())
    assert sorted(((r["doc_id"] is None, r["doc_id"]), norm(r["text"])) for r in found["exact_dedup"]) == exact

    def runs(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    left, components = list(exact), []
    while left:
        component = [left.pop(0)]
        for c in component:
            near = [x for x in left if 100 * len(runs(x[1]) & runs(c[1])) >= 75 * len(runs(x[1]) | runs(c[1]))]
            component += near
            left = [x for x in left if x not in near]
        components.append(min(component))
    near = [((r["doc_id"] is None, r["doc_id"]), norm(r["text"])) for r in found["near_dedup"]]
    assert sorted(near) == sorted(components) and len(components) < len(exact)
    assert sorted(map(repr, found["mixing"])) == sorted(map(repr, found["near_dedup"]))
    ranks, pattern = bpe.public_ranks()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = [(r["doc_id"], len(x := known.encode_ordinary(r["text"])), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in found["mixing"]]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found["encoding"]), key=repr) == sorted(expected, key=repr)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_of_rows_without_ids_and_of_many_sources(spark):
    rows = [(None, "a", k) for k in range(9000)] + [(7, "a", k) for k in range(3000)] + [(k, f"s{k}", 0) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, content long")
    got = mixing.mix(df, block_rows=64, ties=("content",)).collect()
    assert len({(r["slot"], r["turn"]) for r in got}) == len(rows)
    again = mixing.mix(df.repartition(5), block_rows=64, ties=("content",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert max(r["block"] for r in mixing.mix(df, block_rows=1, most_blocks=50).collect()) <= 50
