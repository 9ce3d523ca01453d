"""The queries of the training-data operators: production parameters, whole tables, whole texts."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, exact_dedup, html_extract, language, mixing, near_dup, substring_dedup, surrogates, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: the square roots of the sources' sizes."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("content")), ties=("content",)).drop("content")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out()
    model = language.train(docs.where(~out))
    return language.identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of its owner: the setting ``ledgerlens.surrogates.key``, or a new one for each query."""
    key = spark.conf.get("ledgerlens.surrogates.key", None) or secrets.token_hex(32)
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"), key=key.encode()[:64])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.public_ranks()
    return bpe.encode_digest(_table(spark, sf_dir, "documents"), ranks, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, out = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxicity.held_out()
    machine = toxicity.train(docs.select("doc_id", "text"), labels.where(~out))
    return toxicity.score(docs.select("doc_id", "text", out.alias("held_out")), machine).select("doc_id", "held_out", "score", "predicted")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s+49], ' ')) AS h FROM starts
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM late)
), removed AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY 1),
kept AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(r.g), 0) AS n_removed, list(x.v ORDER BY x.p) FILTER (WHERE x.p IS NOT NULL AND o.p IS NULL) AS k
  FROM words w LEFT JOIN removed r USING (doc_id)
  LEFT JOIN (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM words) x ON x.doc_id = w.doc_id
  LEFT JOIN gone o ON o.doc_id = x.doc_id AND o.p = x.p
  GROUP BY 1, 2, 3
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM runs),
flat AS (SELECT doc_id, unnest(s) AS x FROM runs),
paired AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM paired JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_mixing": op2_mixing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_language": op5_language,
        "op6_surrogates": op6_surrogates,
        "op7_bpe": op7_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_near_dup": op9_near_dup,
        "op10_topk_search": op10_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op9_near_dup": OP9_SQL, "op10_topk_search": OP10_SQL}
