"""From raw documents to encoded training data, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last returns token digests and places in the mix.
``run`` writes each stage's rows as a Parquet table in the shared folder and reads them for the next one.

Defined cases, for all stages: an empty table gives no rows; null and empty texts, and texts without a letter, are
rejected by the first stage; null sources are a source of their own; a null language is not learned from, and the row is
judged by its text; rows without an id and rows that share one are documents like others, and one row of each text stays;
rows that are equal in all columns are one document; extra columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, common, exact_dedup, language, mixing, near_dup

#: A text whose best language is no more likely than this on ``language.EVIDENCE`` bytes has no language that stands out.
LEAST_SCORE = 0.35


#: A-Z to a-z, as exact deduplication compares texts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shielded(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with its own columns of these names out of an operator's way; ``_restored`` puts them back."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in names})


def _restored(docs: DataFrame, names: tuple[str, ...], columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"__own_{c}").alias(c) if c.lower() in names else F.col(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, no text, or no language that stands out."""
    found = language.identify(_shielded(docs, ("lang_pred", "score")), language.train(docs))
    return _restored(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), ("lang_pred", "score"), docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the one with the smallest id, a row with an id before one without.

    Rows that share id and text are reduced to one in each task before the shuffle, so no group of copies meets in one.
    """
    judged = exact_dedup.content_sort_groups(docs.select("doc_id", "text"))
    winners = judged.where("kept").select(F.col("text_sha256").alias("__sha"), F.col("doc_id").alias("__id")).distinct()
    rows = docs.withColumn("__sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)).withColumn("__order", F.xxhash64(*docs.columns))
    own = Window.partitionBy("__sha", "doc_id").orderBy("__order")
    single = rows.withColumn("__n", F.row_number().over(own)).where("__n = 1")
    return single.join(winners, (single["__sha"] == winners["__sha"]) & single["doc_id"].eqNullSafe(winners["__id"]), "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows are told apart by a hash of id and text, so rows that share an id, or have none, are documents of their own.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    numbered = rows.select(F.col("__row").alias("doc_id"), "text")
    found = common.materialise(near_dup.near_duplicates(numbered).select(F.col("doc_id").alias("__row"), "component_id"), "near-groups")
    ids = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("who"))
    winners = ids.join(found, "__row").groupBy("component_id").agg(F.min("who").alias("who")).select(F.col("who.__row").alias("__row"))
    return rows.join(winners, "__row", "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    names = (*mixing.ADDED, "decoded_sha256")
    hashed = _shielded(docs, names).withColumn("decoded_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return _restored(mixing.in_mixed_order(mixing.mix(hashed, ties=("decoded_sha256",))), names, docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document, in the order of the mix: slot and turn are its place there.

    Readers of a Parquet table don't keep its order, so the places are derived again, from the same ids and source counts.
    """
    ranks, pattern = bpe.public_ranks()
    coded = bpe.encode_digest(docs.select("doc_id", "source", "text"), ranks, pattern, keep=("doc_id", "source")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = common.materialise(coded, "encoded")  # mixing reads it more than once
    return mixing.in_mixed_order(mixing.mix(coded, ties=("decoded_sha256",)), keep=("slot", "turn"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]

#: Code lengths of a trained model decide the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{name}")
    return docs
