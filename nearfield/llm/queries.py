"""Queries over whole tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe_count, decontaminate, exact_dedup, jaccard_join, langid, line_crf, packing, pii, token_files, toxicity
from nearfield.llm.common import Scratch, held_out, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them back."""
    folder = Scratch(spark, "token-files").folder("documents")
    return token_files.read_token_files(spark, token_files.write_token_files(table(spark, sf_dir, "documents"), folder))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; a deployment passes its own secret key."""
    return pii.replace_personal_data(table(spark, sf_dir, "documents"), key="public example key").select("doc_id", "text", "n_entities")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = line_crf.score_quality(documents, line_crf.fit_quality(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, one row for each such pair."""
    found = decontaminate.benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "item_words", F.size("tiles").alias("n_tiles"), F.array_max(F.col("tiles.words")).alias("longest_tile"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify_languages(documents, langid.fit_centroids(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_exact_dedup, op3_pii_surrogates, op4_quality, op5_decontaminate, op6_toxicity, op7_packing, op8_token_counts, op9_jaccard_join, op10_language_id)
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
}
