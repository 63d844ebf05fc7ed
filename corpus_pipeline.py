"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

The first four return the columns of documents unchanged, whatever their names and with nulls in any of them; an empty table gives an
empty one. What each stage does with null, empty, equal and very long texts is said at the function that it calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, exact_dedup, jaccard_join, line_crf, packing
from nearfield.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field doesn't reject; it is trained on the input's labels and their documents.

    Without labels of both kinds all documents stay. See line_crf.keep_good.
    """
    return line_crf.keep_good(docs, line_crf.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id, a null one last. See exact_dedup.drop_exact_duplicates."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; those without words stay. See jaccard_join.drop_near_duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay. See decontaminate.drop_contaminated."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 1,024 tokens; a null text packs as an empty one. See packing.pack."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: The classifier's and the tokenizer's rows can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    store = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.step(docs, name.replace(" ", "-"))
    return docs
