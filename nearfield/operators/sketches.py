"""A sorted set of distinct sketches, searched by Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.projections import WORD, hamming


def sketch_set(objects: DataFrame, sketch: str = "bucket") -> DataFrame:
    """(sketch): the distinct ones. Sorted ranges when written by save_sketch_set; Parquet stores them as differences."""
    return objects.select(F.col(sketch).alias("sketch")).distinct()


def save_sketch_set(sketches: DataFrame, path: str) -> None:
    sketches.repartitionByRange("sketch").sortWithinPartitions("sketch").write.mode("overwrite").option("parquet.writer.version", "v2").parquet(path)


def search_sketches(sketches: DataFrame, queries: DataFrame, first: int | None = None, bits: int = WORD) -> DataFrame:
    """(qid, sketch, distance, rank) in the order (distance, sketch): the first ones of each query, or all of them.

    queries (qid, sketch) are the small side. All of them is for statistics: the rows are queries times sketches.
    """
    asked = queries.select("qid", F.col("sketch").alias("q"))
    pairs = sketches.join(asked, F.lit(True)).select("qid", "sketch", hamming(F.col("q"), F.col("sketch"), bits).cast("long").alias("distance"))
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "sketch")).cast("long"))
    return out.where(F.col("rank") <= first) if first is not None else out
