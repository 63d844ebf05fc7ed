"""Statistics of tables, buckets and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moments(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """n, mean, sample standard deviation, min and max."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def bucket_sizes(objects: DataFrame, bucket: str = "bucket") -> DataFrame:
    return objects.groupBy(bucket).agg(F.count("*").alias("n"))


def bucket_size_stats(objects: DataFrame, bucket: str = "bucket") -> DataFrame:
    return moments(bucket_sizes(objects, bucket), F.col("n").cast("double"))


def multiset_distribution(rows: DataFrame, value: str) -> DataFrame:
    """How many values occur how often."""
    return rows.groupBy(value).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n_values"))


def sketch_balance(objects: DataFrame, bits: int, sketch: str = "bucket") -> DataFrame:
    """(bit, ones, zeros, imbalance) of a one-word sketch, in one pass."""
    counts = objects.agg(F.count(sketch).alias("n"), *[F.sum(F.shiftright(sketch, i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{i}") for i in range(bits)])
    out = counts.select("n", F.posexplode(F.array(*[f"b{i}" for i in range(bits)])).alias("bit", "ones"))
    return out.select("bit", "ones", (F.col("n") - F.col("ones")).alias("zeros"), F.abs(F.col("n") - 2 * F.col("ones")).alias("imbalance"))


def intrinsic_dimension(pairs: DataFrame, distance: str = "distance") -> DataFrame:
    """mean^2 / (2 variance) of pair distances."""
    return pairs.agg((F.pow(F.avg(distance), 2) / (2 * F.var_samp(distance))).alias("dimension"))


def distance_histogram(pairs: DataFrame, width: float, distance: str = "distance") -> DataFrame:
    return pairs.groupBy(F.floor(F.col(distance) / width).cast("long").alias("cell")).agg(F.count("*").alias("n"))


def buckets_needed(order: DataFrame, ks: list[int]) -> DataFrame:
    """For every query and k the number of buckets to read, in the given order, until k objects are seen.

    order has (qid, n, place): the size of the bucket at each place. A k beyond the table isn't reached and has no row.
    """
    seen = F.sum("n").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return order.withColumn("seen", seen).select("qid", "place", "seen", asked).where("seen >= k").groupBy("qid", "k").agg(F.min("place").alias("needed"))


def estimate_k(needed: DataFrame, alpha: float = 3.0) -> DataFrame:
    """round(mean + alpha * std) buckets for each registered k; at least 1."""
    value = F.round(F.avg("needed") + alpha * F.coalesce(F.stddev_samp("needed"), F.lit(0.0)))
    return needed.groupBy("k").agg(F.greatest(value, F.lit(1.0)).cast("long").alias("buckets"))
