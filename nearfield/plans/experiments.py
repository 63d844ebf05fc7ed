"""Experiments over (radius, k) grids, and sweeps over build parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import metrics, search
from nearfield.plans.index import Index


def parse_grid(text: str) -> list[tuple[float, int]]:
    """`r1,k1:r2,k2` as pairs."""
    return [(float(r), int(k)) for r, k in (cell.split(",") for cell in text.split(":"))]


def run_grid(index: Index, queries: DataFrame, grid: Iterable[tuple[float, int]], name: str = "experiment", reads: int | None = None) -> DataFrame:
    """A report row for each (radius, k): recall and error on position against the exact answer, and buckets read."""
    n_buckets = index.buckets().count()
    rows = []
    for radius, k in grid:
        found = index.search(queries, k, radius, reads)
        full = search.full_match(index.objects, queries, index.distance).join(queries.select(F.col("id").alias("qid")), "qid")
        truth = full.where((F.col("distance") <= radius) & (F.col("rank") <= k))
        seen = reads or index.reads_for(k)
        quality = metrics.recall(found, truth).join(metrics.error_on_position(found, full), "qid", "left")
        rows.append(quality.agg(
            F.lit(name).alias("exp_name"), F.lit(f"r={radius} k={k}").alias("details"), F.lit(index.objects.count()).cast("long").alias("dist"),
            F.lit(len(index.pivot_ids)).cast("long").alias("smap"), F.avg("ep").alias("ep"), F.avg("recall").alias("recall"),
            F.sum(F.when(F.col("ep").isNull(), 1).otherwise(0)).alias("zeros"), F.lit(min(seen, n_buckets)).cast("long").alias("buckets"),
        ))
    return reduce(DataFrame.unionByName, rows)


def sweep(build: Callable[..., Index], measure: Callable[[Index], dict[str, float]], **choices: Iterable) -> list[dict]:
    """Builds an index for every combination of parameters and returns those no other beats in all measures (larger is better)."""
    tried = []
    for values in product(*choices.values()):
        options = dict(zip(choices, values, strict=True))
        tried.append(options | {"measures": measure(build(**options))})

    def beaten(a: dict) -> bool:
        return any(all(b["measures"][m] >= v for m, v in a["measures"].items()) and b["measures"] != a["measures"] for b in tried)

    return [t for t in tried if not beaten(t)]


def reads_until(index: Index, queries: DataFrame, k: int, target: float) -> DataFrame:
    """For each query the smallest number of nearest buckets whose objects reach the target recall of its exact top k."""
    from pyspark.sql.window import Window

    from nearfield.plans.index import bucket_order

    asked = index._project(queries).select(F.col("id").alias("qid"), F.col("bucket").alias("q_bucket"))
    truth = search.vector_search(index.objects, queries, index.distance, k)
    places = bucket_order(asked, index.buckets(), index.projected)
    held = truth.join(index.objects.select("id", "bucket"), "id").join(places, ["qid", "bucket"]).groupBy("qid", "place").agg(F.count("*").alias("hits"))
    grown = held.withColumn("seen", F.sum("hits").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = truth.groupBy("qid").agg(F.count("*").alias("n"))
    return grown.join(whole, "qid").where(F.col("seen") >= target * F.col("n")).groupBy("qid").agg(F.min("place").alias("reads"))
