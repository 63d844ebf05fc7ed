"""Command line: create, add to and search an index of vectors in text files, and run experiments on it.

    python -m nearfield.cli -m create -db FOLDER -l VECTORS [-p BITS]
    python -m nearfield.cli -m search -db FOLDER -q QUERIES -k 3 [-r RADIUS]
    python -m nearfield.cli -m x -db FOLDER -q QUERIES -es 0.5,1:0.5,3 -rf REPORT

Vector files hold one vector a line, its numbers between blanks, commas or bars; a query's id is its line's place in the file.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import metrics, search
from nearfield.plans import experiments
from nearfield.plans.index import Builder, Index, load
from nearfield.sources.loaders import dense_ids, parse_vector, read_lines
from nearfield.sources.stores import append_report

#: The modes; the options below are named as users of such tools know them.
MODES = ("create", "add", "search", "x", "opt", "approxEvalEP", "approxEvalRecall")


def options() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="nearfield", description=__doc__.splitlines()[0])
    out.add_argument("-m", "--mode", choices=MODES, required=True)
    out.add_argument("-db", "--database", required=True, help="folder of the index")
    out.add_argument("-l", "--load", help="vectors to create the index from, or to add")
    out.add_argument("-q", "--query", help="query vectors")
    out.add_argument("-mq", "--max-queries", type=int, default=1000)
    out.add_argument("-p", "--pivots", type=int, default=7, help="bits or pivots of the index")
    out.add_argument("--kind", choices=("sketch", "permutation"), default="sketch")
    out.add_argument("--selector", default="random")
    out.add_argument("-k", type=int, default=1)
    out.add_argument("-r", type=float, default=None, help="radius")
    out.add_argument("-b", "--bulk", action="store_true", help="add without a look at what exists")
    out.add_argument("-n", "--name", default="default", help="name of the experiment")
    out.add_argument("-es", "--experiment-set", help="r1,k1:r2,k2:...")
    out.add_argument("-rf", "--exp-result", default="result", help="folder of the report")
    out.add_argument("-evalEp", type=float, default=None, help="error on position to reach")
    out.add_argument("-evalRecall", type=float, default=None, help="recall to reach")
    return out


def vectors(spark: SparkSession, path: str, at_most: int | None = None) -> DataFrame:
    """(id, v) of the lines of a file, numbered from 0."""
    lines = read_lines(spark, path).where(F.trim("value") != "").select("line_no", parse_vector(F.trim("value"), "double").alias("v"))
    if at_most is not None:
        lines = lines.orderBy("line_no").limit(at_most)
    return dense_ids(lines, ["line_no"]).select("id", "v")


def _calibrated(index: Index, queries: DataFrame, k: int, good) -> int:
    """The smallest number of buckets, doubling and then halving the gap, whose results on the queries are good enough."""
    top = index.buckets().count()
    low, high = 0, 1
    while high < top and not good(index.search(queries, k, reads=high)):
        low, high = high, min(top, 2 * high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if good(index.search(queries, k, reads=middle)) else (middle, high)
    return high


def run(spark: SparkSession, argv: Sequence[str]) -> DataFrame:
    """What the mode gives: statuses of added rows, results of a search, report rows, or one row of settings."""
    a = options().parse_args(argv)
    ks = tuple(sorted({1, 3, 10, 50, a.k}))
    if a.mode == "create":
        made = Builder(vectors(spark, a.load), a.kind, a.pivots).freeze(ks=ks, selector=a.selector)
        made.save(a.database)
        return spark.createDataFrame([(made.size(), len(made.pivot_ids))], "size long, pivots int")
    index = load(spark, a.database)
    if a.mode == "add":
        new = vectors(spark, a.load)
        if a.bulk:
            top = index.objects.agg(F.max("id")).first()[0]
            fresh = index._project(new.select((F.col("id") + (0 if top is None else top + 1)).alias("id"), "v"))
            fresh.select(*index.objects.columns).write.mode("append").parquet(f"{a.database}/objects")
            return new.select("id", F.lit("OK").alias("status"))
        after, status = index.insert(new)
        fresh = after.objects.join(index.objects.select("id"), "id", "left_anti").select(*index.objects.columns)
        status = status.select("id", "status", "stored_id").collect()  # a line for each added row, as the command prints it
        fresh.write.mode("append").parquet(f"{a.database}/objects")
        return spark.createDataFrame(status, "id long, status string, stored_id long")
    queries = vectors(spark, a.query, a.max_queries)
    if a.mode == "search":
        return index.search(queries, a.k, a.r, None if a.k in index.reads else index.buckets().count())
    if a.mode in ("x", "opt"):
        grid = experiments.parse_grid(a.experiment_set)
        if a.mode == "x":
            report = experiments.run_grid(index, queries, grid, a.name)
            append_report(report, a.exp_result)
            return report
        # The Pareto front over bits and kinds: recall up, rows read down.
        radius, k = grid[0]

        def measure(made: Index) -> dict[str, float]:
            row = experiments.run_grid(made, queries, [(radius, k)], a.name).first()
            return {"recall": float(row["recall"] or 0.0), "reads": -float(row["buckets"])}

        objects = index.objects.select("id", "v")
        tried = experiments.sweep(lambda kind, size: Builder(objects, kind, size).freeze(ks=(k,)), measure, kind=("sketch", "permutation"), size=(4, a.pivots))
        return spark.createDataFrame([(t["kind"], t["size"], t["measures"]["recall"], int(-t["measures"]["reads"])) for t in tried], "kind string, size int, recall double, buckets long")
    if a.mode == "approxEvalEP":
        full = search.full_match(index.objects, queries, index.distance)
        ranked = full.withColumn("id", F.col("rank").cast("long"))
        reads = _calibrated(index, queries, a.k, lambda found: (metrics.error_on_position(found, ranked).agg(F.avg("ep")).first()[0] or 0.0) <= a.evalEp)
    else:
        truth = search.vector_search(index.objects, queries, index.distance, a.k)
        reads = _calibrated(index, queries, a.k, lambda found: (metrics.recall(found, truth).agg(F.avg("recall")).first()[0] or 0.0) >= a.evalRecall)
    return spark.createDataFrame([(a.k, reads)], "k int, reads int")


def main() -> None:
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    run(spark, None).show(100, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
